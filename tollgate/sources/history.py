"""What was accepted before, found without reading all of it: ids by hash ranges, with a Bloom filter for each file.

    root/<name>/part=<part>/range=<k>        ids and digests of a part, by ranges of the id's hash, a file each
    root/<name>_index                        for each part and range, bitmaps of its Bloom filter, in segments of 4 kB

A load or batch tests its own ids against the index first; only files that may hold one of them are read, and then joined
exactly. Numbers of ranges and segments are powers of two, so ids meet the index by a join on equal places, whatever the
sizes of the parts. A filter has `ID_BITS` bits for an id and lets through about one in a hundred that it doesn't hold.
Where more than `MOST_FILES` files may hold an id, all are read; either way nothing is missed.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.shared import delete
from tollgate.sources.tables import exists

IDS = T.StructType([T.StructField("id", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("stage", T.StringType()), T.StructField("part", T.StringType()), T.StructField("range", T.IntegerType())])
INDEX = T.StructType([T.StructField(n, t) for n, t in (("range", T.IntegerType()), ("ranges", T.IntegerType()), ("segment", T.IntegerType()), ("segments", T.IntegerType()), ("bits", T.BinaryType()), ("part", T.StringType()))])
#: Ids of a file; bits of a filter for an id, places that an id sets, bits of a segment.
FILE_IDS, ID_BITS, PLACES, SEGMENT = 1_000_000, 10, 5, 32_768
#: Files that are named to Spark one by one; beyond, the whole table is read.
MOST_FILES = 10_000


def power(x: float) -> int:
    return 2 ** max(0, ceil(log2(max(1.0, x))))


def place(salt: str, n: int | Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "id"), n if isinstance(n, Column) else F.lit(n)).cast("int")


def remember(ids: DataFrame, root: str, part: str, name: str = "ids", file_ids: int = FILE_IDS) -> None:
    """Add the rows (id, digest, stage; ids not null) of a part; the same part again is replaced, its filters widened."""
    n = ids.count()
    if not n:
        delete(ids.sparkSession, f"{root}/{name}/part={part}")
        return
    ranges = power(n / file_ids)
    segments = power(n / ranges * ID_BITS / SEGMENT)
    rows = ids.select("id", "digest", "stage").withColumn("range", place("range", ranges))
    at = f"{root}/{name}/part={part}"
    rows.repartition(ranges, "range").sortWithinPartitions("range", "id").write.mode("overwrite").partitionBy("range").parquet(at)
    spark = ids.sparkSession
    stored = spark.read.schema(T.StructType([f for f in IDS.fields if f.name != "part"])).parquet(at)
    bits = F.explode(F.array(*[place(f"place {k}", SEGMENT).cast("long") for k in range(PLACES)])).alias("bit")
    index = stored.select("range", place("segment", segments).alias("segment"), bits).groupBy("range", "segment").agg(F.bitmap_construct_agg("bit").alias("bits"))
    index = index.select("range", F.lit(ranges).alias("ranges"), "segment", F.lit(segments).alias("segments"), "bits", F.lit(part).alias("part"))
    index.coalesce(max(1, ranges * segments // 10_000)).write.mode("append").parquet(f"{root}/{name}_index")


def has_bit(bits: Column, bit: Column) -> Column:
    """Whether a bitmap has a bit: the byte that holds it, as a number, and its place there."""
    byte = F.conv(F.hex(F.substring(bits, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.bit_get(byte, bit % 8) == 1


def index_of(spark: SparkSession, root: str, name: str = "ids") -> DataFrame:
    path = f"{root}/{name}_index"
    return spark.read.schema(INDEX).parquet(path) if exists(spark, f"{path}/*.parquet") else spark.createDataFrame([], INDEX)


def files(spark: SparkSession, root: str, ids: DataFrame, name: str = "ids") -> list[tuple[str, int]]:
    """The files, as part and range, that may hold one of ids (id), at most one more than `MOST_FILES`."""
    index = index_of(spark, root, name)
    shapes = [(r[0], r[1]) for r in index.select("ranges", "segments").distinct().collect()]  # powers of two: few
    if not shapes:
        return []
    shape = F.explode(F.array(*[F.struct(F.lit(r).alias("ranges"), F.lit(s).alias("segments")) for r, s in shapes]))
    asked = ids.select("id").filter("id is not null").distinct().select("id", shape.alias("shape")).select("id", "shape.*")
    asked = asked.select("ranges", "segments", place("range", F.col("ranges")).alias("range"), place("segment", F.col("segments")).alias("segment"), *[place(f"place {k}", SEGMENT).alias(f"b{k}") for k in range(PLACES)])
    maybe = F.lit(True)
    for k in range(PLACES):
        maybe = maybe & has_bit(F.col("bits"), F.col(f"b{k}"))
    found = index.join(asked, ["ranges", "segments", "range", "segment"]).filter(maybe).select("part", "range").distinct()
    return [(r.part, r.range) for r in found.limit(MOST_FILES + 1).collect()]


def lookup(spark: SparkSession, root: str, ids: DataFrame, name: str = "ids", counts: Callable[[set[str]], set[str]] | None = None) -> DataFrame:
    """id, digest, stage, part and range of the remembered rows whose id is among ids (id).

    counts: of a set of parts, those that count.
    """
    at = f"{root}/{name}"
    where = files(spark, root, ids, name)
    every = len(where) > MOST_FILES
    if counts is not None and not every:
        good = counts({p for p, _ in where})
        where = [(p, r) for p, r in where if p in good]
    if not where:
        return spark.createDataFrame([], IDS)
    rows = spark.read.schema(IDS).option("basePath", at).parquet(*([at] if every else [f"{at}/part={p}/range={r}" for p, r in where]))
    if counts is not None and every:
        good = counts({r.part for r in index_of(spark, root, name).select("part").distinct().collect()})
        rows = rows.join(F.broadcast(spark.createDataFrame([(p,) for p in sorted(good)], "part string")), "part", "left_semi")
    return rows.join(ids.select("id").distinct(), "id", "left_semi").select(IDS.names)


def compact(spark: SparkSession, root: str, name: str = "ids") -> int:
    """Join the index's files, while nothing looks them up; how many there were. One that broke off only leaves rows twice."""
    old = index_of(spark, root, name)
    had = old.inputFiles()
    if len(had) > 1:
        old.dropDuplicates().repartition(max(1, len(had) // 1000), "part").sortWithinPartitions("part", "range", "segment").write.mode("append").parquet(f"{root}/{name}_index")
        for file in had:
            delete(spark, file)
    return len(had)
