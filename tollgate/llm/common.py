"""What the operators share: the shared folder, written tables and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Only a local session without the setting gets a folder of its own; on a cluster the setting is required.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        set_dir = spark.sparkContext.getCheckpointDir()
        if set_dir:
            return set_dir
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tollgate-")
        spark.sparkContext.setCheckpointDir(at)
        return spark.sparkContext.getCheckpointDir()
    return at


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to a fresh table in the shared folder and read it again: lineage ends here, and lost executors lose nothing."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def named(df: DataFrame, name: str) -> str:
    """The column of df that name means: the one of that very name, else the only one but for case."""
    like = [c for c in df.columns if c.lower() == name.lower()]
    if name in like:
        return name
    if len(like) != 1:
        raise ValueError(f"no column {name!r}" if not like else f"column {name!r} is not the only one of its name")
    return like[0]


def add_columns(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[list], list[list]], tool: str | None = None) -> DataFrame:
    """df with columns computed from one text column in Arrow batches; a column of df with a new name is replaced.

    make gets a list of texts (None where null) and returns one list for each field.
    """
    names = {f.name.lower() for f in fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in names]
    # Plain names while Python has the rows: names with dots or those that differ by case don't pass.
    out = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(keep)] + [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(fields)])
    new = pa.schema([(f"n{i}", arrow_type(f.dataType)) for i, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_in"):
                made = make(part.column("text_in").to_pylist())
                heads = [f for f in part.schema if f.name != "text_in"]
                columns = [part.column(f.name) for f in heads] + [pa.array(v, t.type) for v, t in zip(made, new, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(heads + list(new)))

    rows = df.select(*[F.col(quoted(f.name)).alias(f"c{i}") for i, f in enumerate(keep)], F.col(quoted(text_col)).alias("text_in"))
    return rows.mapInArrow(run, out).select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(keep)], *[F.col(f"n{i}").alias(f.name) for i, f in enumerate(fields)])


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """batch in parts of about `most` bytes of text, one row at least."""
    n = batch.num_rows
    step = max(1, int(n * most / max(1, batch.column(column).nbytes)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))
