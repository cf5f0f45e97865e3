"""Newline-delimited JSON as rows, with their place in the files, and digests of whole files."""

from __future__ import annotations

import hashlib

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """value (binary, the line's bytes) and place, which orders lines as they stand in the files, earlier paths first.

    Lines end with a line feed; carriage returns before it go. Empty lines are dropped, blank ones stay.
    """
    parts = []
    for k, path in enumerate(paths):
        rows = spark.read.option("lineSep", "\n").text(path)
        place = F.struct(F.lit(k).alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        parts.append(rows.select(F.rtrim(F.col("value"), F.lit("\r")).cast("binary").alias("value"), place.alias("place")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.filter(F.length("value") > 0)


#: Bytes of the largest part that a task digests at once; larger ones are read as streams.
LARGEST = 256 * 2**20


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file in any store, read as a stream; of a folder, that of the digests of its parts in the order of their names.

    The names and empty parts don't count. Parts are digested by the executors.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isDirectory():
        return _folder_digest(spark, fs, at)
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def _folder_digest(spark: SparkSession, fs: JavaObject, at: JavaObject) -> str:
    parts = [x for x in fs.listStatus(at) if x.isFile() and x.getLen() and not x.getPath().getName().startswith(("_", "."))]  # as Spark reads them
    large = [x.getPath() for x in parts if x.getLen() > LARGEST]
    found = {x.getName(): file_digest(spark, x.toString()) for x in large}
    if len(large) < len(parts):
        rows = spark.read.format("binaryFile").load(at.toString()).filter((F.col("length") <= LARGEST) & ~F.col("_metadata.file_name").rlike("^[_.]"))
        found |= {r.file_name: r.sha256 for r in rows.select("_metadata.file_name", F.sha2("content", 256).alias("sha256")).collect()}
    return hashlib.sha256("".join(found[n] for n in sorted(found)).encode()).hexdigest()


def file_digests(spark: SparkSession, glob: str) -> DataFrame:
    """path and sha256 of many files of less than 2 GB, by the executors."""
    return spark.read.format("binaryFile").load(glob).select("path", F.sha2("content", 256).alias("sha256"))
