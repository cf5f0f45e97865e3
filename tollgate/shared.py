"""Tables in the folder that the driver and all executors share: lineage ends there, and lost executors lose nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without the setting gets one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tollgate-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh(spark: SparkSession, name: str = "tollgate") -> str:
    """A path in the shared folder that nothing has used."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read from a table in the shared folder; drop() removes it."""
    at = fresh(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def filled(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK_DESER) -> DataFrame:
    """df, persisted and computed before it is returned: of two readers at once, each would compute it or wait for the other."""
    out = df.persist(level)
    out.count()
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Remove a table of written(), once nothing reads it any more."""
    for file in df.inputFiles()[:1]:
        delete(df.sparkSession, file.rsplit("/", 1)[0])
