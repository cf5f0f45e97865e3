"""The corpus pipeline: stages over the documents table, each written as Parquet and read again by the next.

Language ID (texts that it rejects go), SimHash near-duplicates (one document of each component stays), benchmark
decontamination (documents with a window of a test item go), pseudonyms for private values, and BPE encoding and
decoding. All stages but the last return the columns of documents.

Cases: texts that are null, empty or without a letter go with the first stage; rows without an id are compared like any
other and come last when one of a component is chosen; rows that repeat an id stay where their texts are unlike, and
equal rows are one; extra columns are kept up to the last stage, whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm.common import free_name, stored, table
from tollgate.llm.decontaminate import decontaminated
from tollgate.llm.language import understood
from tollgate.llm.private import pseudonymised
from tollgate.llm.queries import bpe_digests, language_model, secret_key
from tollgate.llm.simhash import near_deduplicated


#: Bytes of an Arrow batch of the stages that run Python. Spark's own bound, for each task and direction, is eight times that.
BATCH, USUAL = "8m", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Set the session's bound on Arrow batches, unless it has one other than Spark's own."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == USUAL:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return understood(docs, language_model(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms in the texts; n_chars follows where a text has changed."""
    changed = free_name(docs, "changed_in")
    out = pseudonymised(docs, secret_key(spark), count_col=changed)
    return out.withColumn("n_chars", F.when(F.col(changed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(changed)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe_digests(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("bpe", bpe)]

#: Fingerprints, components, automata and merges are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir; tables between them are in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
