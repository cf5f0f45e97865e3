"""Counts over verdicts: totals, reasons as a map, summaries, and the comparison with what was expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.contract import ACCEPTED, REJECTED, REPLAYED


def totals(verdicts: DataFrame) -> DataFrame:
    """One row: lines, accepted, replayed, quarantined (a map from reason to count, sorted by reason)."""
    groups = verdicts.groupBy("verdict", "reason").agg(F.count("*").alias("n"))
    of = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0))
    reasons = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("verdict") == REJECTED, F.struct("reason", "n")))))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), of(ACCEPTED).alias("accepted"), of(REPLAYED).alias("replayed"), reasons.alias("quarantined"))


def total_of(counts: Column) -> Column:
    """The sum of a map's values."""
    return F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, x: a + x)


def by_stage_and_reason(quarantine: DataFrame) -> DataFrame:
    """stage, reason, n: by stage, the most frequent first, then by reason."""
    return quarantine.groupBy("stage", "reason").agg(F.count("*").alias("n")).orderBy("stage", F.desc("n"), "reason")


def compared(expected: DataFrame, actual: DataFrame, key: str = "reason") -> DataFrame:
    """Rows where the counts (column n) of the two differ."""
    both = expected.withColumnRenamed("n", "expected").join(actual.withColumnRenamed("n", "actual"), key, "full_outer")
    return both.select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual")).filter("expected <> actual")
