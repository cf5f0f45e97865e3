"""Ordinals and exact selections without a task that gathers a group, or all rows.

Ordinals are prefix counts: rows are sorted by ranges of (group, order), each range numbers its own rows of a group, and
the rows of a group in the ranges before are added. A group that holds a third of all rows is spread over a third of the
ranges. The n rows of the least hashes are found by a histogram of the hash, sixteen bits at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.shared import written

BITS, LEVELS = 16, 4


def numbered(rows: DataFrame, group: list[str], order: list[str], result: str = "ordinal", ranges: int | None = None) -> DataFrame:
    """rows with result: how many rows of the same group come before, by order (nulls first), as a long.

    Null groups are groups like any other; rows of equal order come in any order, each with a number of its own.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Equal rows are told apart, so that a range can end between them.
    told = rows.withColumn("__tie", F.monotonically_increasing_id())
    dealt = told.repartitionByRange(n, *group, *order, "__tie").withColumn("__range", F.spark_partition_id())
    # Written, as ranges come from a sample: what is computed again could be cut elsewhere.
    dealt = written(dealt, "ranges")
    same = [F.col(c).eqNullSafe(F.col(f"__o{k}")) for k, c in enumerate(group)]
    sums = dealt.groupBy("__range", *group).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # A range shares a group with the one before only once, so these are fewer than there are ranges.
    offsets = sums.withColumn("__before", F.sum("__n").over(before)).filter("__before > 0")
    offsets = offsets.select(F.col("__range").alias("__at"), *[F.col(c).alias(f"__o{k}") for k, c in enumerate(group)], "__before")
    own = F.row_number().over(Window.partitionBy("__range", *group).orderBy(*order, "__tie")) - 1
    on = F.col("__range") == F.col("__at")
    for c in same:
        on = on & c
    out = dealt.withColumn("__own", own).join(F.broadcast(offsets), on, "left")
    return out.select(*rows.columns, (F.col("__own") + F.coalesce("__before", F.lit(0))).cast("long").alias(result))


def least(rows: DataFrame, hashed: Column, n: int, tie: list[str]) -> DataFrame:
    """The n rows of rows with the least hashes (a long, not null), those of equal hashes by tie; all if there are fewer."""
    if n <= 0:
        return rows.limit(0)
    keyed = rows.withColumn("__hash", hashed.bitwiseXOR(F.lit(-(2**63))))  # unsigned order
    prefix, left = 0, n
    for level in range(LEVELS):
        digit = F.shiftrightunsigned("__hash", 64 - BITS * (level + 1)).bitwiseAND(F.lit(2**BITS - 1))
        within = keyed if not level else keyed.filter(F.shiftrightunsigned("__hash", 64 - BITS * level) == prefix)
        # 2**16 counts at most
        for digit_value, count in sorted((r[0], r[1]) for r in within.groupBy(digit).count().collect()):
            if count >= left:
                prefix = (prefix << BITS) | digit_value
                break
            left -= count
        else:
            return rows
    last = prefix - 2**64 if prefix >> 63 else prefix
    bound = F.lit(last)
    equal = keyed.filter(F.col("__hash") == bound).orderBy(*tie).limit(left)
    below = F.col("__hash").bitwiseXOR(F.lit(-(2**63))) < bound.bitwiseXOR(F.lit(-(2**63)))
    return keyed.filter(below).unionByName(equal).drop("__hash")
