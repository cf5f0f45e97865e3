"""New, replayed or duplicate: what each record is among those with its id, first come first kept.

The first record of an id is found by a partial aggregate and joined back, so an id that holds a third of all rows costs
a row per task and a join that can be split, and no window gathers it in one place. Numbers of repeats are prefix counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.operators.ordinals import numbered


def classify(rows: DataFrame, id_col: str, digest_col: str | Column, order_col: str | Column, seen: DataFrame | None = None, result: str = "seen", where: Column | None = None, before: Column | None = None, repeated: DataFrame | None = None) -> DataFrame:
    """rows with result: new for an id's first record, replay for an equal digest, duplicate for another.

    seen: id_col and digest_col ("digest" if that is no name) of earlier records, ids unique; or before: the digest that each row's
    id had, if it had one. order_col is unique. digest_col and order_col may be made of columns of rows: they are then made anew
    after the join and don't move with the rows. repeated: the distinct ids (id_col) of all that come more than once without an
    earlier digest, few enough to be broadcast; rows of other ids are then first of theirs, and none move. Rows that where excludes, and those without an id, get NULL and reserve nothing.
    """
    digest, order = (F.col(c) if isinstance(c, str) else c for c in (digest_col, order_col))
    seen_digest = digest_col if isinstance(digest_col, str) else "digest"
    counted = F.col(id_col).isNotNull() & (F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
    several = rows if repeated is None else rows.join(F.broadcast(repeated), id_col, "left_semi")
    firsts = several.groupBy(F.col(id_col).alias("__id")).agg(F.min(F.when(counted, F.struct(order.alias("at"), digest.alias("digest")))).alias("__first"))
    out = rows.join(firsts if repeated is None else F.broadcast(firsts), F.col(id_col) == F.col("__id"), "left")
    if seen is not None:
        out = out.join(seen.select(F.col(id_col).alias("__seen_id"), F.col(seen_digest).alias("__digest")), F.col(id_col) == F.col("__seen_id"), "left")
    else:
        out = out.withColumn("__seen_id", F.lit(None).cast("string")).withColumn("__digest", F.lit(None).cast("string"))
    earlier = F.col("__digest") if before is None else F.coalesce("__digest", before)
    before = F.coalesce(earlier, F.col("__first.digest"))
    is_first = earlier.isNull() & F.col("__seen_id").isNull() & (F.col("__first.at") == order if repeated is None else F.coalesce(F.col("__first.at") == order, F.lit(True)))
    kind = F.when(is_first, "new").when(before == digest, "replay").otherwise("duplicate")
    return out.withColumn(result, F.when(counted, kind)).drop("__id", "__first", "__seen_id", "__digest")


def repeats(rows: DataFrame, id_col: str, *order: str, result: str = "repeat") -> DataFrame:
    """rows with the number of earlier rows of the same id."""
    return numbered(rows, [id_col], list(order), result)


def registry_counts(rows: DataFrame, id_col: str) -> DataFrame:
    """seen (distinct ids) and duplicates (rows beyond the first of their id)."""
    ids = rows.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n"))
    return ids.agg(F.count("*").alias("seen"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def known(rows: DataFrame, id_col: str, seen: DataFrame) -> DataFrame:
    """rows whose id is in seen."""
    return rows.join(seen.select(id_col).distinct(), id_col, "left_semi")


def unknown(rows: DataFrame, id_col: str, seen: DataFrame) -> DataFrame:
    """rows whose id is not in seen: what a merge on the id would insert."""
    return rows.join(seen.select(id_col).distinct(), id_col, "left_anti")


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the least by order. An aggregate with partial results, not a window: one row per key and task moves."""
    rest = [c for c in rows.columns if c not in key]
    picked = F.min_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*key).agg(picked.alias("__row")).select(*[F.col(c) if c in key else F.col(f"__row.{c}").alias(c) for c in rows.columns])


def events_deduplicated(events: DataFrame) -> DataFrame:
    """The view on events: the earliest of each transaction, by time and then id."""
    return first_per_key(events, ["transaction_id"], ["event_timestamp", "event_id"])
