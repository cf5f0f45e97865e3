"""Ingestion: each micro-batch is judged against what earlier batches accepted, and written before its offsets commit.

The state is the history of accepted ids, whatever the sink; a batch reads only those of its files that may hold one of its
own ids. A batch that is retried sees only batches before it and overwrites its own parts, so rows are neither lost nor
doubled. (keyed.py has the state in Spark's state store instead.)
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tollgate.operators.verdict import accepted, accepted_ids, judged, parse, rejected
from tollgate.plans.report import summarise
from tollgate.sinks import Sink
from tollgate.sources import history, tables
from tollgate.sources.envelope import read_envelopes
from tollgate.streaming.topic import ATTEMPTS, messages


def part_of(batch_id: int) -> str:
    return f"batch-{batch_id:010d}"


def earlier(root: str, stage: str, parsed: DataFrame, batch_id: int) -> DataFrame:
    """transaction_id and fingerprint of what batches before this one accepted, of the ids in parsed."""
    spark = parsed.sparkSession
    if batch_id and not tables.exists(spark, f"{root}/ids_index") and tables.exists(spark, f"{root}/events"):
        found = tables.events(spark, root, stage).select("transaction_id", "fingerprint", "part")  # from before there was a history
    else:
        ids = parsed.filter("fingerprint is not null").select(F.col("transaction_id").alias("id"))
        found = history.lookup(spark, root, ids, counts=lambda parts: {p for p in parts if p.startswith("batch-") and p < part_of(batch_id)})
        found = found.filter(F.col("stage") == stage).select(F.col("id").alias("transaction_id"), F.col("digest").alias("fingerprint"), "part")
    return found.filter((F.col("part") < part_of(batch_id)) & F.col("part").startswith("batch-")).select("transaction_id", "fingerprint")


def handler(root: str, sink: Sink, stage: str = "ingest", as_of: Column | None = None, envelopes: bool = False) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls. Bad envelopes are refused: until their attempt number `ATTEMPTS` they go to `refused`, for the
    source to deliver again with the next number, and then to the dead letters."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, rows = batch.sparkSession, batch
        if envelopes:
            opened = read_envelopes(batch, "value").persist()
            bad = opened.filter(~F.col("good"))
            failed = messages(bad.select(F.col("value").alias("body"), F.coalesce("message_id", F.sha2(F.col("value").cast("binary"), 256)).alias("message_id"), "attributes", "attempt"))
            for name, which in (("dead_letters", F.col("attempt") >= ATTEMPTS), ("refused", F.col("attempt") < ATTEMPTS)):
                failed.filter(which).write.mode("overwrite").parquet(f"{root}/{name}/{part_of(batch_id)}")
            rows = opened.filter("good").select("body", "message_id", "publish_time")
            order = F.struct("publish_time", "message_id", F.monotonically_increasing_id().alias("row"))
        else:
            order = F.struct("published_at", "message_id", F.monotonically_increasing_id().alias("row"))
        # Files of messages are small for what they hold; dealt by size, no task holds a large part of a batch.
        dealt = rows.withColumn("arrival", order).hint("rebalance", "arrival")
        parsed = parse(dealt, "body", as_of).select("arrival", "raw_payload", "transaction_id", "event", "fingerprint", "issues").persist()
        try:
            verdicts = judged(parsed, stage, earlier(root, stage, parsed, batch_id), order_col="arrival").persist()
            sink.write_events(accepted(verdicts, ["stage"]), part_of(batch_id))
            sink.write_rejected(rejected(verdicts), part_of(batch_id))
            history.remember(accepted_ids(verdicts), root, part_of(batch_id))
            summarise(verdicts, root, part_of(batch_id))
            verdicts.unpersist()
        finally:
            parsed.unpersist()
            if envelopes:
                opened.unpersist()

    return handle


def start(stream: DataFrame, root: str, sink: Sink, checkpoint: str, stage: str = "ingest", as_of: Column | None = None, envelopes: bool = False, available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handler(root, sink, stage, as_of, envelopes)).option("checkpointLocation", checkpoint).queryName(f"tollgate-{stage}")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def healthy(query: StreamingQuery) -> bool:
    return query.isActive and query.exception() is None


def supervise(run: Callable[[], StreamingQuery], attempts: int = ATTEMPTS, shortest_s: float = 10, longest_s: float = 600, wait: Callable[[float], None] = time.sleep) -> StreamingQuery:
    """Run a query to its end, again after failures, waiting twice as long each time."""
    for k in range(attempts):
        try:
            query = run()
            query.awaitTermination()
            return query
        except Exception:
            if k + 1 == attempts:
                raise
            wait(min(longest_s, shortest_s * 2**k))
    raise ValueError("attempts must be 1 or more")


def memory_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the text files of a folder, one envelope a line."""
    return spark.readStream.text(folder)
