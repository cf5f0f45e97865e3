"""Ingestion with the ledger in keyed state: what an id was first accepted with is held by Spark's state store.

A batch costs what its own rows cost, however much was accepted before: no earlier event is read. The state is a map
of pages of transaction ids for each hash bucket, kept in RocksDB and in the checkpoint, and may start from the events that
a table already has. (Checkpoints from before pages were compressed can't go on; Spark refuses them.) Only the state before the batch comes from it; which of a batch's rows of an id is the first is found as in
batch mode, so the verdicts are the same, and an id that holds a third of a batch streams through its task without being
gathered. The state tells ids that a batch repeats: while they are few, the batch's rows are judged where they are, else
they are shuffled.

The state of a batch is committed after foreachBatch has written its rows. A batch that fails is repeated from the state
before it and overwrites its own parts, so rows are neither lost nor doubled.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tollgate.contract import ISSUE, PURCHASE
from tollgate.operators.verdict import accepted, judged, parse, rejected
from tollgate.shared import drop, written
from tollgate.sinks import Sink

#: Settings of the stream. Shuffle files go once the step that made them has ended: they would pile up over the batches.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
#: Buckets that ids are dealt to by hash; a state keeps the number that it began with.
BUCKETS = 2048
#: Most ids of a page, on average.
PAGE_IDS = 64
#: Most ids repeated in a batch that are broadcast.
REPEATED = 100_000
ROW = T.StructType([T.StructField(n, T.StringType()) for n in ("arrival", "raw_payload", "transaction_id", "event", "fingerprint", "issues", "before")])
#: again: the row is of an id that is new to the ledger and that the batch had before.
TOLD = T.StructType([*ROW.fields, T.StructField("again", T.BooleanType())])
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


class FirstDigests(StatefulProcessor):
    """Each row with the fingerprint that its id had before the batch; the batch's first is remembered if there is none.

    The ids of a bucket lie on pages by their hash, as a call to the state costs far more than an id: a batch reads the pages of
    its ids, and a bucket that has outgrown its pages gets twice as many or more. A bucket's rows go through in frames.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", "page long", "ids binary")
        self.size = handle.getValueState("size", "ids long, pages long")

    def sizes(self) -> tuple[int, int]:
        """Ids and pages of the bucket."""
        return tuple(self.size.get()) if self.size.exists() else (0, 0)

    def read(self, ids: Iterable[str], pages: int, held: dict[int, dict[str, str]]) -> None:
        """Put the pages of ids into held."""
        for page in {page_of(i, pages) for i in ids} - held.keys() if pages else ():
            held[page] = unpacked(self.first.getValue((page,))[0])

    def remember(self, new: dict[str, str], ids: int, pages: int, held: dict[int, dict[str, str]]) -> None:
        """Add ids that are on none of their pages, which held has."""
        ids += len(new)
        wanted = 1 << max(0, ceil(ids / PAGE_IDS) - 1).bit_length()
        if wanted > pages:
            old = [unpacked(ids) for _, (ids,) in self.first.iterator()] if pages else []
            pages, held = wanted, {k: {} for k in range(wanted)}
            for i, fingerprint in (x for page in old for x in page.items()):
                held[page_of(i, pages)][i] = fingerprint
            changed = set(held)
        else:
            changed = {page_of(i, pages) for i in new}
        for i, fingerprint in new.items():
            held[page_of(i, pages)][i] = fingerprint
        for page in changed:
            self.first.updateValue((page,), (packed(held[page]),))
        self.size.update((ids, pages))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        (ids, pages), held = self.sizes(), {}
        self.read(initialState["id"], pages, held)
        self.remember(dict(zip(initialState["id"], initialState["fingerprint"], strict=True)), ids, pages, held)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        (ids, pages), held = self.sizes(), {}
        before: dict[str, str | None] = {}
        least: dict[str, tuple[str, str]] = {}
        for part in rows:
            counts = part["fingerprint"].notna() & part["transaction_id"].notna()
            again = counts & (part["transaction_id"].isin(before) | part["transaction_id"].where(counts).duplicated())
            clean = part[counts].sort_values("arrival").drop_duplicates("transaction_id")
            self.read(clean["transaction_id"], pages, held)
            for i, arrival, fingerprint in zip(clean["transaction_id"], clean["arrival"], clean["fingerprint"], strict=True):
                if i not in before:
                    before[i] = held[page_of(i, pages)].get(i) if pages else None
                if before[i] is None:
                    least[i] = min(least.get(i, (arrival, fingerprint)), (arrival, fingerprint))
            known = [before.get(i) if f is not None else None for i, f in zip(part["transaction_id"], part["fingerprint"], strict=True)]
            known = pd.Series(known, index=part.index, dtype=object)
            yield part[ROW.names[:-1]].assign(before=known, again=again & known.isna())
        if least:
            self.remember({i: fingerprint for i, (_, fingerprint) in least.items()}, ids, pages, held)

    def close(self) -> None:
        pass


def packed(ids: dict[str, str]) -> bytes:
    return zlib.compress(json.dumps(ids).encode(), 1)


def unpacked(page: bytes) -> dict[str, str]:
    return json.loads(zlib.decompress(page))


def page_of(text: str, pages: int) -> int:
    """The page of an id; pages is a power of two."""
    return zlib.crc32(text.encode()) & (pages - 1)


def arrivals(published: Column, message_id: Column, body: Column) -> Column:
    """A text that sorts as messages came: by time, then message, then content."""
    when = F.lpad(F.unix_micros(F.coalesce(published, F.timestamp_seconds(F.lit(0)))).cast("string"), 20, "0")
    return F.concat_ws("|", when, F.coalesce(message_id, F.lit("")), F.hex(F.xxhash64(body)))


def bucket(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(BUCKETS)).cast("string")


def with_state(messages: DataFrame, as_of: Column | None = None, known: DataFrame | None = None, body: str = "body", published: str = "published_at") -> DataFrame:
    """A stream of messages, parsed, with before: the fingerprint of the id before the batch.

    known: transaction_id and fingerprint, ids unique, of what was accepted before the stream's first batch.
    """
    told = messages.withColumn("arrival", arrivals(F.col(published), F.col("message_id"), F.col(body)))
    # Dealt before it is parsed, as files of messages are small for what they hold, and few.
    dealt = told.repartition(int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "arrival")
    rows = parse(dealt, body, as_of).select("arrival", "raw_payload", "transaction_id", "event", "fingerprint", "issues")
    # Rows that reserve no id go to any bucket.
    reserves = F.col("fingerprint").isNotNull() & F.col("transaction_id").isNotNull()
    key = bucket(F.when(reserves, F.col("transaction_id")).otherwise(F.concat("arrival", F.coalesce("raw_payload", F.lit("")))))
    flat = [F.to_json(c, TIMES).alias(c) if c in ("event", "issues") else c for c in ROW.names[:-1]]
    start = None if known is None else known.select(bucket(F.col("transaction_id")).alias("key"), F.col("transaction_id").alias("id"), "fingerprint").groupBy("key")
    out = rows.withColumn("key", key).select("key", *flat).groupBy("key").transformWithStateInPandas(FirstDigests(), TOLD, "append", "none", start)
    event = F.from_json("event", PURCHASE.schema, TIMES)
    issues = F.from_json("issues", T.ArrayType(ISSUE), TIMES)
    return out.withColumns({"event": event, "issues": F.coalesce(issues, F.array().cast(T.ArrayType(ISSUE)))})


def start(stream: DataFrame, sink: Sink, checkpoint: str, stage: str = "ingest", as_of: Column | None = None, known: DataFrame | None = None, available_now: bool = True, published: str = "published_at") -> StreamingQuery:
    """Ingest a stream of messages (body, message_id, published_at), the ledger in keyed state. Its counts are observed."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()  # the state is passed once
        try:
            repeated = rows.filter("again").select("transaction_id").distinct()
            few = repeated.limit(REPEATED + 1).count() <= REPEATED
            verdicts = judged(rows, stage, order_col="arrival", before=F.col("before"), repeated=repeated if few else None)
            if not few:  # what is shuffled is written once; else it is made anew from rows
                verdicts = written(verdicts, "verdicts")
            sink.write_events(accepted(verdicts, ["stage"]), f"batch-{batch_id:010d}")
            sink.write_rejected(rejected(verdicts), f"batch-{batch_id:010d}")
            if not few:
                drop(verdicts)
        finally:
            rows.unpersist()

    spark = stream.sparkSession
    clean = F.size("issues") == 0
    rows = with_state(stream, as_of, known, published=published)
    rows = rows.observe("records", F.count(F.lit(1)).alias("lines"), F.count_if(~clean).alias("broken"), F.count_if(F.col("before").isNotNull()).alias("known"))
    writer = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).queryName(f"tollgate-keyed-{stage}").outputMode("append")
    had = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():  # a query keeps the settings that it starts with
        spark.conf.set(k, v)
    try:
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        for k, v in had.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
