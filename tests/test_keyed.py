import time
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tollgate.functions.payload import lone_surrogate
from tollgate.operators.verdict import accepted, validate
from tollgate.queries import PURCHASE_TEXT
from tollgate.sinks import JsonSink, ParquetSink
from tollgate.sources import tables
from tollgate.streaming import keyed, topic
from tollgate.streaming.metrics import watch

REF = datetime(2026, 1, 15, tzinfo=UTC)


def batch(spark, rows):
    """Messages: (transaction number, currency) with broken texts where the number is None."""
    made = [(PURCHASE_TEXT.replace("%012d", f"{n:012d}").replace("%06d", f"{n:06d}").replace("PLN", c) if n is not None else "{broken", f"m{k:05d}") for k, (n, c) in enumerate(rows)]
    return topic.messages(spark.createDataFrame(made, "body string, message_id string").coalesce(1))


def run(spark, root, sink, **more):
    query = keyed.start(topic.stream_topic(spark, root, 1), sink, f"{root}/checkpoint", as_of=F.lit(REF), **more)
    query.awaitTermination()
    return query


BATCHES = [[(1, "PLN"), (2, "PLN"), (1, "PLN"), (1, "EUR"), (None, "")], [(2, "PLN"), (2, "EUR"), (3, "EUR"), (3, "PLN")], [(3, "EUR"), (3, "PLN"), (4, "PLN"), (None, ""), (50, "PLN")]]


def test_keyed_ledger_over_batches_and_restarts(spark, tmp_path):
    root = f"file://{tmp_path}"
    sink = ParquetSink(root)
    known = spark.createDataFrame([("T-000050", "another content")], "transaction_id string, fingerprint string")
    sheet = watch(spark)
    for rows in BATCHES:  # each run restarts from the checkpoint
        topic.append(batch(spark, rows), f"{root}/topic")
        query = run(spark, root, sink, known=known)
    lines = spark.createDataFrame([(r[0].body.decode(), k) for k, r in enumerate((m,) for rows in BATCHES for m in batch(spark, rows).orderBy("message_id").collect())], "value string, at long")
    want = validate(lines, stage="ingest", accepted=known, as_of=F.lit(REF), order_col="at")
    stored = tables.events(spark, root, "ingest")
    assert sorted(map(str, stored.select("transaction_id", "fingerprint", "currency", "event_timestamp").collect())) == sorted(map(str, accepted(want).select("transaction_id", "fingerprint", "currency", "event_timestamp").collect()))
    reasons = lambda df: sorted((r.reason, r.transaction_id or "") for r in df.collect())
    assert reasons(tables.quarantine(spark, root, "ingest")) == reasons(want.filter("verdict = 'rejected'"))
    for _ in range(50):
        if sheet.health(query) == "ended":
            break
        time.sleep(0.1)
    spark.streams.removeListener(sheet)
    assert sheet.health(query) == "ended" and sheet.rate(query) > 0
    assert sheet.of(query).rows == 5 and sheet.of(query).observed == {"records.lines": 5, "records.broken": 1, "records.known": 3}


def test_json_sink_takes_many_batches(spark, tmp_path):
    root = f"file://{tmp_path}"
    for rows in BATCHES:
        topic.append(batch(spark, rows), f"{root}/topic")
    run(spark, root, JsonSink(root))
    assert spark.read.json(f"{root}/events").count() == 5


def test_health_of_failed_and_stalled_streams(spark, tmp_path):
    now = [0.0]
    sheet = watch(spark, lambda: now[0])
    slow = spark.readStream.format("rate").load().writeStream.format("noop").trigger(processingTime="1 hour").option("checkpointLocation", f"file://{tmp_path}/a").start()
    bad = spark.readStream.format("rate").load().select(F.raise_error(F.lit("broken")).alias("x")).writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/b").start()
    with pytest.raises(Exception, match="broken"):
        bad.awaitTermination(30)
    for _ in range(100):
        if sheet.health(bad) == "failed":
            break
        time.sleep(0.1)
    assert sheet.health(bad) == "failed" and "broken" in sheet.of(bad).error
    assert sheet.health(slow) == "running" and sheet.health("none") == "unknown"
    now[0] = 1000.0
    assert sheet.health(slow) == "stalled"
    slow.stop()
    spark.streams.removeListener(sheet)


def test_half_characters_are_malformed(spark):
    cases = {r'"\ud800"': True, r'"😀"': False, r'"\udc00\ud800"': True, r'"\\ud800"': False, r'"\\\ud800"': True, '"x"': False, r'"😀\uDE00"': True}
    rows = spark.createDataFrame(list(cases.items()), "t string, want boolean")
    assert rows.filter(lone_surrogate(F.col("t")) != F.col("want")).count() == 0


class Kept:
    """A state as the ledger calls it, with the number of calls."""

    def __init__(self):
        self.map, self.value, self.calls = {}, None, 0

    def __getattr__(self, name):
        self.calls += 1
        return {"exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v), "getValue": lambda k: self.map[k], "updateValue": self.map.__setitem__, "iterator": lambda: iter(list(self.map.items()))}[name]


def test_a_call_to_the_state_is_for_many_ids(spark):
    import pandas as pd

    ledger = keyed.FirstDigests()
    ledger.first, ledger.size = Kept(), Kept()
    seen: dict[str, str] = {}
    for n, ids in enumerate([range(3000), range(2990, 3010), range(0, 9000, 3), [5, 5, 100_000], range(20_000)]):
        rows = pd.DataFrame([(f"{k:06d}", "raw", f"T-{i}\n\"", "{}", f"f{i}-{n}", "[]") for k, i in enumerate(ids)], columns=keyed.ROW.names[:-1])
        got = pd.concat(ledger.handleInputRows(("1",), iter([rows[:1000], rows[1000:]]), None))
        assert got["before"].where(got["before"].notna(), None).tolist() == [seen.get(i) for i in rows["transaction_id"]]
        for i, f in zip(rows["transaction_id"], rows["fingerprint"]):
            seen.setdefault(i, f)
        if n == 0:
            assert ledger.first.calls + ledger.size.calls < 3000 / 30
    assert len(seen) == ledger.size.value[0] == 20_001
    assert max(len(text) for (text,) in ledger.first.map.values()) < 30 * 4 * keyed.PAGE_IDS


def test_batches_are_dealt_before_they_are_parsed(spark, tmp_path):
    root = f"file://{tmp_path}"
    topic.append(batch(spark, [(n, "PLN") for n in range(100)]), f"{root}/topic")
    query = run(spark, root, ParquetSink(root))
    plan = query._jsq.streamingQuery().lastExecution().executedPlan().toString() if hasattr(query._jsq, "streamingQuery") else query._jsq.lastExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and tables.events(spark, root).count() == 100
