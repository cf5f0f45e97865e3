"""Loads, streams, reports, schemas, commands and the generator."""

import base64
import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tollgate.__main__ import main
from tollgate.contract import CURRENCIES, PURCHASE, REASONS, Settings
from tollgate.operators.generator import FAULTS, GeneratorConfig, fault_counts, generate
from tollgate.operators.ledger import events_deduplicated, registry_counts
from tollgate.plans import batch
from tollgate.plans.report import build_report, format_report
from tollgate.plans.schemas import json_schema, warehouse_columns, write_schemas
from tollgate.sinks import InsertOnlySink, JsonSink, ParquetSink, build_sink
from tollgate.sources import tables
from tollgate.sources.envelope import read_envelopes
from tollgate.sources.lines import file_digest, file_digests, read_lines
from tollgate.streaming import ingest, topic

REF = datetime(2026, 1, 15, tzinfo=UTC)
AS_OF = F.lit


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Lines and faults of 400 records at 25 %, and a file with them."""
    rows = generate(spark, GeneratorConfig(400, 0.25, 11, reference_time=REF)).orderBy("index").collect()
    path = tmp_path_factory.mktemp("lines") / "a.jsonl"
    path.write_text("".join(r.line + "\r\n" for r in rows) + "\n")
    return rows, str(path)


def test_generator(spark):
    config = GeneratorConfig(300, 0.3, 5, reference_time=REF)
    a = generate(spark, config)
    assert {r.fault: r.n for r in fault_counts(a).collect()} == {"valid": 210} | {k: 90 // 8 + (i < 90 % 8) for i, k in enumerate(sorted(FAULTS))}
    one, two = (generate(spark, config).repartition(n).orderBy("index").collect() for n in (1, 7))
    assert one == two
    assert one[0].fault is None
    ids = {json.loads(r.line).get("transaction_id"): r["index"] for r in one if r.fault is None}
    for r in one:
        if r.fault == "duplicate_transaction":
            assert ids[json.loads(r.line)["transaction_id"]] < r["index"]
    assert {reason for reason, _ in FAULTS.values()} | {"malformed_payload", "out_of_range", "schema_violation"} == set(REASONS)


@pytest.mark.parametrize("bad", [{"count": 0}, {"count": 10**8}, {"error_rate": 1.5}, {"seed": -1}, {"faults": ()}, {"faults": ("x",)}, {"reference_time": datetime(2026, 1, 1)}])
def test_generator_bounds(bad):
    with pytest.raises(ValueError):
        GeneratorConfig(**({"count": 5} | bad))


def test_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes(b"a\r\n\nb\rc\n  \nd")
    rows = read_lines(spark, str(tmp_path / "x.jsonl"))
    assert [bytes(r.value) for r in rows.orderBy("place").collect()] == [b"a", b"b\rc", b"  ", b"d"]
    digest = file_digest(spark, str(tmp_path / "x.jsonl"))
    assert file_digests(spark, str(tmp_path / "*.jsonl")).first().sha256 == digest


def test_loads(spark, made, tmp_path):
    rows, path = made
    root = str(tmp_path / "root")
    one = batch.load_file(spark, path, root, F.lit(REF))
    faults = [r.fault for r in rows if r.fault]
    assert (one.status, one.manifest["lines"], one.manifest["accepted"]) == ("loaded", 400, 300)
    assert one.manifest["quarantined"] == {k: faults.count(k) for k in sorted(set(faults))}
    assert batch.load_file(spark, path, root, F.lit(REF)).status == "skipped"
    good = [json.loads(r.line) for r in rows if r.fault is None]
    twin = good[1] | {"event_id": "00000000-0000-4000-8000-000000000000"}
    fresh = good[2] | {"transaction_id": "T-2026-999999"}
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(x, indent=None) for x in (good[0], twin, fresh)))
    # A load that broke off before its manifest leaves its part; it counts for nothing and is written over.
    sink = ParquetSink(root)
    with pytest.raises(RuntimeError):
        batch.load_file(spark, str(tmp_path / "b.jsonl"), root, F.lit(REF), Failing(sink))
    two = batch.load_file(spark, str(tmp_path / "b.jsonl"), root, F.lit(REF))
    assert (two.manifest["accepted"], two.manifest["replayed"], two.manifest["quarantined"]) == (1, 1, {"duplicate_transaction": 1})
    assert not batch.write_manifest(spark, root, two.manifest)
    report = build_report(spark, root)
    assert (report.events, report.distinct_transactions, sum(report.by_stage("batch").values())) == (301, 301, 101)
    assert "301 events of 301" in format_report(report) and "1 accepted" in batch.format_result(two)
    assert events_deduplicated(tables.events(spark, root)).count() == 301
    assert registry_counts(tables.events(spark, root), "transaction_id").first().duplicates == 0
    with pytest.raises(Exception):
        (tmp_path / "root" / "manifests" / "bad.json").write_text("{")
        tables.manifests(spark, root).collect()


def test_a_slower_load_of_the_same_file_counts_for_nothing(spark, made, tmp_path, monkeypatch):
    _, path = made
    root = str(tmp_path / "race")
    write = batch.write_manifest

    def late(*args):
        monkeypatch.setattr(batch, "write_manifest", write)
        assert batch.load_file(spark, path, root, F.lit(REF)).status == "loaded"  # another run is faster
        return write(*args)

    monkeypatch.setattr(batch, "write_manifest", late)
    slow = batch.load_file(spark, path, root, F.lit(REF))
    assert slow.status == "skipped" and slow.manifest["accepted"] == 300
    assert tables.events(spark, root).count() == 300 and tables.quarantine(spark, root).count() == 100
    assert len(list((tmp_path / "race" / "events").glob("part=*"))) == 1


def test_a_letter_that_fails_again_is_there_again(spark, tmp_path):
    root = str(tmp_path / "again")
    one = spark.createDataFrame([(bytearray(b"x"), "m1"), (bytearray(b"same"), None), (bytearray(b"same"), None)], "body binary, message_id string")
    for round_ in range(3):
        topic.append(topic.messages(one.withColumn("message_id", F.coalesce("message_id", F.sha2("body", 256)))), f"{root}/dead_letters")
        assert topic.dead_letters(spark, root).count() == 3 and topic.pull(spark, root, 2).count() == 2
        assert topic.redrive(spark, root, 3, 5) == 3
        assert topic.dead_letters(spark, root).count() == 0
    assert topic.read_topic(spark, root).count() == 9
    assert topic.purge(spark, root) == 0 and topic.purge(spark, root, days=-1) > 0 and topic.read_topic(spark, root).count() == 0


def test_amounts_are_text_at_every_depth(spark, made, tmp_path):
    from tollgate.operators.verdict import accepted, validate

    rows, _ = made
    lines = spark.createDataFrame([(bytearray(r.line.encode()),) for r in rows[:20]], "value binary")
    JsonSink(str(tmp_path / "j")).write_events(accepted(validate(lines, as_of=F.lit(REF)), ["stage"]), "a")
    one = json.loads(next((tmp_path / "j" / "events" / "part=a").glob("*.json")).read_text().splitlines()[0])
    assert isinstance(one["value"], str) and isinstance(one["items"][0]["price"], str) and isinstance(one["items"][0]["quantity"], int)


class Failing:
    """A sink that fails between its two writes."""

    def __init__(self, inner):
        self.inner = inner

    def write_events(self, rows, part):
        self.inner.write_events(rows, part)

    def write_rejected(self, rows, part):
        raise RuntimeError("the sink is down")


def test_publish_ingest_retry_redrive(spark, made, tmp_path):
    rows, path = made
    root = str(tmp_path / "stream")
    assert topic.setup(spark, root) == topic.setup(spark, root)
    sink = ParquetSink(root)
    told = topic.publish_lines(read_lines(spark, path), root, sink, F.lit(REF))
    assert (told["published"], sum(told["quarantined"].values())) == (300, 100)
    at = str(tmp_path / "checkpoint")
    start = lambda s: ingest.start(topic.stream_topic(spark, root), root, s, at, as_of=F.lit(REF))
    with pytest.raises(Exception):
        start(Failing(sink)).awaitTermination()
    query = ingest.supervise(lambda: start(sink), wait=lambda s: None)
    assert not ingest.healthy(query)
    assert tables.events(spark, root, "ingest").count() == 300
    # The same again is replayed, but for one that conflicts.
    one = json.loads(next(r.line for r in rows if r.fault is None))
    clash = json.dumps(one | {"customer_id": "other"})
    again = spark.createDataFrame([(bytearray(json.dumps(one).encode()), 1), (bytearray(clash.encode()), 2), (bytearray(b"{x"), 3)], "value binary, place int")
    topic.publish_lines(again, root, sink, validate=False)
    start(sink).awaitTermination()
    assert tables.events(spark, root, "ingest").count() == 300
    assert {r.reason: r.n for r in tables.quarantine(spark, root, "ingest").groupBy("reason").agg(F.count("*").alias("n")).collect()} == {"duplicate_transaction": 1, "malformed_payload": 1}
    dead = spark.createDataFrame([(bytearray(b"x"), "m1", {"a": "b"}), (bytearray(b"y"), "m2", {})], "body binary, message_id string, attributes map<string,string>")
    topic.append(topic.messages(dead), f"{root}/dead_letters")
    with pytest.raises(RuntimeError):
        topic.redrive(spark, root, 2, 5, lambda rows: (_ for _ in ()).throw(RuntimeError("no topic")))
    assert topic.redrive(spark, root, 2, 5) == 2
    assert topic.redrive(spark, root, 0, 1) == 0
    put = topic.read_topic(spark, root).filter("attributes['redriven'] = 'true'").collect()
    assert {r.message_id: r.attributes.get("a") for r in put} == {"m1": "b", "m2": None}
    with pytest.raises(TimeoutError):
        topic.redrive(spark, root, 3, 0.3)
    assert topic.expire(topic.read_topic(spark, root)).count() == topic.read_topic(spark, root).count()


def test_envelopes(spark, tmp_path):
    body = base64.b64encode(b"hello").decode()
    good = {"subscription": "s", "message": {"data": body, "messageId": "1", "publishTime": "2026-01-15T00:00:00Z", "attributes": {"k": "v"}, "other": 1}, "more": 2}
    snake = {"subscription": "s", "message": {"data": body, "message_id": "2", "publish_time": "2026-01-15T00:00:00Z"}}
    empty = {"subscription": "s", "message": {"messageId": "3", "publishTime": "2026-01-15T00:00:00Z"}}
    bad = [{"subscription": "s"}, {"message": good["message"]}, {"subscription": "s", "message": snake["message"] | {"data": "***"}}, {"subscription": "s", "message": {"data": body}}, "x"]
    bad[0] |= {"deliveryAttempt": 5}
    bad[2] |= {"delivery_attempt": 7}
    lines = [json.dumps(x) for x in [good, snake, empty, *bad]]
    got = [r for r in read_envelopes(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert [r.good for r in got] == [True] * 3 + [False] * 5
    assert bytes(got[1].body) == b"hello" and bytes(got[2].body) == b"" and got[0].attributes == {"k": "v"}
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("\n".join(lines))
    root = str(tmp_path / "root")
    ingest.start(ingest.memory_lines(spark, str(folder)), root, ParquetSink(root), str(tmp_path / "c"), envelopes=True).awaitTermination()
    assert tables.quarantine(spark, root, "ingest").count() == 3
    assert sorted(r.attempt for r in topic.dead_letters(spark, root).collect()) == [5, 7]
    assert [r.attempt for r in tables.read(spark, f"{root}/refused", topic.MESSAGE, deep=True).select("attempt").collect()] == [1, 1, 1]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2026, 1, 1, tzinfo=UTC), "batch", "missing_field", "0.1.0", None, "{}", [])], tables.QUARANTINE)
    sink = InsertOnlySink(str(tmp_path / "w"))
    sink.write_rejected(rows.unionByName(rows), "a")
    sink.write_rejected(rows, "b")
    assert tables.quarantine(spark, str(tmp_path / "w")).count() == 1
    sink = JsonSink(str(tmp_path / "j"))
    sink.write_rejected(rows, "a")
    sink.write_events(rows.limit(0), "a")
    assert not (tmp_path / "j" / "events").exists()
    from tollgate.plans.report import build_json_report

    assert build_json_report(spark, str(tmp_path / "j")).quarantine == [("batch", "missing_field", 1)]
    assert isinstance(build_sink(Settings(root="x")), ParquetSink)
    for bad in ({"sink": "nowhere"}, {"sink": "warehouse"}, {"port": 0}, {"stage": "x"}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert Settings.from_env({"TOLLGATE_PORT": "9", "TOLLGATE_SINK": "warehouse", "TOLLGATE_PROJECT": "p"}).port == 9


def test_schemas(tmp_path):
    columns = {c["name"]: c for c in warehouse_columns(PURCHASE.schema)}
    assert columns["value"] == {"name": "value", "type": "NUMERIC", "precision": "12", "scale": "2", "mode": "REQUIRED"}
    assert columns["items"]["mode"] == "REPEATED" and columns["items"]["type"] == "RECORD"
    assert columns["currency"]["description"] == "One of: " + ", ".join(CURRENCIES)
    assert [f["mode"] for f in columns["traffic_source"]["fields"]] == ["REQUIRED", "REQUIRED", "NULLABLE"]
    from pyspark.sql import types as T

    with pytest.raises(TypeError):
        warehouse_columns(T.StructType([T.StructField("x", T.BinaryType())]))
    assert [p.name for p in write_schemas(tmp_path)] == ["events.json", "quarantine.json"]
    schema = json_schema()
    assert {"transaction_id", "currency", "value", "items", "event_timestamp"} <= set(schema["required"]) and "shipping" not in schema["required"]
    assert schema["additionalProperties"] is False and set(schema["$defs"]) == {"Channel", "Currency", "LineItem", "TrafficSource"}
    assert schema["properties"]["items"] == {"type": "array", "items": {"$ref": "#/$defs/LineItem"}, "minItems": 1, "maxItems": 200}
    assert schema["properties"]["value"]["anyOf"][0]["exclusiveMinimum"] == 0.0
    assert "mismatch" not in str(schema)


def test_committed_schemas_and_version(tmp_path):
    import tomllib
    from pathlib import Path

    import tollgate
    from tollgate.contract import VERSION

    top = Path(tollgate.__file__).resolve().parent.parent
    for path in write_schemas(tmp_path):
        assert path.read_text() == (top / "schemas" / path.name).read_text()
    assert tomllib.loads((top / "pyproject.toml").read_text())["project"]["version"] == tollgate.__version__ == VERSION
    assert all(getattr(tollgate, name) is not None for name in tollgate.__all__)


def test_commands(spark, tmp_path, capsys):
    assert main(["gen", "-n", "0"]) == 2
    assert main(["gen", "-n", "x"]) == 2
    assert main(["gen", "-n", "20", "--error-rate", "0.5", "--seed", "3", "--faults", "missing_field, value_mismatch", "--reference-time", "2026-01-01T00:00:00+00:00", "-o", str(tmp_path / "g")]) == 0
    assert main(["schemas", "--output", str(tmp_path / "s")]) == 0
    (made,) = (tmp_path / "g").glob("part-*.txt")
    assert main(["load", str(made), "--root", str(tmp_path / "r")]) in (0, None)
    assert tables.manifests(spark, str(tmp_path / "r")).first().lines == 20
    assert main(["report", "--root", str(tmp_path / "r")]) == 0
    assert main(["redrive", "--root", str(tmp_path / "r"), "--expected", "1", "--timeout", "0.2"]) == 1
    assert "missing_field" in capsys.readouterr().err
