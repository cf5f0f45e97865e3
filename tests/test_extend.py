"""Kinds of fields and of faults from outside the package, loads at once, and the report from sketches."""

from datetime import UTC, datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate import FAULTS, KINDS, Contract, Fault, Field, GeneratorConfig, Kind, generate, validate
from tollgate.functions.native import check_typed
from tollgate.plans.batch import load_file
from tollgate.plans.report import build_report, estimated_report
from tollgate.sinks import ParquetSink
from tollgate.sources import tables

REF = datetime(2026, 1, 15, tzinfo=UTC)


def test_a_kind_from_outside(spark, monkeypatch):
    broken = lambda f, text, of: [(of != "STRING", "string_type", "A postcode is text"), (~text.rlike(r"^[0-9]{2}-[0-9]{3}\z"), "postcode_parsing", "No postcode")]
    monkeypatch.setitem(KINDS, "postcode", Kind(broken, lambda f, text: F.regexp_replace(text, "-", "").cast("int"), T.IntegerType()))
    contract = Contract(fields=(Field("code", "postcode"), Field("old", "postcode", has_default=True, nullable=True)))
    rows = spark.createDataFrame([('{"code":"12-345"}',), ('{"code":"12345"}',), ('{"code":7}',), ('{"code":"00-001","old":null}',), ("{}",)], "value string")
    found = validate(rows, contract=contract, as_of=F.lit(REF))
    assert [[i.error_type for i in r.issues] for r in found.collect()] == [[], ["postcode_parsing"], ["string_type"], [], ["missing"]]
    assert [r.event and r.event.code for r in found.collect()] == [12345, None, None, 1, None]
    typed = check_typed(spark.createDataFrame([("12-345",), ("x",)], "code string"), contract)
    assert [[i.error_type for i in r.issues] for r in typed.collect()] == [[], ["postcode_parsing"]] and typed.first().event.code == 12345
    assert contract.schema["code"].dataType == T.IntegerType()


def test_a_fault_from_outside(spark, monkeypatch):
    monkeypatch.setitem(FAULTS, "cut", Fault("malformed_payload", "the line is cut", lambda line, event: F.substring(line, 1, 40)))
    config = GeneratorConfig(60, 0.5, 3, faults=("cut", "missing_field"), reference_time=REF)
    rows = generate(spark, config).withColumnRenamed("line", "value")
    got = {(r.fault, r.reason): r["count"] for r in validate(rows, as_of=F.lit(REF)).groupBy("fault", "reason").count().collect()}
    assert got == {("cut", "malformed_payload"): 15, ("missing_field", "missing_field"): 15, (None, None): 30}


def test_loads_at_once_accept_each_id_once(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    lines = [r.line for r in generate(spark, GeneratorConfig(60, 0.0, 4, reference_time=REF)).orderBy("index").collect()]
    (tmp_path / "a.txt").write_text("\n".join(lines[:40]))
    (tmp_path / "b.txt").write_text("\n".join(lines[20:]))

    class Late(ParquetSink):
        """Another load begins and ends while this one writes."""

        def write_events(self, rows, part):
            if not tables.exists(spark, f"{root}/manifests/*.json"):
                assert load_file(spark, f"{tmp_path}/b.txt", root, F.lit(REF)).manifest["accepted"] == 40
            super().write_events(rows, part)

    first = load_file(spark, f"{tmp_path}/a.txt", root, F.lit(REF), Late(root))
    assert (first.status, first.manifest["accepted"], first.manifest["replayed"]) == ("loaded", 20, 20)
    assert tables.events(spark, root).count() == tables.events(spark, root).select("transaction_id").distinct().count() == 60
    assert load_file(spark, f"{tmp_path}/a.txt", root, F.lit(REF)).status == "skipped"
    # a claim whose manifest never came is put in place by the next load
    (tmp_path / "root/manifests" / f"{first.manifest['load_id']}.json").unlink()
    (tmp_path / "c.txt").write_text("\n".join(lines[:5]))
    third = load_file(spark, f"{tmp_path}/c.txt", root, F.lit(REF))
    assert (third.manifest["accepted"], third.manifest["replayed"]) == (0, 5) and tables.manifests(spark, root).count() == 3
    exact, near = build_report(spark, root), estimated_report(spark, root)
    assert near.events == exact.events == 60 and abs(near.distinct_transactions - 60) <= 2 and near.quarantine == exact.quarantine


def test_sketches_are_near(spark, tmp_path):
    from tollgate.plans.report import summarise

    root = f"file://{tmp_path}"
    for k in range(3):
        rows = spark.range(20_000).select(F.concat(F.lit("T-"), (F.col("id") + 10_000 * k).cast("string")).alias("transaction_id"), F.lit("accepted").alias("verdict"), F.lit(None).cast("string").alias("reason"), F.lit("ingest").alias("stage"))
        summarise(rows, root, f"batch-{k}")
    near = estimated_report(spark, root)
    assert near.events == 60_000 and abs(near.distinct_transactions - 40_000) < 800
