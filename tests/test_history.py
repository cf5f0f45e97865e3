import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tollgate.queries import PURCHASE_TEXT
from tollgate.sinks import InsertError, InsertOnlySink
from tollgate.sources import history, tables


def ids(spark, names):
    return spark.createDataFrame([(n, f"d-{n}", "batch") for n in names], "id string, digest string, stage string")


def test_lookup_reads_few_files_and_misses_nothing(spark, tmp_path):
    root = f"file://{tmp_path}"
    for k in range(12):
        history.remember(ids(spark, [f"T-{k}-{i}" for i in range(40 * (k + 1))]), root, f"p{k}", file_ids=100)
    asked = ids(spark, ["T-3-7", "T-11-0", "T-11-479", "none", None]).select("id")
    where = history.files(spark, root, asked)
    every = spark.read.parquet(f"{root}/ids").select("part", "range").distinct().count()
    assert {"p3", "p11"} <= {p for p, _ in where} and len(where) <= 5 < every
    got = history.lookup(spark, root, asked)
    assert sorted((r.id, r.digest, r.part) for r in got.collect()) == [("T-11-0", "d-T-11-0", "p11"), ("T-11-479", "d-T-11-479", "p11"), ("T-3-7", "d-T-3-7", "p3")]
    assert {r.part for r in history.lookup(spark, root, asked, counts=lambda parts: parts & {"p3"}).collect()} == {"p3"}
    history.remember(ids(spark, ["new"]), root, "p3")  # a part again: its old ids are gone
    assert history.lookup(spark, root, asked).filter("part = 'p3'").count() == 0
    assert history.compact(spark, root) == 13 and history.compact(spark, root) == 1
    assert history.lookup(spark, root, asked).count() == 2
    assert history.lookup(spark, root, ids(spark, ["new"]).select("id")).first().part == "p3"


def test_lookup_of_everything_and_of_nothing(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    assert history.lookup(spark, root, ids(spark, ["a"])).count() == 0
    history.remember(ids(spark, []), root, "empty")
    names = [f"n{random.Random(5).random()}-{k}" for k in range(500)]
    history.remember(ids(spark, names), root, "p", file_ids=20)
    assert history.lookup(spark, root, ids(spark, names)).count() == 500
    monkeypatch.setattr(history, "MOST_FILES", 3)  # too many to be named one by one
    assert history.lookup(spark, root, ids(spark, names)).count() == 500
    assert history.lookup(spark, root, ids(spark, names), counts=lambda parts: set()).count() == 0


def test_bits_are_those_of_the_bitmap(spark):
    rows = spark.range(300).select((F.pmod(F.xxhash64("id"), F.lit(32_768))).alias("bit"))
    one = rows.agg(F.bitmap_construct_agg("bit").alias("bits"))
    got = spark.range(32_768).crossJoin(F.broadcast(one)).filter(history.has_bit(F.col("bits"), F.col("id").cast("int"))).select("id")
    assert {r.id for r in got.collect()} == {r.bit for r in rows.collect()}


def test_inserts_by_row_id(spark, tmp_path):
    root = f"file://{tmp_path}"
    sink = InsertOnlySink(root)
    broken = lambda texts: spark.createDataFrame([(datetime(2026, 1, 1, tzinfo=UTC), "batch", "malformed_payload", "0.1.0", None, t, []) for t in texts], tables.QUARANTINE)
    sink.write_rejected(broken(["a", "b", "b"]), "batch-1")
    sink.write_rejected(broken(["b", "c"]), "batch-2")
    sink.write_rejected(broken(["b", "c"]), "batch-2")  # a retry replaces its own rows
    assert sorted(r.raw_payload for r in tables.quarantine(spark, root).collect()) == ["a", "b", "c"]


def test_refused_inserts_name_the_first_three(spark, tmp_path):
    sink = InsertOnlySink(f"file://{tmp_path}")
    rows = spark.createDataFrame([(None, f"T-{k:06d}", None) for k in range(9)], "event_id string, transaction_id string, currency string")
    with pytest.raises(InsertError) as e:
        sink.write_events(rows, "batch-0")
    assert str(e.value).count("no event_id, currency") == 3


def test_names_of_folders_and_schemas_agree(spark, tmp_path):
    from tollgate.plans.batch import load_file
    from tollgate.plans.schemas import write_schemas

    (tmp_path / "in.txt").write_text("{broken\n" + PURCHASE_TEXT.replace("%012d", f"{1:012d}").replace("%06d", f"{1:06d}") + "\n")
    load_file(spark, f"{tmp_path}/in.txt", f"file://{tmp_path}/root", F.to_timestamp(F.lit("2026-01-15T00:00:00Z")))
    assert {p.name for p in (tmp_path / "root").iterdir()} == set(tables.FOLDERS)
    (tmp_path / "s").mkdir()
    assert {p.stem for p in write_schemas(tmp_path / "s")} == {"events", "quarantine"} <= set(tables.FOLDERS)
