"""Every query that has SQL against DuckDB on the smallest tables."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    return sorted(tuple(str(float(v) if isinstance(v, decimal.Decimal) else v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.own.ORACLES))
def test_query(spark, sql, name):
    got = entry.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = sql.execute(f"SELECT {', '.join(names)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert plain(got.select(*names).collect()) == plain(want)


def test_ids_of_more_than_six_places(spark, tmp_path):
    rows = spark.range(999_990, 1_000_020).withColumnRenamed("id", "event_id")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(f"SELECT event_id, transaction_id FROM ({entry.oracle_sql()['transaction_id_extract']})").fetchall()
    assert plain(entry.queries()["transaction_id_extract"](spark, str(tmp_path)).select("event_id", "transaction_id").collect()) == plain(want)


def test_no_batch_of_a_stream_is_one_task(spark, tmp_path, monkeypatch):
    for k in range(4):
        spark.range(k * 50, k * 50 + 50, 1, 1).withColumnRenamed("id", "o_orderkey").write.mode("append").parquet(str(tmp_path / "orders.parquet"))
    dealt, append = [], entry.own.topic.append
    monkeypatch.setattr(entry.own.topic, "append", lambda rows, path: (dealt.append(rows.rdd.getNumPartitions()), append(rows, path)))
    got = entry.queries()["stream_dedup_ingest"](spark, str(tmp_path))
    assert {r.kind: r.n for r in got.collect()} == {"accepted": 200, "duplicate_transaction": 25}
    assert len(dealt) == 3 and min(dealt) > 1


def test_ledger_by_columns_made_of_others(spark):
    ledger = entry.own.ledger
    rows = spark.createDataFrame([("a", 1, 7), ("a", 2, 7), ("a", 3, 8), ("b", 4, 9), ("b", 5, 7), (None, 6, 7)], "id string, at int, d int")
    told = ledger.classify(rows, "id", ledger.F.col("d").cast("string"), ledger.F.struct("at"))
    assert told.columns == ["id", "at", "d", "seen"]
    assert [r.seen for r in told.orderBy("at").collect()] == ["new", "replay", "duplicate", "new", "duplicate", None]
    seen = spark.createDataFrame([("b", "7")], "id string, digest string")
    again = ledger.classify(rows, "id", ledger.F.col("d").cast("string"), ledger.F.struct("at"), seen)
    assert [r.seen for r in again.orderBy("at").collect()] == ["new", "replay", "duplicate", "duplicate", "replay", None]


def test_inserted_ids_are_counted_by_a_number_of_tasks(spark, tmp_path):
    orders = spark.range(30).selectExpr("id o_orderkey", "id o_custkey", "'F' o_orderstatus", "10.5D o_totalprice", "timestamp_ntz'1995-01-01 00:00:00' o_orderdate", "'1-URGENT' o_orderpriority")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    got = entry.queries()["inserts_by_row_id"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("batch-0", 15, 15), ("batch-1", 5, 5), ("batch-2", 2, 2)]
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
