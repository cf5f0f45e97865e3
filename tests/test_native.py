from datetime import UTC, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tollgate.functions.native import check_typed
from tollgate.operators.verdict import judged, parse

NOW = datetime(2026, 1, 15, tzinfo=UTC)
SCHEMA = """event_id string, transaction_id string, customer_id string, currency string, value decimal(14,4), shipping decimal(12,2), discount decimal(12,2),
items array<struct<item_id:string,item_name:string,price decimal(14,4),quantity bigint>>, event_timestamp timestamp,
traffic_source struct<source:string,medium:string,campaign:string>, contract_version string, coupon string""".replace("price decimal", "price:decimal")
GOOD = {
    "event_id": "00000000-0000-4000-8000-000000000001", "transaction_id": "T-000001", "customer_id": "C-1", "currency": "PLN", "value": Decimal("25.00"), "shipping": Decimal("5.00"), "discount": Decimal("0.00"),
    "items": [("A", "a", Decimal("10.00"), 2)], "event_timestamp": NOW - timedelta(hours=1), "traffic_source": ("s", "cpc", None), "contract_version": "0.1.0", "coupon": None,
}
CHANGES = [
    ({}, []),
    ({"shipping": None, "discount": None, "value": Decimal("20.00"), "contract_version": None}, []),
    ({"value": Decimal("26.00")}, [("", "value_mismatch")]),
    ({"value": Decimal("0.00")}, [("value", "greater_than")]),
    ({"value": Decimal("-1.50"), "currency": "XXX"}, [("currency", "enum"), ("value", "greater_than")]),
    ({"value": Decimal("25.001")}, [("value", "decimal_max_places")]),
    ({"shipping": Decimal("-5.00")}, [("shipping", "greater_than_equal")]),
    ({"items": []}, [("items", "too_short")]),
    ({"items": [("A", "a", Decimal("10.00"), 2)] * 201}, [("items", "too_long")]),
    ({"items": [("A", "a", Decimal("0.00"), 0), (None, "", Decimal("1.0001"), 10_001)]}, [("items.0.price", "greater_than"), ("items.0.quantity", "greater_than"), ("items.1.item_id", "missing"), ("items.1.item_name", "string_too_short"), ("items.1.price", "decimal_max_places"), ("items.1.quantity", "less_than_equal")]),
    ({"event_timestamp": NOW + timedelta(minutes=5, seconds=1)}, [("event_timestamp", "future_timestamp")]),
    ({"event_timestamp": NOW + timedelta(minutes=5)}, []),
    ({"traffic_source": ("s", "tv", "x" * 101)}, [("traffic_source.medium", "enum"), ("traffic_source.campaign", "string_too_long")]),
    ({"traffic_source": None, "currency": None}, [("currency", "missing"), ("traffic_source", "missing")]),
    ({"event_id": "nothing", "transaction_id": "-x", "coupon": "new"}, [("event_id", "uuid_parsing"), ("transaction_id", "string_too_short"), ("coupon", "extra_forbidden")]),
    ({"transaction_id": "bad id\n", "contract_version": "1"}, [("transaction_id", "string_pattern_mismatch"), ("contract_version", "string_pattern_mismatch")]),
]


@pytest.fixture(scope="module")
def typed(spark):
    rows = [tuple((GOOD | change).values()) + (k,) for k, (change, _) in enumerate(CHANGES)]
    return spark.createDataFrame(rows, SCHEMA + ", k long")


def codes(df):
    return {r.k: [(i.field_path, i.error_type) for i in r.issues] for r in df.collect()}


def test_typed_rows_have_the_issues_of_the_contract(typed):
    got = check_typed(typed, as_of=F.lit(NOW), keep=["k"])
    assert codes(got) == {k: want for k, (_, want) in enumerate(CHANGES)}
    row = got.filter("k = 1").first()
    assert (row.event.shipping, row.event.contract_version, row.transaction_id) == (Decimal("0.00"), "0.1.0", "T-000001")


def test_typed_rows_and_json_agree(spark, typed):
    got = check_typed(typed, as_of=F.lit(NOW), keep=["k"])
    again = parse(got.select("k", F.col("raw_payload").alias("value")), as_of=F.lit(NOW))
    assert codes(again) == codes(got)
    prints = lambda df: {r.k: r.fingerprint for r in df.collect()}
    assert prints(again) == prints(got)
    verdicts = {r.k: (r.verdict, r.reason) for r in judged(got, "source", order_col="k").collect()}
    assert verdicts[0] == ("accepted", None) and verdicts[2] == ("rejected", "value_mismatch") and verdicts[11] == ("rejected", "duplicate_transaction")


def test_columns_of_other_types_break_the_contract(typed):
    as_text = typed.select("k", *[F.col(c).cast("string").alias(c) if c in ("value", "event_timestamp") else F.col(c) for c in typed.columns if c != "k"])
    assert codes(check_typed(as_text.filter("k = 0"), as_of=F.lit(NOW), keep=["k"]))[0] == [("value", "decimal_type"), ("event_timestamp", "datetime_type")]
    odd = typed.filter("k = 0").select("k", "event_id", "transaction_id", F.lit(7).alias("customer_id"), F.lit(True).alias("currency"), F.lit(25.0).alias("value"), F.lit("x").alias("items"), F.col("event_timestamp").cast("timestamp_ntz").alias("event_timestamp"), F.lit(1).alias("traffic_source"))
    assert codes(check_typed(odd, as_of=F.lit(NOW), keep=["k"]))[0] == [("customer_id", "string_type"), ("currency", "enum"), ("value", "decimal_type"), ("items", "list_type"), ("event_timestamp", "timezone_aware"), ("traffic_source", "model_type")]
    assert check_typed(typed.limit(0), keep=["k"]).count() == 0
