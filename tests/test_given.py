"""Faults over events that are given, which are as many as they are."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tollgate.operators import generator
from tollgate.operators.generator import GeneratorConfig, fault_counts, generate, valid_events

REF = datetime(2026, 1, 15, tzinfo=UTC)


def test_given_events_have_no_bound(spark):
    assert GeneratorConfig(54_000_000, 0.25, 11, reference_time=REF, given=True).n_faults == 13_500_000
    with pytest.raises(ValueError):
        GeneratorConfig(54_000_000, 0.25, 11, reference_time=REF)
    with pytest.raises(ValueError):
        GeneratorConfig(0, given=True)
    with pytest.raises(ValueError):
        generate(spark, GeneratorConfig(5, given=True))


def test_queries_lay_faults_over_more_than_are_made(spark, tmp_path, monkeypatch):
    from tollgate import queries

    monkeypatch.setattr(generator, "MOST_MADE", 10)
    spark.range(40).select(F.col("id").alias("o_orderkey"), F.lit(1).cast("long").alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.lit(12.5).alias("o_totalprice"), F.lit(datetime(1997, 1, 1)).alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    assert sum(r.n for r in queries.fault_kinds(spark, str(tmp_path)).collect()) == 40
    assert {(r.fault, r.verdict): r.n for r in queries.purchase_verdicts(spark, str(tmp_path)).collect()}["valid", "accepted"] == 30


def test_given_and_made_events_get_the_same_faults(spark):
    made, given = GeneratorConfig(50, 0.5, 7, reference_time=REF), GeneratorConfig(50, 0.5, 7, reference_time=REF, given=True)
    lines = lambda rows: sorted(map(tuple, rows.collect()))
    events = valid_events(spark, made)
    assert lines(generate(spark, given, events)) == lines(generate(spark, made)) and fault_counts(generate(spark, given, events)).count() == 9
