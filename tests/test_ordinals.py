import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tollgate.operators import generator
from tollgate.operators.ledger import repeats
from tollgate.operators.ordinals import least, numbered


def test_ordinals_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([1, 2, 3, None]), k) for k in range(900)]
    table = spark.createDataFrame(rows, "id string, at long, k long").repartition(5)
    got = numbered(table, ["id"], ["at", "k"], "n", ranges=16)
    assert got.columns == ["id", "at", "k", "n"]
    want = {}
    for who in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == who), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))):
            want[r[2]] = n
    assert {r.k: r.n for r in got.collect()} == want
    # a hot id is numbered by many tasks
    assert numbered(table.filter("id = 'hot'"), ["id"], ["at", "k"], ranges=16).withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 4
    assert numbered(table.limit(0), ["id"], ["at"]).count() == 0
    assert [r.n for r in numbered(spark.range(50), [], ["id"], "n", 7).orderBy("id").collect()] == list(range(50))


def test_equal_rows_have_numbers_of_their_own(spark):
    table = spark.createDataFrame([("x", 1)] * 60 + [("y", 1)] * 3, "id string, at long")
    got = repeats(table, "id", "at").groupBy("id").agg(F.sort_array(F.collect_list("repeat")).alias("n")).collect()
    assert {r.id: r.n for r in got} == {"x": list(range(60)), "y": [0, 1, 2]}


@pytest.mark.parametrize("n", [0, 1, 37, 500, 501])
def test_least_is_exact(spark, n):
    rows = spark.range(500).withColumn("h", F.xxhash64("id") % 40 + F.when(F.col("id") % 2 == 0, F.lit(-(2**62))).otherwise(F.lit(0)))
    every = sorted((r.h, r.id) for r in rows.collect())
    assert sorted((r.h, r.id) for r in least(rows, F.col("h"), n, ["id"]).collect()) == every[:n]


def test_faults_over_given_events(spark):
    config = generator.GeneratorConfig(400, 0.3, 9, reference_time=__import__("datetime").datetime(2026, 1, 15, tzinfo=__import__("datetime").UTC))
    events = generator.valid_events(spark, config)
    given = Counter(r.fault for r in generator.generate(spark, config, events).collect())
    assert given == Counter(r.fault for r in generator.generate(spark, config).collect())
    assert given[None] == 280 and {v for k, v in given.items() if k} == {15}
