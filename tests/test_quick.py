"""Objects without unknown keys, which are read at once: the same verdicts as field by field."""

import json

from pyspark.sql import functions as F

from tollgate import queries
from tollgate.functions import rules
from tollgate.functions.payload import document
from tollgate.operators.verdict import parse

BASE = json.loads(queries.PURCHASE_TEXT % (7, 7))
ITEM = BASE["items"][0]
ODD = [None, True, 7, 2.5, 12345678901234567890, "", "7", "NaN", [], [1], {"a": 1}, "2026-01-14"]


def test_the_quick_way_gives_what_the_long_way_gives(spark, monkeypatch):
    made = [BASE | {name: value} for name in BASE for value in ODD] + [{k: v for k, v in BASE.items() if k != name} for name in BASE]
    made += [BASE | {"items": [ITEM, ITEM | {name: value}]} for name in ITEM for value in ODD] + [BASE | {"traffic_source": BASE["traffic_source"] | {name: value}} for name in BASE["traffic_source"] for value in ODD]
    made += [BASE | {"items": items} for items in ([None], [{}], [7], [[]], [ITEM] * 201, [ITEM | {"x": 1}], [ITEM | {"quantity": 2}, ITEM | {"quantity": 2.5}])] + [BASE | {"x, currency: STRING": 1}, BASE | {"x": {"currency": 7}}, {}]
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(made)], "i int, value string")
    of = lambda mode: [tuple(map(str, r)) for r in parse(rows, as_of=F.lit(queries.REFERENCE), mode=mode).orderBy("i").collect()]
    quick = {mode: of(mode) for mode in ("strict", "lax")}
    monkeypatch.setattr(rules, "shape_of", lambda *_: None)
    rules._layers.clear()
    assert quick == {mode: of(mode) for mode in ("strict", "lax")}
    rules._layers.clear()


def test_faulty_fields_are_told_from_one_reading(spark):
    fit = lambda old, codes: codes and old.startswith('"') and not {"json_invalid", "value_mismatch"} & {codes} and "extra" not in codes
    texts = [queries.PURCHASE_TEXT.replace(old, new) % (7, 7) for old, new, codes, _ in queries.CHANGES if fit(old, codes)]
    rows = spark.createDataFrame([(t,) for t in texts], "value string").withColumn("doc", document(F.col("value")))
    told = rules.with_issues(rows, queries.PURCHASE.fields, "doc", F.col("value"), F.lit(queries.REFERENCE), False, "issues", texts="read").collect()
    assert len(told) > 15 and all(r.read is not None and r.issues for r in told)


def test_a_document_is_the_whole_text(spark):
    texts = {"{}": True, ' {"a":[1]}\n': True, "{} x": False, '1,"r":2': False, "{}{}": False, "": False, "[" * 3: False, '{"r":1}': True, "nul": False, "7": True}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", document(F.col("t")).isNotNull().alias("ok")).collect()
    assert {r.t: r.ok for r in got} == texts


def cached_when_judged(spark, monkeypatch, module):
    """A list that gets, for each time that module judges rows, how many partitions are cached, and of how many."""
    seen, judge = [], module.judged

    def spy(*args, **more):
        seen.append([(x.numCachedPartitions(), x.numPartitions()) for x in spark.sparkContext._jsc.sc().getRDDStorageInfo()])
        return judge(*args, **more)

    monkeypatch.setattr(module, "judged", spy)
    return seen


def test_published_lines_are_parsed_before_they_are_read_twice(spark, monkeypatch, tmp_path):
    from tollgate.sinks import ParquetSink
    from tollgate.streaming import topic

    spark.catalog.clearCache()
    seen = cached_when_judged(spark, monkeypatch, topic)
    lines = spark.range(0, 40, 1, 4).select(F.format_string(queries.PURCHASE_TEXT, "id", "id").alias("value"), F.col("id").alias("place"))
    told = topic.publish_lines(lines, str(tmp_path), ParquetSink(str(tmp_path)), F.lit(queries.REFERENCE))
    assert told == {"published": 40, "replays_skipped": 0, "quarantined": {}}
    assert seen == [[(4, 4)]]
