"""What the keyed ledger leaves on disk: no rows shuffled by id where few ids repeat, small pages, no old shuffle files."""

import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tollgate.operators.ledger import classify
from tollgate.sinks import ParquetSink
from tollgate.sources import tables
from tollgate.streaming import keyed, topic
from test_keyed import BATCHES, Kept, batch, run


def test_pages_are_small():
    from hashlib import sha256

    ids = {f"T-{i:06d}": sha256(str(i).encode()).hexdigest() for i in range(64)}
    assert keyed.unpacked(keyed.packed(ids)) == ids and len(keyed.packed(ids)) < 0.6 * len(json.dumps(ids))


def test_the_state_tells_ids_that_a_batch_repeats():
    ledger = keyed.FirstDigests()
    ledger.first, ledger.size = Kept(), Kept()

    def told(ids, frames):
        rows = pd.DataFrame([(f"{k:06d}", "raw", i, "{}", None if i is None or i == "bad" else "f", "[]") for k, i in enumerate(ids)], columns=keyed.ROW.names[:-1])
        return pd.concat(ledger.handleInputRows(("1",), iter([rows[a:z] for a, z in frames]), None))["again"].tolist()

    assert told(["a", "b", "a", "bad", "bad", None, None, "b", "c"], [(0, 4), (4, 9)]) == [False, False, True, False, False, False, False, True, False]
    assert told(["a", "d", "a", "d"], [(0, 1), (1, 4)]) == [False, False, False, True]  # a has a digest from before


def test_few_repeated_ids_move_no_rows(spark):
    rows = spark.createDataFrame([(f"t{k % 40 if k < 45 else k}", f"d{k % 3}", k, "old" if k == 99 else None, k % 7 != 0) for k in range(100)], "id string, digest string, at long, before string, good boolean")
    more = {"where": F.col("good"), "before": F.col("before")}
    repeated = rows.filter("good and before is null").groupBy("id").count().filter("count > 1").select("id")
    few, all_ = classify(rows, "id", "digest", "at", repeated=repeated, **more), classify(rows, "id", "digest", "at", **more)
    assert sorted(map(str, few.collect())) == sorted(map(str, all_.collect()))
    assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()


def shuffle_files(spark):
    held = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().iterator()
    out = set()
    while held.hasNext():
        out.add(held.next().getName())
    return {name for name in out if name.startswith("shuffle_")}


@pytest.mark.parametrize("most", [100_000, 0])
def test_batches_are_judged_alike_where_few_ids_repeat(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(keyed, "REPEATED", most)
    root = f"file://{tmp_path}"
    for rows in BATCHES:
        topic.append(batch(spark, rows), f"{root}/topic")
        had = shuffle_files(spark)
        query = run(spark, root, ParquetSink(root))
        for _ in range(100):
            if not shuffle_files(spark) - had:
                break
            time.sleep(0.1)
        assert not shuffle_files(spark) - had
    assert sorted(r.transaction_id for r in tables.events(spark, root, "ingest").collect()) == ["T-000001", "T-000002", "T-000003", "T-000004", "T-000050"]
    assert sorted((r.reason, r.transaction_id or "") for r in tables.quarantine(spark, root, "ingest").collect()) == [("duplicate_transaction", "T-000001"), ("duplicate_transaction", "T-000002"), ("duplicate_transaction", "T-000003"), ("duplicate_transaction", "T-000003"), ("malformed_payload", ""), ("malformed_payload", "")]
    assert query.exception() is None and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
