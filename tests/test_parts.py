"""Loads of folders, whose parts are written, digested and read by many tasks."""

import hashlib

from pyspark.sql import functions as F

from tollgate import queries
from tollgate.plans import batch
from tollgate.sources import lines, tables
from tollgate.sources.lines import file_digest


def parts(folder, *texts, name="part"):
    folder.mkdir()
    (folder / "_SUCCESS").write_text("")
    for k, text in enumerate(texts):
        (folder / f"{name}-{k:05d}.txt").write_text(text)
    return str(folder)


def test_a_folder_of_parts_is_one_load(spark, tmp_path):
    root, made = str(tmp_path / "root"), [queries.PURCHASE_TEXT % (k, k) for k in range(1, 5)]
    one = parts(tmp_path / "one", made[0] + "\n" + made[1].replace("PLN", "EUR") + "\n", made[1] + "\n" + made[2] + "\n")
    done = batch.load_file(spark, one, root, F.lit(queries.REFERENCE))
    assert (done.status, done.manifest["lines"], done.manifest["accepted"], done.manifest["quarantined"]) == ("loaded", 4, 3, {"duplicate_transaction": 1})
    assert {r.transaction_id: r.currency for r in tables.events(spark, root).collect()} == {"T-000001": "PLN", "T-000002": "EUR", "T-000003": "PLN"}
    same = parts(tmp_path / "same", *[p.read_text() for p in sorted((tmp_path / "one").glob("part*"))], name="other")
    assert batch.load_file(spark, same, root, F.lit(queries.REFERENCE)).status == "skipped"
    more = batch.load_file(spark, parts(tmp_path / "more", made[2] + "\n", made[3] + "\n"), root, F.lit(queries.REFERENCE))
    assert (more.status, more.manifest["accepted"], more.manifest["replayed"]) == ("loaded", 1, 1)


def test_digests_of_folders(spark, tmp_path, monkeypatch):
    at = parts(tmp_path / "in", "b\n" * 9, "a\n", "")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sha(sha("b\n" * 9) + sha("a\n"))  # an empty part holds nothing
    assert file_digest(spark, at) == want != file_digest(spark, parts(tmp_path / "turned", "a\n", "b\n" * 9, ""))
    monkeypatch.setattr(lines, "LARGEST", 4)  # a larger part is read as a stream
    assert file_digest(spark, at) == want
    assert file_digest(spark, f"{at}/part-00001.txt") == sha("a\n")


def test_no_load_is_the_file_of_one_task(spark, tmp_path, monkeypatch):
    spark.range(0, 400, 1, 2).withColumnRenamed("id", "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    loaded, load = [], batch.load_file

    def spy(spark, path, *more):
        loaded.append(len(spark.read.text(path).inputFiles()))
        return load(spark, path, *more)

    monkeypatch.setattr(batch, "load_file", spy)
    assert entry_rows(spark, tmp_path) == [(0, 200, 200, 0, 0), (1, 300, 200, 50, 50)]
    assert len(loaded) == 2 and min(loaded) > 1


def entry_rows(spark, tmp_path):
    return sorted(map(tuple, queries.overlapping_loads(spark, str(tmp_path)).collect()))
