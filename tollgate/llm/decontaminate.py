"""Benchmark decontamination: one Aho-Corasick automaton over the windows of the test items.

A word is a run of characters other than ASCII punctuation, space and control characters, with A-Z in lower case.
A window is `window` consecutive words of an item (questions and answers alike); an item of fewer words, but not none,
is one window. Text is scanned once, as its normalised words joined by spaces; each hit is mapped back to the place in
the original text.

The automaton lives in each Python worker, over numbers of words, two letters each, so a window costs at most twice as
many nodes as it has words. Benchmarks are small and documents are not, so the items are collected; those of over
`most_windows` windows are dealt into shards, and one job after the other scans the documents, which are written once, for
the windows of one shard. So neither memory nor what the driver collects grows with the benchmark, and nothing is dropped
at any size.

Cases: null and empty texts have no words and no hit; repeated rows are scanned alike and all kept; an empty benchmark
gives no hits; a null item_id is listed as the text "null"; repeated items and repeated item_ids count once; other
columns of documents are kept, except those named as the new ones, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count
from math import isqrt

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.llm.common import arrow_type, free_name, named, quoted, slices, stored

WINDOW = 10
#: Windows of one automaton; it and what it is built from take about 1 kB each in a worker.
MOST_WINDOWS = 150_000
#: Windows of one piece of a long item.
PIECE = 10_000

WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]), False)
STATE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_words", SPANS), T.StructField("item_ids", T.ArrayType(T.StringType(), False))])
SOURCE = "text_in"
WORD, UPPER = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ids = count()


def as_words(text: str | None) -> bytes:
    """The text's bytes, place by place, with spaces for all that belongs to no word."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES)


def windows(text: str | None, window: int = WINDOW) -> set[tuple[bytes, ...]]:
    words = as_words(text).split()
    return {tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()


class Automaton:
    """The windows of items, and a scan for them."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            for w in windows(text, window):
                owners.setdefault(w, set()).add(item)
        known = sorted({x for w in owners for x in w})
        base = isqrt(len(known)) + 1
        # The two letters of a word's number are of different ranges, so no match begins within a word.
        self.letters = {x: chr(2 + k // base) + chr(2 + 2 * base + k % base) for k, x in enumerate(known)}
        self.tree = ahocorasick.Automaton()
        for w, who in owners.items():
            self.tree.add_word("".join([self.letters[x] for x in w]), (len(w), tuple(sorted(who))))
        self.empty = not owners
        if owners:
            self.tree.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, the hit words as ranges [start, end) of characters of the text, and the items found.

        Neighbouring hit words make one range each, so that the ranges count as words do.
        """
        spaced = as_words(text)
        words = spaced.split()
        if self.empty or not words:
            return len(words), [], set()
        get = self.letters.get
        found = list(self.tree.iter("".join([get(w, "\0\0") for w in words])))
        if not found:
            return len(words), [], set()
        last = np.array([end for end, _ in found]) // 2 + 1
        edge, items = np.zeros(len(words) + 1, np.int64), set()
        np.add.at(edge, last, -1)
        np.add.at(edge, last - [n for _, (n, _) in found], 1)
        for who in {who for _, (_, who) in found}:
            items.update(who)
        hit = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
        places = np.array([m.span() for m in re.finditer(rb"[^ ]+", spaced)])[hit]
        chars = np.concatenate(([0], np.cumsum((np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80)))
        return len(words), [(int(a), int(b)) for a, b in chars[places]], items


_built: dict[str, Automaton] = {}


def pieces(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """item, words (normalised, joined by spaces) and windows (their number) of the items, long ones in pieces."""
    words = F.regexp_extract_all(F.translate(F.col(quoted(text_col)), UPPER, UPPER.lower()), F.lit(WORD), F.lit(0))
    rows = benchmark.select(F.coalesce(F.col(quoted(item_col)).cast("string"), F.lit("null")).alias("item"), words.alias("all")).filter(F.size("all") > 0)
    total = F.greatest(F.size("all") - window + 1, F.lit(1))
    starts = F.sequence(F.lit(0), total - 1, F.lit(PIECE))
    rows = rows.select("item", "all", total.alias("total"), F.explode(starts).alias("start"))
    return rows.select("item", F.array_join(F.slice("all", F.col("start") + 1, F.lit(PIECE + window - 1)), " ").alias("words"), F.least(F.col("total") - F.col("start"), F.lit(PIECE)).alias("windows"))


def find_benchmark(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """documents with n_words, hit_words (the ranges of characters of each hit word) and item_ids (sorted as strings)."""
    text_col, item_col, item_text_col = named(documents, text_col), named(benchmark, item_col), named(benchmark, item_text_col)
    items = pieces(benchmark, item_col, item_text_col, window)
    total = items.agg(F.sum("windows")).first()[0] or 0
    shards = 1 if total <= most_windows else -(-total * 5 // (4 * most_windows))  # some are larger than others
    names = {f.name for f in STATE}
    keep = [c for c in documents.columns if c.lower() not in names]
    inner = [f"c{i}" for i in range(len(keep))]  # plain names while Python has the rows
    rows = documents.select(*[F.col(quoted(c)).alias(n) for c, n in zip(keep, inner, strict=True)], F.col(quoted(text_col)).alias(SOURCE))
    if shards == 1:
        out = scanned(rows, items, inner, window)
    else:
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "documents")
        items = stored(items.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(shards))), "items")
        some = [stored(scanned(rows.select("row", SOURCE), items.filter(F.col("shard") == k), ["row"], window).filter("size(hit_words) > 0"), "hits") for k in range(shards)]
        every = some[0]
        for more in some[1:]:
            every = every.unionByName(more)
        joined = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        hits = every.groupBy(F.col("row").alias("hit_row")).agg(joined("hit_words"), joined("item_ids"))
        out = rows.join(hits, F.col("row") == F.col("hit_row"), "left")
        none = lambda f: F.coalesce(f.name, F.array().cast(f.dataType)).alias(f.name)
        n_words = F.coalesce(F.regexp_count(F.translate(F.col(SOURCE), UPPER, UPPER.lower()), F.lit(WORD)), F.lit(0)).cast("long")
        out = out.select(*inner, n_words.alias("n_words"), none(STATE["hit_words"]), none(STATE["item_ids"]))
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, inner, strict=True)], *STATE.names)


def scanned(rows: DataFrame, items: DataFrame, inner: list[str], window: int) -> DataFrame:
    """The columns inner of rows with what the automaton of items finds in SOURCE."""
    spark = rows.sparkSession
    bundle = spark.sparkContext.broadcast([(r.item, r.words) for r in items.select("item", "words").collect()])
    key = f"{spark.sparkContext.applicationId}-{next(_ids)}"
    new = pa.schema([(f.name, arrow_type(f.dataType)) for f in STATE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()
            _built[key] = Automaton(bundle.value, window)
        scan = _built[key].scan
        for batch in batches:
            for part in slices(batch, SOURCE):
                found = [scan(t) for t in part.column(SOURCE).to_pylist()]
                made = [pa.array([n for n, _, _ in found], new[0].type), pa.array([[{"start": a, "end": b} for a, b in at] for _, at, _ in found], new[1].type), pa.array([sorted(who) for _, _, who in found], new[2].type)]
                heads = [f for f in part.schema if f.name in inner]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in heads] + made, schema=pa.schema(heads + list(new)))

    return rows.select(*inner, SOURCE).mapInArrow(run, T.StructType([*rows.select(*inner).schema.fields, *STATE.fields]))


def decontaminated(documents: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """documents without those that hold a window of a test item."""
    flagged = free_name(documents, "hits_in")
    keep = documents.columns
    inner = documents.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(keep)])
    found = find_benchmark(inner, benchmark, f"c{keep.index(named(documents, text_col))}").withColumn(flagged, F.size("hit_words"))
    return found.filter(F.col(flagged) == 0).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)])
