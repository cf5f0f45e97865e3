"""Substring deduplication: passages that recur across documents are found, compiled into automata, and located.

1. Every document is read once. Of each window of `window` words, the least hash among its runs of `RUN` words is an
   anchor: equal windows have equal anchors, and a document has one for each 20 words or so. An anchor of two documents
   marks windows that may recur; most texts have none and go no further. Documents of equal words are one from the start.
2. Those windows are counted by their hashes, with the least document of each. One of two documents or more recurs.
3. The first document of recurring windows gives their passages. They are dealt to shards by the first document that has
   their anchors, so that neighbouring windows stay together, and so are the stretches of all documents with such anchors.
   A shard compiles an Aho-Corasick automaton (letters are its words) of its passages' blocks of half a window; every
   window of a passage holds one whole. The stretches are streamed through it. At a hit, the windows that hold the block
   are looked up among the passages' windows and compared with them word by word, so a removal never rests on a hash.

Passages of a shard with more than `HELD` words are dealt into blocks, as are stretches of one with more than `STREAM`
words, and each block of the one meets each block of the other; so a passage that a third of all documents have is no
task of its own. Both go in pieces of `PIECE` windows at most. Nothing is gathered but what belongs to one document.

Cases: null and empty texts have no words; a text of fewer words than a window keeps all; rows that share a doc_id are no
"smaller" document for each other, whether their texts are equal or not; a row without doc_id keeps all of its words and
takes none from others; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.llm.common import arrow_type, discard, named, quoted, stored

WINDOW, RUN = 50, 10
#: Recurring windows of a shard; words of passages, and of stretches, that meet in one block of it; windows of a piece.
SHARD, HELD, STREAM, PIECE = 100_000, 300_000, 1_500_000, 50_000
#: Shards of more than one block are broadcast up to this many, each about 40 bytes.
MOST_HOT = 50_000
#: Bytes of text of one batch that is passed on.
BATCH = 4 << 20
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
NOT_A_WORD = "\0"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def runs(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` consecutive values, put together from runs of powers of two."""
    out, have, part, power, n = None, 0, values, FACTOR, 1
    while True:
        if size & n:
            if out is None:
                out, have = part, n
            else:  # out is a run of `have` values, part one of n: the part goes behind it
                tail = part[have:]
                k = min(len(tail), len(out))
                out, have = out[:k] * power + tail[:k], have + n
        if have == size:
            return out[: max(0, len(values) - size + 1)]
        part, power, n = part[:-n] * power + part[n:] if len(part) > n else part[:0], np.uint64(int(power) ** 2 % (1 << 64)), 2 * n


def least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` consecutive values."""
    n = 1
    while 2 * n <= size:
        values, n = np.minimum(values[:-n], values[n:]), 2 * n
    return np.minimum(values[: len(values) - (size - n)], values[size - n :]) if n < size else values


def anchors(values: np.ndarray, window: int, run: int) -> np.ndarray:
    """The anchor of each window of hashed words."""
    mixed = runs(values, run)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX
    return least(mixed ^ (mixed >> np.uint64(32)), window - run + 1)


def stretches(marked: np.ndarray, home: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of neighbouring marked windows of one home, `PIECE` at most."""
    at = np.flatnonzero(marked)
    if len(at):
        cuts = np.flatnonzero((np.diff(at) > 1) | (home[at[1:]] != home[at[:-1]])) + 1
        for part in np.split(at, cuts):
            for a in range(int(part[0]), int(part[-1]) + 1, PIECE):
                yield a, min(a + PIECE, int(part[-1]) + 1)


class Passages:
    """An automaton over the blocks of passages, and the places of their windows."""

    def __init__(self, passages: list[tuple[object, list[bytes]]], window: int):
        self.window, self.block = window, (window + 1) // 2
        self.letters: dict[bytes, str] = {}
        self.tree = ahocorasick.Automaton()
        firsts, wins, places, codes, start = [], [], [], [], 0
        for k, (_, words) in enumerate(passages):
            text = "".join([self.letters.setdefault(w, letter(len(self.letters))) for w in words])
            for at in range(0, len(words) - self.block + 1, self.block):
                self.tree.add_word(text[at : at + self.block], True)
            code = coded(text)
            codes.append(code)
            found = runs(code.astype(np.uint64) * MIX, window)
            wins.append(found)
            places.append(start + np.arange(len(found)))
            firsts.append(np.full(len(found), k))
            start += len(code)
        self.tree.make_automaton()
        self.ids = np.array([i for i, _ in passages] + [None], object)[:-1]
        self.codes = np.concatenate(codes)
        order = np.argsort(all_wins := np.concatenate(wins), kind="stable")
        self.wins, self.places, self.firsts = all_wins[order], np.concatenate(places)[order], np.concatenate(firsts)[order]

    def located(self, doc_id: object, words: list[bytes]) -> list[tuple[int, int]]:
        """Ranges of words covered by windows of passages whose first document is smaller."""
        text = "".join(map(self.letters.get, words, repeat(NOT_A_WORD)))
        ends = [end for end, _ in self.tree.iter(text)]
        windows = len(words) - self.window + 1
        if not ends or windows <= 0:
            return []
        edge = np.zeros(windows + 1, np.int64)
        last = np.array(ends)
        np.add.at(edge, np.clip(last - self.window + 1, 0, windows), 1)
        np.add.at(edge, np.clip(last - self.block + 2, 0, windows), -1)
        at = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
        code = coded(text)
        found = runs(code.astype(np.uint64) * MIX, self.window)[at]
        place = np.minimum(np.searchsorted(self.wins, found), len(self.wins) - 1)
        like = self.wins[place] == found
        at, place = at[like], place[like]
        if not len(at):
            return []
        who, which = np.unique(self.firsts[place], return_inverse=True)
        smaller = np.array([self.ids[k] < doc_id for k in who])[which]
        at, where = at[smaller], self.places[place[smaller]]
        out = []
        # Windows that go on side by side in both texts are compared at once.
        for part in np.split(np.arange(len(at)), np.flatnonzero((np.diff(at) != 1) | (np.diff(where) != 1)) + 1) if len(at) else ():
            a, b, n = int(at[part[0]]), int(where[part[0]]), len(part) + self.window - 1
            if np.array_equal(code[a : a + n], self.codes[b : b + n]):
                out.append((a, a + n))
        return out


def letter(k: int) -> str:
    """A letter for the k-th word; the surrogates are left out. A block has far fewer words than there are letters."""
    return chr(k + 1 if k + 1 < 0xD800 else k + 0x801)


def coded(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def read(rows: DataFrame, window: int) -> DataFrame:
    """id, n_words, words_sha256 (of the words joined by a space) and the distinct anchors of rows (id, text)."""
    kind = arrow_type(rows.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digest, found = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                size.append(len(words))
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
                found.append(np.unique(anchors(hashes(words), window, RUN)).view(np.int64) if len(words) >= window else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(found, pa.list_(pa.int64()))], ["id", "n_words", "words_sha256", "anchors"])

    out = T.StructType([rows.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("words_sha256", T.StringType()), T.StructField("anchors", T.ArrayType(T.LongType()))])
    return rows.select("id", "text").mapInArrow(run, out)


def marked(words: list[bytes], hot: pa.Scalar, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: whether its anchor is in hot (structs of anchor and home), that home, and the window's hash."""
    values = hashes(words)
    own = anchors(values, window, RUN)
    known = np.array(hot.values.field(0).to_numpy(zero_copy_only=False)).view(np.uint64)
    homes = np.array(hot.values.field(1).to_numpy(zero_copy_only=False))
    order = np.argsort(known)
    known, homes = known[order], homes[order]
    place = np.minimum(np.searchsorted(known, own), len(known) - 1)
    return known[place] == own, homes[place], runs(values, window).view(np.int64)


def each(rows: DataFrame, fields: list[T.StructField], make: Callable[[list[bytes], dict], Iterator[tuple]]) -> DataFrame:
    """The id of each row of rows (id, text and more) with each of the tuples that make gives for its words."""
    out = T.StructType([rows.schema["id"], *fields])
    kind = arrow_type(rows.schema["id"].dataType)
    kinds = [arrow_type(f.dataType) for f in fields]
    names = [f.name for f in out]

    def batch_of(some: list[tuple]) -> pa.RecordBatch:
        columns = [[x[0] for x in some], *([x[1 + k] for x in some] for k in range(len(kinds)))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *kinds], strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = {f: batch.column(f)[k] for f in batch.schema.names}
                for x in make(words_of(row["text"].as_py()), row):
                    some.append((row["id"].as_py(), *x))
                    size += 64 + sum(len(v) for v in x if isinstance(v, (bytes, str)))
                    if size >= BATCH:
                        yield batch_of(some)
                        some, size = [], 0
        if some:
            yield batch_of(some)

    return rows.mapInArrow(run, out)


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """id, win and home of the windows of rows (id, text, hot) whose anchor recurs, once for each row."""
    out = T.StructType([rows.schema["id"], T.StructField("win", T.LongType()), T.StructField("home", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ok, home, win = marked(words_of(batch.column("text")[k].as_py()), batch.column("hot")[k], window)
                win, first = np.unique(win[ok], return_index=True)
                ids = batch.column("id").take(pa.array(np.full(len(win), k)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(win), pa.array(home[ok][first])], ["id", "win", "home"])

    return rows.select("id", "text", "hot").mapInArrow(run, out)


def _parts(rows: DataFrame, window: int) -> DataFrame:
    """Passages (windows of which the row is the first document: wins) and stretches (other windows that may recur)."""

    def make(words: list[bytes], row: dict) -> Iterator[tuple]:
        ok, home, win = marked(words, row["hot"], window)
        own = np.zeros(len(win), bool)
        if row["wins"].is_valid:
            own = np.isin(win, np.array(row["wins"].values.to_numpy(zero_copy_only=False)))
            once = np.zeros(len(win), bool)
            once[np.unique(win, return_index=True)[1]] = True
            for a, b in stretches(own & once, home):
                yield row["key"].as_py(), int(home[a]), True, a, b - a + window - 1, b" ".join(words[a : b + window - 1])
        for a, b in stretches(ok & ~own, home):
            yield row["key"].as_py(), int(home[a]), False, a, b - a + window - 1, b" ".join(words[a : b + window - 1])

    kinds = {"key": T.LongType(), "home": T.LongType(), "passage": T.BooleanType(), "start": T.IntegerType(), "size": T.IntegerType(), "words": T.BinaryType()}
    return each(rows.select("id", "key", "text", "hot", "wins"), [T.StructField(k, v) for k, v in kinds.items()], make)


def _located(parts: DataFrame, window: int) -> DataFrame:
    """id, key and span of the words to remove; parts come sorted by their group, passages first."""
    out = T.StructType([parts.schema["id"], T.StructField("key", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    kind = arrow_type(parts.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, passages, built = None, [], None
        for batch in batches:
            found: list[tuple] = []
            columns = [batch.column(k) for k in range(batch.num_columns)]
            for k in range(batch.num_rows):
                *now, stretch, doc_id, text_key, start, words = (c[k].as_py() for c in columns)
                if now != key:
                    key, passages, built = now, [], None
                if not stretch:
                    passages.append((doc_id, words.split(b" ")))
                elif passages:
                    built = built or Passages(passages, window)
                    found += [(doc_id, text_key, start + a, start + b) for a, b in built.located(doc_id, words.split(b" "))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], kind), *(pa.array([x[j] for x in found], t) for j, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32())))], ["id", "key", "start", "end"])

    return parts.mapInArrow(run, out)


def repeats(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, shard: int = SHARD, held: int = HELD, stream: int = STREAM) -> DataFrame:
    """Per row of documents: id, n_words, words_sha256, removed (spans of words) and kept.

    removed are the words covered by windows that also start in a document with a smaller id; kept is the text of the
    others, joined by one space, and null where nothing is removed.
    """
    if window < 2 * RUN:
        raise ValueError(f"a window has {2 * RUN} words at least")
    spark = documents.sparkSession
    rows = documents.select(F.col(quoted(named(documents, id_col))).alias("id"), F.col(quoted(named(documents, text_col))).alias("text"))
    every = stored(read(rows, window), "read")
    firsts = every.filter("id is not null").groupBy("words_sha256").agg(F.min("id").alias("first"), F.first("anchors").alias("anchors"))
    firsts = stored(firsts, "firsts")
    # Anchors of two documents, with the first of them as their home.
    pairs = firsts.select(F.col("first").alias("id"), F.explode("anchors").alias("anchor"))
    common = pairs.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("anchor", F.xxhash64("least").alias("home"))
    hot = pairs.join(common, "anchor").groupBy("id").agg(F.collect_list(F.struct("anchor", "home")).alias("hot"))
    hot = stored(hot, "hot")
    texts = stored(rows.join(hot, "id").select("id", F.xxhash64("text").alias("key"), "text", "hot"), "texts")
    counts = _windows(texts, window).groupBy("home", "win").agg(F.min("id").alias("first"), F.max("id").alias("most"), F.count("*").alias("n"))
    recurring = stored(counts.filter("first < most").select("home", "win", "first", "n"), "recurring")
    shards = max(1, -(-recurring.count() // shard))
    owned = recurring.groupBy(F.col("first").alias("id")).agg(F.collect_list("win").alias("wins"))
    parts = stored(_parts(texts.join(owned, "id", "left"), window), "parts")
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("home"), F.lit(shards)))
    blocks = lambda w, most: F.greatest(F.ceil(F.coalesce(F.sum(w), F.lit(0)) / most), F.lit(1)).cast("long")
    sums = dealt.groupBy("shard").agg(blocks(F.when(F.col("passage"), F.col("size")), held).alias("p"), blocks(F.when(~F.col("passage"), F.col("size")), stream).alias("s"))
    cut = stored(sums.filter("p > 1 or s > 1"), "cut")
    n_cut = cut.count()
    if n_cut:
        dealt = dealt.join(F.broadcast(cut) if n_cut <= MOST_HOT else cut, "shard", "left").fillna(1, ["p", "s"])
        every_one = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        own = lambda n: F.array(F.pmod(F.xxhash64("id", "start"), F.col(n)))
        dealt = dealt.withColumn("pb", F.explode(F.when(F.col("passage"), own("p")).otherwise(every_one("p"))))
        dealt = dealt.withColumn("sb", F.explode(F.when(F.col("passage"), every_one("s")).otherwise(own("s"))))
    else:
        dealt = dealt.withColumns({"pb": F.lit(0).cast("long"), "sb": F.lit(0).cast("long")})
    order = ["shard", "pb", "sb"]
    dealt = dealt.select(*order, (~F.col("passage")).alias("stretch"), "id", "key", "start", "words").repartition(*order).sortWithinPartitions(*order, "stretch")
    spans = _located(dealt, window).groupBy("id", "key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    cleaned = stored(_cleaned(texts.select("id", "key", "text").join(spans, ["id", "key"])), "cleaned")
    for done in (hot, texts, recurring, parts, cut):
        discard(spark, done)
    nothing = F.array().cast(SPAN)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))).cast(SPAN)
    copy = (F.col("id") > F.col("first")) & (F.col("n_words") >= window)
    told = every.select("id", "n_words", "words_sha256").join(firsts.select("words_sha256", "first"), "words_sha256", "left")
    told = told.join(cleaned, ["id", "words_sha256"], "left")
    removed = F.when(copy, whole).when(F.col("spans").isNotNull(), F.col("spans")).otherwise(nothing)
    return told.select(F.col("id").alias(id_col), "n_words", "words_sha256", removed.alias("removed"), F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"))


def _cleaned(rows: DataFrame) -> DataFrame:
    """id, words_sha256, spans (joined where they meet) and kept of rows (id, text, spans)."""

    def make(words: list[bytes], row: dict) -> Iterator[tuple]:
        gone = np.zeros(len(words) + 1, np.int64)
        for s in row["spans"].as_py():
            gone[s["start"]] += 1
            gone[s["end"]] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).reshape(-1, 2)
        kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
        yield hashlib.sha256(b" ".join(words)).hexdigest(), [{"start": int(a), "end": int(b)} for a, b in edges], kept.decode("utf-8", "surrogatepass")

    fields = [T.StructField("words_sha256", T.StringType()), T.StructField("spans", SPAN), T.StructField("kept", T.StringType())]
    return each(rows, fields, make).dropDuplicates(["id", "words_sha256"])
