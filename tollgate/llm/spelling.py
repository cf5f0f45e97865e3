"""Spelling variants: words one edit apart, found by Aho-Corasick automata over the halves of the words.

A word is cut into two segments, its first half and the rest. One inserted, deleted or replaced character leaves one of
the two whole: the first at the start of the other word, or the second at its end. So automata hold both segments of
every word, all words are scanned by them, and a hit counts if the segment stands at its own end of the scanned word and
the lengths differ by one at most. The words of a hit are then compared letter by letter, in matrices.

No automaton holds all words. A segment has three characters at least, so a word and the segments that it may match have
the same first three characters, or the same last three: words are dealt by these, to shards of some `SHARD` words, each
an automaton of its own. Where more words than that share three characters, they are cut by length and into blocks of
`SHARD`, and every word is scanned by all blocks of fitting length. So the memory of a task is bounded, no word is left
out, and outside of such hot groups a word is sent to two tasks, whatever the size of the vocabulary.

Cases: null and empty texts have no words; a null doc_id is the empty text in the hash; repeated rows count each; ties of
the most frequent neighbour go to the smaller word; words of any length are compared whole; an empty table gives an empty
one; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import discard, named, quoted, stored

LEAST_LETTERS, LEAST_COUNT = 6, 5
#: A form is so many times as frequent as its variant.
TIMES = 5
#: One in so many pairs of document and word loses a letter.
SPOILT = 199
#: Words of an automaton, and of a chunk that is scanned; words whose counts a task holds before it passes them on.
SHARD, CHUNK, HELD = 50_000, 20_000, 300_000
#: Hot groups are broadcast up to this many, each about 60 bytes.
MOST_HOT = 50_000
#: Bytes of a block of comparisons.
BLOCK = 8 << 20
#: The letters are the code points of Latin-1 from A-Z, a-z and À on, so a word has a byte for each.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
LATIN = "latin-1"


def words_of(doc_id: object, text: str | None) -> dict[bytes, int]:
    """The counts of a text's words in Latin-1, spoilt as the contract says, short ones included."""
    counts = Counter((text or "").encode(LATIN, "replace").translate(LOWER).split())
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    hashes = ((w, zlib.crc32(w if w.isascii() else w.decode(LATIN).encode(), start)) for w in counts)
    spoilt = [(w, h % len(w), counts[w]) for w, h in hashes if not h % SPOILT]
    for w, _, _ in spoilt:
        del counts[w]
    for w, at, n in spoilt:
        counts[w[:at] + w[at + 1 :]] += n
    return counts


def counted(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """word and n of the words of at least `LEAST_LETTERS` letters that occur `LEAST_COUNT` times or more."""
    rows = documents.select(F.col(quoted(named(documents, id_col))).cast("string").alias("id"), F.col(quoted(named(documents, text_col))).alias("text"))

    def passed(held: Counter) -> Iterator[pa.RecordBatch]:
        words = list(held)
        for at in range(0, len(words), CHUNK):
            some = words[at : at + CHUNK]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode(LATIN) for w in some], pa.string()), pa.array([held[w] for w in some], pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                for w, n in words_of(doc_id.as_py(), text.as_py()).items():
                    if len(w) >= LEAST_LETTERS:
                        held[w] += n
                if len(held) >= HELD:
                    yield from passed(held)
                    held = Counter()
        yield from passed(held)

    sums = rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return sums.filter(F.col("n") >= LEAST_COUNT)


class Shard:
    """An automaton over both segments of some words, and the words behind each segment, the most frequent first."""

    def __init__(self, words: list[str], counts: list[int], sides: list[int]):
        """sides: which segment of each word is held, the first (0) or the rest (1)."""
        groups: dict[tuple[int, str, int], list[int]] = {}
        for k, (w, side) in enumerate(zip(words, sides, strict=True)):
            half = len(w) // 2
            groups.setdefault((side, w[half:] if side else w[:half], len(w)), []).append(k)
        self.words, self.counts = words, counts
        self.groups: list[tuple[int, int, int, np.ndarray, list[int]]] = []
        segments: dict[str, list[int]] = {}
        for (side, segment, length), members in groups.items():
            members.sort(key=lambda k: (-counts[k], words[k]))
            segments.setdefault(segment, []).append(len(self.groups))
            self.groups.append((side, length, length // 2, matrix([words[k] for k in members]), members))
        self.tree = ahocorasick.Automaton()
        for segment, who in segments.items():
            self.tree.add_word(segment, (len(segment), who))
        if segments:
            self.tree.make_automaton()
        self.empty = not segments

    def scan(self, some: list[tuple[str, int]]) -> dict[str, tuple[int, int, str]]:
        """For words with a side: how many held words are near each, and the most frequent of them (its count first)."""
        hits: dict[tuple[int, int], list[str]] = {}
        groups = self.groups
        for word, side in some if not self.empty else ():
            n = len(word)
            for end, (size, who) in self.tree.iter(word):
                # The place of the segment: at the start of the word for a first half, at its end for the rest.
                if (end + 1 == n) if side else (end + 1 == size):
                    for g in who:
                        if groups[g][0] == side and abs(groups[g][1] - n) <= 1:
                            hits.setdefault((g, n), []).append(word)
        out: dict[str, tuple[int, int, str]] = {}
        for (g, _), scanned in hits.items():
            side, _, half, held, members = groups[g]
            for first, near, best in compared(held, scanned, half if side else 0):
                for j in np.flatnonzero(near).tolist():
                    word, k = scanned[first + j], members[best[j]]
                    new = (self.counts[k], self.words[k])
                    n, c, w = out.get(word, (0, 0, ""))
                    if not n or new[0] > c or new[0] == c and new[1] < w:
                        c, w = new
                    out[word] = (n + int(near[j]), c, w)
        return out


def matrix(words: list[str]) -> np.ndarray:
    """Words of one length, a row of bytes each."""
    return np.frombuffer("".join(words).encode(LATIN), np.uint8).reshape(len(words), -1)


def compared(held: np.ndarray, scanned: list[str], skip: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For parts of the scanned words, from `first` on: how many held words are one edit away, and the first of them.

    Pairs of which the scanned word starts with the first `skip` letters of the held one are left out: those are found
    by the first segment.
    """
    length = held.shape[1]
    step = max(1, BLOCK // max(1, held.size))
    for first in range(0, len(scanned), step):
        other = matrix(scanned[first : first + step])
        a, b = held[:, None, :], other[None, :, :]
        if other.shape[1] == length:
            near = (a != b).sum(2) == 1
        else:  # all letters but one of the longer word are the shorter one: before it and behind it
            short, long = (a, b) if length < other.shape[1] else (b, a)
            before = np.logical_and.accumulate(short == long[:, :, :-1], axis=2).sum(2)
            behind = np.logical_and.accumulate((short == long[:, :, 1:])[:, :, ::-1], axis=2).sum(2)
            near = before + behind >= short.shape[2]
        if skip:
            near &= ~(a[:, :, :skip] == b[:, :, :skip]).all(2)
        yield first, near.sum(0), near.argmax(0)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard and, in it, those to hold first: shard, part, block, scan_only, side, word, n."""
    key, shard = None, None
    words: list[str] = []
    counts: list[int] = []
    sides: list[int] = []
    waiting: list[tuple[str, int]] = []

    def flushed() -> Iterator[pa.RecordBatch]:
        nonlocal shard
        if waiting:
            if shard is None:
                shard = Shard(words, counts, sides)
            found = shard.scan(waiting)
            waiting.clear()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([v[k] for v in found.values()], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], ["word", "n_near", "best_n", "best"])

    for batch in batches:
        for *now, scan_only, side, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != key:
                yield from flushed()
                key, shard, words, counts, sides = now, None, [], [], []
            if not scan_only:
                words.append(word)
                counts.append(n)
                sides.append(side)
            waiting.append((word, side))
            if scan_only and len(waiting) >= CHUNK:  # all that the shard holds has come
                yield from flushed()
    yield from flushed()


def neighbours(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """word, n_near, best_n and best of the words (word, n) that have a near word."""
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.substring("word", 1, 3).alias("edge")), F.struct(F.lit(1).alias("side"), F.expr("right(word, 3)").alias("edge")))).alias("at")).select("at.*", "word", "n", size.alias("size"))
    sizes = rows.groupBy("side", "edge", "size").agg(F.count("*").alias("held"))
    total = words.count()
    shards = max(1, -(-2 * total // shard))
    crowd = sizes.groupBy("side", "edge").agg(F.sum("held").alias("crowd")).filter(F.col("crowd") > shard)
    hot = stored(sizes.join(crowd, ["side", "edge"]).select("side", "edge", "size", F.ceil(F.col("held") / shard).alias("blocks")), "edges")
    n_hot = hot.count()
    home = F.pmod(F.xxhash64("side", "edge"), F.lit(shards)).cast("long")
    plain = [home.alias("shard"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("block"), F.lit(False).alias("scan_only"), "side", "word", "n"]
    if not n_hot:
        dealt = rows.select(*plain)
    else:
        held = (lambda d: F.broadcast(d)) if n_hot <= MOST_HOT else (lambda d: d)
        # A hot group is met once for each length that fits: as one that holds the word, or only scans it.
        fits = hot.select("side", "edge", F.col("size").alias("part"), "blocks", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"))
        many = rows.join(held(fits), ["side", "edge", "size"])
        own = F.pmod(F.xxhash64("word"), F.col("blocks"))
        many = many.withColumn("own", own).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        # Its shards are beyond the others', and as a key of its own each.
        apart = (F.lit(shards) + F.pmod(F.xxhash64("side", "edge"), F.lit(1 << 40))).cast("long")
        some = many.select(apart.alias("shard"), "part", "block", ((F.col("part") != F.col("size")) | (F.col("block") != F.col("own"))).alias("scan_only"), "side", "word", "n")
        dealt = rows.join(held(hot.select("side", "edge").distinct()), ["side", "edge"], "left_anti").select(*plain).unionByName(some)
    order = ["shard", "part", "block"]
    dealt = dealt.select(*order, "scan_only", "side", "word", "n").repartition(*order).sortWithinPartitions(*order, "scan_only")
    found = dealt.mapInArrow(_scanned, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """word and root: where forms (word, form; no word twice) lead in the end, in rounds that double the steps."""
    spark = forms.sparkSession
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = new.filter("moved").limit(1).count()
        discard(spark, at)
        at = new.select("word", "root")
        if not moved:
            return at


def variants(words: DataFrame, times: int = TIMES, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near and form_n for distinct words (word, n).

    form is the near word of the largest n, if that is at least `times` the word's; root is what forms lead to.
    """
    words = stored(words.select("word", "n"), "words")
    near = words.join(neighbours(words, shard), "word", "left")
    told = F.col("best_n") >= times * F.col("n")
    near = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(told, F.col("best")).alias("form"), F.when(told, F.col("best_n")).alias("form_n")), "near")
    roots = rooted(near.filter("form is not null").select("word", "form"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
