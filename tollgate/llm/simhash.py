"""SimHash near-duplicates: fingerprints, a grid join in a space of segment bit counts, and components.

A fingerprint is embedded as the bit counts of its 32 two-bit segments, each in unary code (0: 00, 1: 01, 2: 11), so
that the Manhattan distance of two embeddings is the number of differing code bits. It never exceeds the Hamming
distance of the fingerprints, so within `DISTANCE` = 3 it is a filter that loses no link. The range join is one of equal
cells in projections of this space: its 32 places are dealt to some ranges, and of three units of distance all but three
ranges get none, so two linked fingerprints share a cell of the grid over all but some three ranges. The number of ranges
follows the number of fingerprints (ten grids over two of five ranges up to eight millions, twenty over three of six
beyond, and so on), so a cell holds a few fingerprints at every size of the table; all numbers of ranges give the same
links. Within a cell, pairs are first held against the Manhattan distance and then verified by their differing bits.

No cell emits all its pairs: it gives a spanning forest of its links, which has the same components. Cells of more than
`BLOCK` fingerprints are cut into blocks, and each pair of blocks is a group of its own, so no task gets a whole hot
cell. Equal fingerprints are one row from the start. Components are found by least labels passed along links with
pointer jumping, each round written to the shared folder.

Cases: null, empty and blank texts have fingerprint 0, which is linked as any other; fewer words than a shingle has make
one shingle; repeated rows have equal results and all stay; rows without doc_id have a component all the same, the least
doc_id in it or null; an empty table gives an empty one; other columns are kept, except those named as new ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.llm.common import add_columns, discard, named, quoted, stored

WORDS = 3
SEED = 42
DISTANCE = 3
BLOCK = 2048
#: Fingerprints that a cell holds on average, at most; a two-bit segment has about three halves of a bit of information.
CROWD = 16
LOW = 0x5555555555555555
#: The links of near_deduplicated: words of a shingle, the Jaccard similarity as a fraction, bands and rows of MinHash
#: cells (a pair of similarity 0.8 shares none with a chance of 0.0002), bands that are held against each other before
#: the others, members and bytes of a block of a large cell.
SHINGLE, LIKE = 5, (4, 5)
BANDS, ROWS, BEFORE = 16, 4, 2
LIKE_BLOCK, LIKE_BYTES = 4096, 8 << 20
TIMES, PLUS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.array([[1], [0]], np.uint64)
#: Hot cells are broadcast up to this many, each about 40 bytes.
MOST_CELLS = 100_000


def ranges_for(n: int) -> int:
    """The number of ranges for n fingerprints."""
    return next((r for r in range(DISTANCE + 2, 13) if n <= CROWD * 2 ** (48 * (r - DISTANCE) // r)), 13)


def masks(ranges: int) -> list[int]:
    """The code bits of each choice of all ranges but three."""
    ends = [64 * k // (2 * ranges) * 2 for k in range(1, ranges)] + [64]
    parts = [(1 << b) - (1 << a) for a, b in zip([0, *ends], ends, strict=False)]
    return [sum(some) for some in combinations(parts, ranges - DISTANCE)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingled(text: str | None, words: int) -> np.ndarray:
    """The hashes of a text's shingles, in order."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    starts = [0, *accumulate(len(p) + 1 for p in parts)][:-1]
    ends = [a + len(p) for a, p in zip(starts, parts, strict=True)]
    k = min(words, len(parts)) - 1
    return np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[k:], strict=False)), np.uint64, len(parts) - k)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint of a text: each bit is set if over half of the shingles' hashes have it."""
    hashes = shingled(text, words)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprinted(documents: DataFrame, text_col: str = "text", words: int = WORDS, fingerprint_col: str = "fingerprint") -> DataFrame:
    """documents with the fingerprint as a (signed) long."""
    return add_columns(documents, text_col, [T.StructField(fingerprint_col, T.LongType())], lambda texts: [[signed(fingerprint(t, words)) for t in texts]])


def embedded(fp: Column) -> Column:
    """The bit counts of the two-bit segments, in unary code."""
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(F.lit(LOW)).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(F.lit(LOW)), 1))


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the fingerprints of one cell as all its links do: breadth first, each found once."""
    high = fps >> np.uint64(1)
    low = np.uint64(LOW)
    codes = ((fps | high) & low) | ((fps & high & low) << np.uint64(1))
    left, out = np.arange(1, len(fps)), []
    queue, at = [0], 0
    while True:
        if at == len(queue):
            if not len(left):
                return out
            queue.append(int(left[0]))
            left = left[1:]
        i = queue[at]
        at += 1
        if len(left):
            maybe = np.bitwise_count(codes[left] ^ codes[i]) <= DISTANCE
            near = left[maybe]
            near = near[np.bitwise_count(fps[near] ^ fps[i]) <= DISTANCE]
            if len(near):
                out += [(int(fps[i]), int(fps[k])) for k in near]
                queue += near.tolist()
                left = left[~np.isin(left, near, assume_unique=True)]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each run of equal (grid, cell, pair); the rows come sorted by them."""

    def found(heads: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero((heads[1:] != heads[:-1]).any(1)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fps)]))
        out: list[tuple[int, int]] = []
        for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            out += forest(np.unique(fps[a:b]))
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(1) if len(pairs) else pairs[:, 0]), pa.array(pairs.max(1) if len(pairs) else pairs[:, 1])], ["u", "v"])

    heads, fps = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        new = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], 1)
        heads, fps = np.concatenate((heads, new)), np.concatenate((fps, batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)))
        if not len(fps):
            continue
        last = int(np.argmax((heads == heads[-1]).all(1)))  # the last run may go on in the next batch
        if last:
            yield found(heads[:last], fps[:last])
            heads, fps = heads[last:], fps[last:]
    if len(fps):
        yield found(heads, fps)


def links(fingerprints: DataFrame, block: int = BLOCK, ranges: int | None = None) -> DataFrame:
    """Distinct links u < v that connect distinct fingerprints (column fp) as all links within DISTANCE do."""
    code = embedded(F.col("fp"))
    ranges = ranges or ranges_for(fingerprints.count())
    cells = fingerprints.select("fp", F.posexplode(F.array(*[code.bitwiseAND(F.lit(signed(m))) for m in masks(ranges)])).alias("grid", "cell"))
    hot = stored(cells.groupBy("grid", "cell").count().filter(F.col("count") > block), "cells")
    n = hot.count()
    if n:
        few = n <= MOST_CELLS
        blocks = F.coalesce(F.ceil(F.col("count") / block), F.lit(1))
        cells = cells.join(F.broadcast(hot) if few else hot, ["grid", "cell"], "left").withColumn("blocks", blocks)
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        pair = lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j)
        cells = cells.select("grid", "cell", "fp", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), pair)).alias("pair"))
    else:
        cells = cells.withColumn("pair", F.lit(0).cast("long"))
    cells = cells.select(F.col("grid").cast("long"), "cell", "pair", "fp").repartition("grid", "cell", "pair").sortWithinPartitions("grid", "cell", "pair")
    return cells.mapInArrow(_links, "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """The least vertex (root) reachable from each vertex v of edges (u, v). Each round is written to the shared folder."""
    spark = edges.sparkSession
    edges = stored(edges, "links")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = stored(both.groupBy(F.col("u").alias("v")).agg(F.least(F.first("u"), F.min("v")).alias("root")), "labels")
    while True:  # the sum of the labels falls in every round but the last
        near = both.join(labels, "v").groupBy(F.col("u").alias("v")).agg(F.min("root").alias("near"))
        told = labels.join(near, "v").select("v", "root", F.least("root", "near").alias("next"))
        told = stored(told, "told")
        new = told.join(told.select(F.col("v").alias("next"), F.col("next").alias("jump")), "next").select("v", F.least("next", "jump").alias("next"), "root")
        new = stored(new, "labels")
        changed = new.filter("next <> root").limit(1).count()
        discard(spark, told)
        discard(spark, labels)
        labels = new.select("v", F.col("next").alias("root"))
        if not changed:
            discard(spark, edges)
            return labels


def near_duplicates(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = WORDS, component_col: str = "component_id", fingerprint_col: str = "fingerprint") -> DataFrame:
    """Per row of documents: its id, fingerprint (16 hex digits) and component_id, the least id that links reach."""
    rows = documents.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    rows = stored(fingerprinted(rows, "text", words, "fp").select("id", "fp"), "fingerprints")
    firsts = stored(rows.groupBy("fp").agg(F.min("id").alias("first")), "firsts")
    labels = components(links(firsts.select("fp")))
    linked = labels.join(firsts.withColumnRenamed("fp", "v"), "v")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    told = labels.join(least, "root").select(F.col("v").alias("fp"), "least")
    ids = stored(firsts.join(told, "fp", "left").select("fp", F.coalesce("least", "first").alias("component")), "components")
    return rows.join(ids, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias(fingerprint_col), F.col("component").alias(component_col))


def banded(hashes: np.ndarray) -> list[int]:
    """The cells of a set of shingles: a hash of each `ROWS` of its least values under `BANDS` * `ROWS` permutations."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, (hashes[at : at + (1 << 12), None] * TIMES + PLUS).min(0))
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    return [signed(xxhash.xxh64_intdigest(r.tobytes(), k)) for k, r in enumerate(rows)]


def _printed(texts: list) -> list[list]:
    """Fingerprint, digest and size of the set of shingles, and its cells; texts without words have none."""
    out: list[list] = [[], [], [], []]
    for t in texts:
        kinds = np.unique(shingled(t, SHINGLE))
        out[0].append(signed(fingerprint(t)))
        out[1].append(signed(xxhash.xxh64_intdigest(kinds.astype("<u8").tobytes())))
        out[2].append(len(kinds))
        out[3].append(banded(kinds) if len(kinds) else [])
    return out


def like_forest(fps: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of sets with a Jaccard similarity of `LIKE` that connect those of one cell as all such links do."""
    sizes = np.array([len(x) for x in sets])
    kinds, held = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [held[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    mark = np.zeros(len(kinds), np.int64)
    left, out = np.arange(1, len(sets)), []
    queue, at = [0], 0
    while len(left) or at < len(queue):
        if at == len(queue):
            queue.append(int(left[0]))
            left = left[1:]
        i = queue[at]
        at += 1
        top, below = LIKE
        maybe = left[np.minimum(sizes[left], sizes[i]) * below >= np.maximum(sizes[left], sizes[i]) * top]
        if not len(maybe):
            continue
        mark[own[i]] = 1
        if 4 * len(maybe) > len(sets):
            sums = np.concatenate(([0], np.cumsum(mark[held])))
            both = sums[ends[maybe]] - sums[ends[maybe] - sizes[maybe]]
        else:
            both = np.array([mark[own[k]].sum() for k in maybe])
        mark[own[i]] = 0
        near = maybe[both * below >= (sizes[maybe] + sizes[i] - both) * top]
        if len(near):
            out += [(int(fps[i]), int(fps[k])) for k in near if fps[i] != fps[k]]
            queue += near.tolist()
            left = left[~np.isin(left, near, assume_unique=True)]
    return out


def _likes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each run of equal (cell, pair); the rows come sorted by them."""
    run: tuple | None = None
    fps: list[int] = []
    sets: list[np.ndarray] = []

    def found() -> pa.RecordBatch:
        pairs = np.array(like_forest(np.array(fps), sets) if len(fps) > 1 else [], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))] if len(pairs) else [pa.array([], pa.int64())] * 2, ["u", "v"])

    for batch in batches:
        kinds = batch.column(3)
        for k, (cell, pair, fp) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            if (cell, pair) != run:
                if len(fps) > 1:
                    yield found()
                run, fps, sets = (cell, pair), [], []
            fps.append(fp)
            sets.append(np.array(kinds[k].values.to_numpy(zero_copy_only=False)))
    yield found()


def likes(cells: DataFrame, texts: DataFrame, labels: DataFrame | None = None, block: int = LIKE_BLOCK) -> DataFrame:
    """Links u < v of fingerprints of texts (row, text) that connect them as all pairs with like sets of shingles do.

    cells: row, fp, size (of the set) and cell. Cells with the same members are one, as are, with labels (v and root, of
    fingerprints), cells whose members are linked already. Those of over `block` members or `LIKE_BYTES` are cut into
    pairs of blocks.
    """
    roots = cells if labels is None else cells.join(labels.withColumnRenamed("v", "fp"), "fp", "left")
    root = F.col("row") if labels is None else F.coalesce("root", "fp")
    sums = roots.groupBy("cell").agg(F.count("*").alias("n"), F.sum(8 * F.col("size")).alias("bytes"), F.min("row").alias("a"), F.max("row").alias("b"), F.bit_xor(F.xxhash64("row")).alias("x"), (F.min(root) != F.max(root)).alias("open"))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / LIKE_BYTES))
    kept = sums.filter("n > 1 and open").groupBy("n", "a", "b", "x").agg(F.min("cell").alias("cell"), F.first(blocks).alias("blocks")).select("cell", "blocks")
    own = F.pmod(F.xxhash64("row"), F.col("blocks"))
    pair = lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j)
    members = cells.join(kept, "cell").select("row", "fp", "cell", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), pair)).alias("pair"))
    members = stored(members, "members")
    # The same join at every size: no broadcast that a larger table would turn into a shuffle of the texts.
    few = stored(members.select("row").distinct(), "wanted")
    wanted = texts.join(few.hint("shuffle_hash"), "row", "left_semi")
    sets = add_columns(wanted, "text", [T.StructField("kinds", T.ArrayType(T.LongType()))], lambda some: [[np.unique(shingled(t, SHINGLE)).view(np.int64) for t in some]])
    told = members.join(sets.select("row", "kinds"), "row").select("cell", "pair", "fp", "kinds")
    found = stored(told.repartition("cell", "pair").sortWithinPartitions("cell", "pair").mapInArrow(_likes, "u bigint, v bigint").distinct(), "likes")
    for done in (members, few):
        discard(texts.sparkSession, done)
    return found


def near_deduplicated(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """documents with one row of each component: the one with the least id.

    Links are those of near_duplicates, and pairs of texts whose sets of five-word shingles have a Jaccard similarity
    of 0.8 or more, which differ in far more bits. The cells of the first bands are held against each other first: they
    connect most copies, and of the other bands only cells with unconnected members are left to do.

    Rows, not ids, are kept: those that share an id but no component all stay, and of those that share both the one
    with the least hash of its text does. A row without an id comes after all with one.
    """
    spark = documents.sparkSession
    id_col, text_col = named(documents, id_col), named(documents, text_col)
    names = [f"c{i}" for i in range(len(documents.columns))]
    inner = [F.col(quoted(c)).alias(n) for c, n in zip(documents.columns, names, strict=True)]
    rows = stored(documents.select(*inner, F.monotonically_increasing_id().alias("row")), "rows")
    id_of, text_of = (F.col(names[documents.columns.index(c)]).alias(n) for c, n in ((id_col, "id"), (text_col, "text")))
    fields = [T.StructField("fp", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    prints = add_columns(rows.select("row", id_of, text_of), "text", fields, _printed)
    prints = stored(prints.select("row", "id", F.xxhash64("text").alias("tie"), *[f.name for f in fields]), "prints")
    order = F.struct(F.col("id").isNull().alias("lost"), "id", "tie", "row")
    firsts = stored(prints.groupBy("fp").agg(F.min(order).alias("first")), "firsts")
    # Texts with equal sets are one row.
    one = prints.groupBy("fp", "digest").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    cells = stored(one.select("row", "fp", "size", F.posexplode("bands").alias("band", "cell")), "cells")
    texts = rows.select("row", text_of)
    some = likes(cells.filter(F.col("band") < BEFORE), texts)
    before = components(links(firsts.select("fp")).unionByName(some).distinct())
    more = likes(cells.filter(F.col("band") >= BEFORE), texts, before)
    labels = components(before.select(F.col("root").alias("u"), "v").unionByName(more).filter("u <> v").distinct())
    component = F.coalesce("root", "fp")
    kept = firsts.join(labels.withColumnRenamed("v", "fp"), "fp", "left").groupBy(component).agg(F.min("first").alias("first"))
    kept = stored(kept.select("first.row"), "kept")
    for done in (prints, firsts, cells, some, before, more, labels):
        discard(spark, done)
    return rows.join(kept.hint("shuffle_hash"), "row", "left_semi").select(*[F.col(n).alias(c) for c, n in zip(documents.columns, names, strict=True)])
