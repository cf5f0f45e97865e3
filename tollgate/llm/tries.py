"""The prefix trie of conversations, built as a Patricia trie from sorted sequences.

A conversation is a sequence of turns; nodes are the distinct prefixes. Equal sequences are one row from the start.
Sequences are sorted by ranges, and in each range read in order: neighbours' common prefixes give the branch points, so
only branches, ends and leaves are created, on a stack that holds one path. When a point is closed, its aggregates are
complete; the unary nodes of the edge above it are then written out, by sums over the end of the edge.

A node of several ranges is a prefix of the first or the last sequence of each. These nodes, the spine, are written by
each range with what the range knows, and added up: their number is that of ranges times the turns of a sequence. All
others are complete within their range. Ids of members are hashed in order as they stream by; no list of them is built,
and no group of equal conversations or of equal first turns is gathered.

A prefix is known by two 64-bit hashes of its turns and their places.

Cases: a null role or text is the empty text; of turns with equal numbers the smaller role, then text, comes first, and
repeated rows are turns of their own; a null turn comes first; rows without conv_id are no conversation and are left out;
an empty table has no nodes, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.llm.common import discard, named, quoted, stored

#: Sequences of a range.
RANGE = 20_000
NOTHING = hashlib.sha256(b"").hexdigest()
NODES = "a bigint, b bigint, depth bigint, up_a bigint, up_b bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, ends string, size bigint, spine boolean, pid bigint, on_first boolean, on_last boolean"
NAMES = [x.split()[0] for x in NODES.split(", ")]


def ordered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 1), role and text of the turns of each conversation, in order."""
    conv, turn, role, text = (F.col(quoted(named(conversations, c))) for c in (conv_col, turn_col, role_col, text_col))
    clean = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = conversations.select(conv.cast("long").alias("conv"), turn.alias("turn"), clean(role).alias("role"), clean(text).alias("text")).filter("conv is not null")
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    return rows.select("conv", place.cast("long").alias("pos"), "role", "text")


def spliced(turns: DataFrame, conv: Column, n: Column, most: int) -> DataFrame:
    """turns of ordered(), with the first `n` (at most `most`) of each conversation replaced by those of conversation `conv`.

    conv and n are of the column conv. A conversation whose turns are all replaced by none keeps a row with a null pos.
    """
    heads = turns.filter(F.col("pos") <= most).select(F.col("conv").alias("base"), F.col("pos").alias("head_pos"), F.col("role").alias("head_role"), F.col("text").alias("head_text"))
    every = turns.groupBy("conv").agg(F.max("pos").alias("own")).select("conv", "own", conv.alias("base"), n.alias("n"))
    has = heads.groupBy("base").agg(F.max("head_pos").alias("has"))
    every = every.join(has, "base", "left").withColumn("put", F.least("n", F.coalesce("has", F.lit(0))).cast("long"))
    first = every.join(heads, "base").filter(F.col("head_pos") <= F.col("put")).select("conv", F.col("head_pos").alias("pos"), F.col("head_role").alias("role"), F.col("head_text").alias("text"))
    rest = turns.join(every.select("conv", "n", "put"), "conv").filter(F.col("pos") > F.col("n")).select("conv", (F.col("pos") - F.col("n") + F.col("put")).alias("pos"), "role", "text")
    none = every.filter((F.col("put") == 0) & (F.col("own") <= F.col("n"))).select("conv", F.lit(None).cast("long").alias("pos"), F.lit("").alias("role"), F.lit("").alias("text"))
    return first.unionByName(rest).unionByName(none)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, depth, first, n and ends of each run of equal sequences; rows (a, b, depth, conv) come sorted."""
    key, first, n, digest = None, 0, 0, None
    for batch in batches:
        out: list[tuple] = []
        for a, b, depth, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (a, b, depth) != key:
                if key:
                    out.append((*key, first, n, digest.hexdigest()))
                key, first, n, digest = (a, b, depth), conv, 0, hashlib.sha256()
            digest.update(b",%d" % conv if n else b"%d" % conv)
            n += 1
        yield _batch(out, ["a", "b", "depth", "first", "n", "ends"], {"ends": pa.string()})
    if key:
        yield _batch([(*key, first, n, digest.hexdigest())], ["a", "b", "depth", "first", "n", "ends"], {"ends": pa.string()})


def _batch(rows: list[tuple], names: list[str], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(x, pa.int64())) for k, x in enumerate(names)], names)


def sequences(turns: DataFrame) -> DataFrame:
    """The distinct sequences of turns (conv, pos, role, text): seq (structs of two hashes and the code points of the
    text), first (the least conv), n (convs) and ends (the hash of the convs)."""
    empty = F.col("pos").isNull()
    mark = lambda salt: F.when(empty, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(salt), "pos", "role", "text"))
    rows = stored(turns.select("conv", "pos", mark("a").alias("a"), mark("b").alias("b"), F.length("text").cast("long").alias("size")), "turns")
    sums = rows.groupBy("conv").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count("pos").alias("depth"))
    keys = sums.select("a", "b", "depth", "conv").repartition("a", "b", "depth").sortWithinPartitions("a", "b", "depth", "conv")
    kinds = stored(keys.mapInArrow(_ends, "a bigint, b bigint, depth bigint, first bigint, n bigint, ends string"), "sequences")
    listed = rows.filter("pos is not null").join(kinds.select(F.col("first").alias("conv")), "conv", "left_semi")
    seq = F.transform(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "size"))), lambda t: F.struct(t.a.alias("a"), t.b.alias("b"), t["size"].alias("size")))
    lists = listed.groupBy(F.col("conv").alias("first")).agg(seq.alias("seq"))
    none = F.array().cast("array<struct<a:bigint,b:bigint,size:bigint>>")
    return kinds.join(lists, "first", "left").select("first", "n", "ends", F.coalesce("seq", none).alias("seq"))


def _trie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each range; rows (pid, before, behind, seq, first, n, ends) come sorted by pid and seq.

    before and behind: the turns that the first sequence shares with the range before, and the last with that behind.
    """
    out: list[tuple] = []
    pid = None
    # The open path: its turns with prefix hashes; points on it are [depth, conv, convs, children, leaves, saved, ends].
    path: list[tuple[int, int, int]] = []
    sums: list[tuple[int, int]] = [(0, 0)]
    points: list[list] = []
    like_first = before = behind = 0

    def spine(depth: int, last: bool) -> bool:
        return not depth or depth <= before and depth <= like_first or last and depth <= behind

    def close(last: bool = False) -> None:
        """Write the lowest open point and the unary nodes above it, and give the point over them what it adds up to."""
        depth, conv, convs, children, leaves, saved, ends = points.pop()
        over = points[-1][0] if points else -1
        for d in range(depth, over, -1):  # below the point's own depth, the nodes of the edge
            on = spine(d, last)
            size = path[d - 1][2] if d else 0
            if not on:
                saved += (convs - 1) * size
                leaves += d == depth and not children
            (a, b), (up_a, up_b) = sums[d], sums[d - 1] if d else (None, None)
            out.append((a, b, d, up_a, up_b, conv, convs, children, leaves, saved, ends, size, on, pid, on and d <= like_first, on and last))
            children, ends = (0 if on else 1), None
        if points:
            p = points[-1]
            p[1], p[2], p[3], p[4], p[5] = min(p[1], conv) if p[2] else conv, p[2] + convs, p[3] + children, p[4] + leaves, p[5] + saved

    def done() -> Iterator[pa.RecordBatch]:
        if out:
            kinds = {"ends": pa.string(), **dict.fromkeys(("spine", "on_first", "on_last"), pa.bool_())}
            yield _batch(out, NAMES, kinds)
            out.clear()

    for batch in batches:
        for now, share_before, share_behind, seq, first, n, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            turns = [(t["a"], t["b"], t["size"]) for t in seq]
            if now != pid:
                while points:
                    close(last=True)
                pid, before, behind, path, sums = now, share_before, share_behind, [], [(0, 0)]
                points.append([0, 0, 0, 0, 0, 0, None])
                like_first = len(turns)
            else:
                shared = 0
                while shared < len(path) and shared < len(turns) and path[shared][:2] == turns[shared][:2]:
                    shared += 1
                while points[-1][0] > shared:
                    if points[-2][0] < shared:  # a new branch on the edge
                        points.insert(-1, [shared, 0, 0, 0, 0, 0, None])
                    close()
                like_first = min(like_first, shared)
                del path[shared:], sums[shared + 1 :]
            for t in turns[len(path) :]:
                path.append(t)
                sums.append((sums[-1][0] ^ t[0], sums[-1][1] ^ t[1]))
            if points[-1][0] < len(turns):
                points.append([len(turns), 0, 0, 0, 0, 0, None])
            p = points[-1]
            p[1], p[2], p[6] = first, n, ends
            if len(out) >= 50_000:
                yield from done()
    while points:
        close(last=True)
    yield from done()


def trie(turns: DataFrame, per_range: int = RANGE) -> DataFrame:
    """The nodes of the trie of conversations with turns (conv, pos, role, text; a null pos: no turns).

    conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the subtree, the
    code points of each node's last text for each member but one) and ends_sha256 (of the members that end here).
    """
    spark = turns.sparkSession
    rows = stored(sequences(turns), "sequences")
    ranges = max(1, -(-rows.count() // per_range))
    order = rows.repartitionByRange(ranges, "seq") if ranges > 1 else rows.coalesce(1)
    dealt = stored(order.withColumn("pid", F.spark_partition_id().cast("long")), "ranges")
    # Ranges are few: their first and last sequences tell what neighbours share.
    edges = dealt.groupBy("pid").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    near = Window.orderBy("pid")
    same = lambda x, y: F.size(F.filter(F.zip_with(F.col(x), F.col(y), lambda s, t: F.coalesce((s.a == t.a) & (s.b == t.b), F.lit(False))), lambda s: s))
    # Hashes hold the places of turns, but equal turns may come again behind a difference: count up to the first one.
    unlike = lambda x, y: F.array_position(F.zip_with(F.col(x), F.col(y), lambda s, t: F.coalesce((s.a == t.a) & (s.b == t.b), F.lit(False))), False)
    shared = lambda x, y: F.coalesce(F.when(unlike(x, y) > 0, unlike(x, y) - 1).otherwise(same(x, y)), F.lit(0)).cast("long")
    edges = edges.withColumns({"was": F.lag("high").over(near), "next": F.lead("low").over(near)})
    edges = edges.select("pid", shared("was", "low").alias("before"), shared("high", "next").alias("behind"))
    sorted_rows = dealt.join(F.broadcast(edges), "pid").select("pid", "before", "behind", "seq", "first", "n", "ends").repartition("pid").sortWithinPartitions("pid", "seq")
    nodes = stored(sorted_rows.mapInArrow(_trie, NODES), "nodes")
    whole = nodes.filter("not spine").select("a", "b", "depth", "up_a", "up_b", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends")
    parts = nodes.filter("spine")
    keys = ["a", "b", "depth"]
    spine = parts.groupBy(*keys).agg(F.first("up_a").alias("up_a"), F.first("up_b").alias("up_b"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.max("ends").alias("ends"), F.max("size").alias("size"), F.min("pid").alias("owner"))
    spine = stored(spine, "spine")
    below = spine.filter("depth > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("more"))
    # What a spine node saves itself counts once, along the path of one range, for all nodes above it.
    own = parts.join(spine.select(*keys, (F.greatest(F.col("n_convs") - 1, F.lit(0)) * F.col("size")).alias("own"), "owner"), keys)
    mine = F.col("owner") == F.col("pid")
    first = own.filter("on_first").select("pid", F.lit(0).alias("way"), *keys, F.when(mine, F.col("own")).otherwise(0).alias("own"))
    last = own.filter("on_last").select("pid", F.lit(1).alias("way"), *keys, F.when(mine & ~F.col("on_first"), F.col("own")).otherwise(0).alias("own"))
    down = Window.partitionBy("pid", "way").orderBy(F.desc("depth"))
    added = first.unionByName(last).select(*keys, F.sum("own").over(down).alias("own")).groupBy(*keys).agg(F.sum("own").alias("own"))
    spine = spine.join(below, keys, "left").join(added, keys, "left")
    children = F.col("n_children") + F.coalesce("more", F.lit(0))  # none: the root of turnless conversations
    spine = spine.select(*keys, "up_a", "up_b", "conv_id", "n_convs", children.alias("n_children"), F.when(children == 0, 1).otherwise(F.col("n_leaves")).alias("n_leaves"), (F.col("saved") + F.coalesce("own", F.lit(0))).alias("saved"), "ends")
    every = stored(whole.unionByName(spine), "trie")
    for done in (rows, dealt, nodes):
        discard(spark, done)
    ups = every.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    out = every.join(ups, ["up_a", "up_b", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))
