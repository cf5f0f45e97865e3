"""Approximate nearest neighbours by a permutation index, for the largest inner product.

The vectors lie in blocks of about `block` rows, each an index of its own. Its pivots are a
spread-out choice from `SAMPLE` of its distinct vectors. A vector is represented by its `listed` nearest pivots in order; each of them has an inverted file with
the vectors that list it, and the place at which they do. A query reads the files of its own nearest pivots and adds up
the footrule distance to every vector that it meets there, a missing pivot counting as the place after the last; the
`rerank` vectors with the least distance are held against the query by the exact inner product. To make the largest inner
product the smallest distance, vectors get one more component that fills all norms up to the block's largest, and queries
get zero there.

Among more than `rerank` vectors of a block that hardly differ from each other, those found are as near but for what they
differ by, and may not be the nearest. As each block gives its own `rerank` candidates, recall is that of one block at every size of the table. Queries come in
batches, and a block and a batch are one task, so no task and no driver holds all of either. The best of the blocks are
merged by a ranked window. Equal vectors are one in the index and are told apart by id after the rerank, so copies take
no places from others.

Cases: null, empty or zero vectors and those with null or non-finite components take no part; vectors of another size
than the query's are no candidates, each size being a space of its own; a query with fewer candidates gets them all;
ties go to the smaller id; a row isn't its own neighbour; of rows that repeat an id, the least vector asks (sizes first),
and all are candidates of others, the nearest of them counting; an empty table gives an empty one; other columns are left
out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.llm.common import quoted

PIVOTS = 512
SAMPLE = 4096
LISTED = 64
RERANK = 768
BLOCK = 8192
BATCH = 16384
K = 20
FOUND = "query_id bigint, vec_id bigint, score double"
SEED = 42


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Columns id, v (array of floats or doubles) and dim of the rows that take part."""
    v = F.col(quoted(vector_col))
    if vectors.schema[vector_col].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim"))
    good = F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.coalesce(good, F.lit(False)) & F.col("id").isNotNull())


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of sample, each the one farthest from those before it."""
    norms = (sample**2).sum(1)
    picked, least = [0], np.full(len(sample), np.inf)
    for _ in range(min(n, len(sample)) - 1):
        least = np.minimum(least, norms - 2 * (sample @ sample[picked[-1]]) + norms[picked[-1]])
        least[picked] = -1
        picked.append(int(least.argmax()))
    return sample[picked]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, listed: int) -> np.ndarray:
    """The pivots nearest to each row, in order."""
    far = (pivots**2).sum(1) - 2 * (x @ pivots.T)
    if listed >= far.shape[1]:
        return np.argsort(far, axis=1, kind="stable")
    some = np.argpartition(far, listed - 1, axis=1)[:, :listed]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1)


class Block:
    """The index of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: int = PIVOTS, listed: int = LISTED):
        self.vectors, own = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, own.ravel()))
        self.ids = ids[order]
        self.starts = np.searchsorted(own.ravel()[order], np.arange(len(self.vectors) + 1))
        norms = (self.vectors**2).sum(1, keepdims=True)
        full = np.concatenate((self.vectors, np.sqrt(norms.max() - norms)), 1)
        self.pivots = spread(full[np.random.default_rng(SEED).permutation(len(full))[:SAMPLE]], pivots)
        self.listed = min(listed, len(self.pivots))
        flat = nearest_pivots(full, self.pivots, self.listed).ravel()
        # The inverted files one after the other: in each the vectors that list its pivot, and the places at which they do.
        order = np.argsort(flat, kind="stable")
        self.posted, self.places = order // self.listed, order % self.listed
        self.ends = np.searchsorted(flat[order], np.arange(len(self.pivots) + 1))

    def lists(self, queries: np.ndarray) -> np.ndarray:
        return nearest_pivots(np.concatenate((queries, np.zeros((len(queries), 1))), 1), self.pivots, self.listed)

    def candidates(self, own: np.ndarray, rerank: int) -> np.ndarray:
        """The vectors to rerank for a query with this list."""
        n = len(self.vectors)
        if n <= rerank:
            return np.arange(n)
        files = [slice(self.ends[p], self.ends[p + 1]) for p in own]
        # A pivot that both list, at places i and j, saves twice what is left behind the later one.
        saved = np.concatenate([self.listed - np.maximum(self.places[f], i) for i, f in enumerate(files)])
        far = np.bincount(np.concatenate([self.posted[f] for f in files]), saved, n) * -n + np.arange(n)
        return np.argpartition(far, rerank - 1)[:rerank]

    def search(self, query_id: int, query: np.ndarray, own: np.ndarray, k: int = K, rerank: int = RERANK) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the best k found."""
        kept = self.candidates(own, rerank)
        exact = (self.vectors[kept] * query).sum(1)
        order = np.lexsort((kept, -exact))[: k + 1 + int(np.count_nonzero(self.ids == query_id))]
        # All copies of vectors as near as the last one that may count: ties go by id.
        last = exact[order[-1]]
        order = np.flatnonzero(exact >= last)
        sizes = self.starts[kept[order] + 1] - self.starts[kept[order]]
        ids = np.concatenate([self.ids[self.starts[x] : self.starts[x + 1]] for x in kept[order]])
        scores = np.repeat(exact[order], sizes)
        best = np.lexsort((ids, -scores))
        ids, scores = ids[best], scores[best]
        _, first = np.unique(ids, return_index=True)
        first = np.sort(first[ids[first] != query_id])[:k]
        return ids[first], scores[first]


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rerank: int = RERANK, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """The k nearest found of each row for which is_query (over the column id) holds: query_id, rank, vec_id, score."""
    rows = usable(vectors, id_col, vector_col)
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / block).alias("blocks"), F.greatest(F.ceil(F.count_if(is_query) / batch), F.lit(1)).alias("batches"))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1))
    asking = rows.filter(is_query).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("one")).select("id", "one.v", "one.dim")
    asking = asking.select(F.col("id").alias("asker"), "v", "dim")
    asked = asking.join(sizes, "dim").select("dim", every("blocks").alias("block"), F.pmod(F.xxhash64("asker"), F.col("batches")).alias("batch"), F.col("asker").alias("id"), "v")
    index = rows.join(sizes, "dim").select("dim", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).alias("block"), every("batches").alias("batch"), "id", "v")

    def together(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(left) and len(right):
            here = Block(left.id.to_numpy(), np.stack(left.v.to_numpy()).astype(np.float64))
            queries = np.stack(right.v.to_numpy()).astype(np.float64)
            for i, q, own in zip(right.id.to_numpy(), queries, here.lists(queries), strict=True):
                ids, scores = here.search(i, q, own, k, rerank)
                out.append((np.full(len(ids), i), ids, scores))
        parts = zip(*out, strict=True) if out else [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, parts), strict=True)))

    key = ["dim", "block", "batch"]
    found = index.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(together, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
