"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Words are the runs between white space. The `VOCABULARY` most frequent words of the training sample are known; any other
word stands for its shape (capitals, small letters, digits, other characters as they are; runs once), hashed. Each of
these has a sparse random index vector; its word vector is the sum of the index vectors of the words around it in the
sample, at length one, plus its own. A document is the mean of its words' vectors with a few statistics of the words;
a network with one hidden layer gives the score, and a temperature fitted on a tenth of the sample calibrates it.

The sample is bounded: about `rows` labelled rows, and of their ids, in the order of a hash, those whose texts still fit
into `most_bytes`.
Scores are computed from whole texts.

Cases: null and empty texts are scored by the network as a text without words; null labels aren't learned from; rows
that repeat, in documents or labels, count as often as they are there; with no labelled row, or only one label, every
score is the share of label 1 (one half without labels); an empty table gives an empty one; other columns are kept,
except those named as the new ones, which are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.llm.common import add_columns, quoted

ROWS = 5000
MOST_BYTES = 64 << 20
VOCABULARY, SHAPES = 8192, 512
DIM, FILLED, AROUND = 96, 6, 2
HIDDEN, EPOCHS = 32, 40
MEMO = 200_000
LETTERS = [(re.compile("[^\\W\\d_]+"), lambda m: "X" if m[0].isupper() else "Xx" if m[0][0].isupper() else "x"), (re.compile(r"\d+"), "d"), (re.compile(r"(.)\1+"), r"\1")]


class Words(dict):
    """The row of each word in the table of vectors; unknown words by shape, remembered up to MEMO of them."""

    def __init__(self, known: list[str]):
        super().__init__({w: k for k, w in enumerate(known)})
        self.known, self.n = known, len(known)

    def __missing__(self, word: str) -> int:
        if len(self) > self.n + MEMO:
            self.clear()
            self.update({w: k for k, w in enumerate(self.known)})
        shape = word
        for pattern, by in LETTERS:
            shape = pattern.sub(by, shape)
        self[word] = out = VOCABULARY + zlib.crc32(shape.encode("utf-8", "surrogatepass")) % SHAPES
        return out


@dataclass
class Model:
    known: list[str]
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    constant: float | None = None

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        if not hasattr(self, "words"):
            self.words = Words(self.known)
        x = (pooled(text or "", self.words, self.vectors) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-forward(x[None], self.layers)[1][0] / self.temperature)))


def pooled(text: str, words: Words, vectors: np.ndarray) -> np.ndarray:
    """The mean vector of a text's words, its length, and statistics of the words."""
    tokens = text.split()
    if not tokens:
        return np.zeros(DIM + 6)
    rows = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
    own, counts = np.unique(rows, return_counts=True)
    mean = (counts / len(rows)) @ vectors[own]
    lines = text.split("\n")
    distinct = len(set(tokens))
    return np.concatenate((mean, [np.sqrt((mean**2).sum()), distinct / len(tokens), np.log1p(len(tokens)), distinct / np.sqrt(len(tokens)), (rows[1:] == rows[:-1]).mean() if len(rows) > 1 else 0, len(set(lines)) / len(lines)]))


def forward(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    w, b, v, c = layers
    hidden = np.tanh(x @ w + b)
    return hidden, hidden @ v + c[0]


def index_vectors(rng: np.random.Generator, n: int) -> np.ndarray:
    """Sparse vectors of FILLED ones and minus ones."""
    out = np.zeros((n, DIM), np.float32)
    places = rng.random((n, DIM)).argpartition(FILLED, 1)[:, :FILLED]
    np.put_along_axis(out, places, rng.choice(np.array([-1, 1], np.float32), (n, FILLED)), 1)
    return out


def word_vectors(texts: list[str], rng: np.random.Generator) -> tuple[list[str], np.ndarray]:
    counts = Counter()
    for text in texts:
        counts.update(text.split())
    known = [w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n > 1]
    words, own = Words(known), index_vectors(rng, VOCABULARY + SHAPES)
    around = np.zeros_like(own)
    for text in texts:
        tokens = text.split()
        rows = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
        for step in range(1, AROUND + 1):
            np.add.at(around, rows[step:], own[rows[:-step]])
            np.add.at(around, rows[:-step], own[rows[step:]])
    return known, around / np.maximum(np.sqrt((around**2).sum(1, keepdims=True)), 1e-9) + own / np.sqrt(FILLED)


def fit(labelled: DataFrame, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = ROWS, most_bytes: int = MOST_BYTES, seed: int = 7) -> Model:
    """A model of a bounded sample of labelled (ids and 0/1 labels), with the texts that documents has for the ids."""
    spark = documents.sparkSession
    labels = labelled.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    share = rows / max(1, labels.count())
    picked = labels.filter(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / F.lit(1 << 30) < share).orderBy(F.xxhash64("id")).limit(2 * rows).collect()  # at most 2 * rows small rows
    picked = spark.createDataFrame([(r.id, r.label) for r in picked], labels.schema)
    texts = documents.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).filter("text is not null")
    total = 0
    sizes = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.sum(F.octet_length("text").cast("long")).alias("n"))
    held_ids = set()
    for r in sorted(sizes.collect(), key=lambda r: (zlib.crc32(str(r.id).encode()), str(r.id))):  # a row for each id
        if total + r.n <= most_bytes:
            total += r.n
            held_ids.add(r.id)
    kept = [(r.id, r.label) for r in picked.collect() if r.id in held_ids]
    picked = spark.createDataFrame(sorted(set(kept)), labels.schema)
    found = sorted((r.text, r.label) for r in texts.join(F.broadcast(picked), "id").select("text", "label").collect())
    y = np.array([label for _, label in found], float)
    if not len(y) or y.min() == y.max():
        return Model([], np.zeros((0, 0)), np.zeros(0), np.ones(0), [], 1.0, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 10], order[len(y) // 10 :]
    known, vectors = word_vectors([found[k][0] for k in used], rng)
    words = Words(known)
    x = np.array([pooled(text, words, vectors) for text, _ in found])
    mean, scale = x[used].mean(0), x[used].std(0) + 1e-3
    x = (x - mean) / scale
    layers = trained(x[used], y[used], rng)
    raw = forward(x[held], layers)[1]
    loss = lambda t: np.logaddexp(0, np.where(y[held] > 0, -raw, raw) / t).mean()
    temperature = float(min(np.geomspace(0.25, 8, 61), key=loss)) if len(held) else 1.0
    return Model(known, vectors.astype(np.float32), mean, scale, layers, temperature)


def trained(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4) -> list[np.ndarray]:
    """Two layers, by stochastic gradients with moments."""
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            k = order[at : at + batch]
            hidden, raw = forward(x[k], layers)
            error = (1 / (1 + np.exp(-raw)) - y[k]) / len(k)
            back = np.outer(error, layers[2]) * (1 - hidden**2)
            grads = [x[k].T @ back + decay * layers[0], back.sum(0), hidden.T @ error + decay * layers[2], np.array([error.sum()])]
            step += 1
            for p, g, m, v in zip(layers, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (1 - epoch / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return layers


def scored(documents: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """documents with the probability of label 1."""
    bundle = documents.sparkSession.sparkContext.broadcast(model)
    return add_columns(documents, text_col, [T.StructField(score_col, T.DoubleType())], lambda texts: [[bundle.value.score(t) for t in texts]])
