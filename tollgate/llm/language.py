"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent.

Subwords are the runs of one, two and three characters of the lower-cased text, with anything but letters as one space;
they are hashed to buckets. A text is the mean of its subwords' embeddings; a linear softmax names the language. The
two are trained in numpy on a bounded sample of the labelled rows (about `per_language` rows each, picked by a hash of
the text), each as a whole and as a few short stretches, so that short texts are known too. The mean and the softmax
are linear up to the end, so scoring sums the buckets' scores.

A tenth of the sample is kept from training: it sets the temperature of the softmax, and the score below which a text
is rejected. That is the largest, up to `reject_most`, at which no more than one in a thousand right answers is lost.

Cases: null and empty texts, and texts without a letter, are `und` with score 0 and rejected; ties go to the language
first in the alphabet; repeated rows are scored alike; with no labelled row all texts are `und`; very long texts are
taken in parts; other columns are kept, except those named as the new ones, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.llm.common import add_columns, quoted

BUCKETS = 1 << 15
DIM = 16
PER_LANGUAGE = 800
EPOCHS = 6
REJECT_MOST = 0.4
UNKNOWN = "und"
PART = 1 << 20

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def subwords(text: str) -> Iterator[np.ndarray]:
    """The buckets of a text's subwords, in parts; nothing if it has no letter."""
    for at in range(0, len(text), PART):
        codes = np.frombuffer(text[at : at + PART].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        known = letters()[codes]
        if not known.any():
            continue
        codes = np.where(known, codes, 32).astype(np.uint64)
        codes = np.concatenate(([32], codes[(codes != 32) | (np.concatenate(([0], codes[:-1])) != 32)], [32])).astype(np.uint64)
        one, two, three = codes * np.uint64(0x9E3779B97F4A7C15), codes * np.uint64(0xC2B2AE3D27D4EB4F), codes * np.uint64(0x165667B19E3779F9)
        pair = one[:-1] + two[1:]
        mixed = np.concatenate((one[codes != 32], pair * np.uint64(0xFF51AFD7ED558CCD), (pair[:-1] + three[2:]) * np.uint64(0xC4CEB9FE1A85EC53)))
        yield ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  #: of each bucket, for each language
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, probability, and whether to reject."""
        total, n = np.zeros(len(self.languages)), 0
        for ids in subwords(text or "") if self.languages else ():
            total += self.scores[ids].sum(0)
            n += len(ids)
        if not n:
            return UNKNOWN, 0.0, True
        p = softmax((total / n + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.reject_below)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate(list(subwords(text)) or [np.zeros(0, np.int64)])
    return np.unique(ids, return_counts=True)


def stretches(text: str) -> list[str]:
    """The text, and a few stretches of 1 to 12 words at places that its length sets."""
    words = text.split()
    rng = np.random.default_rng(len(text))
    return [text] + [" ".join(words[(at := int(rng.integers(len(words)))) : at + int(rng.integers(1, 13))]) for _ in range(3 if len(words) > 3 else 0)]


def fit(labelled: DataFrame, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE, dim: int = DIM, epochs: int = EPOCHS, reject_most: float = REJECT_MOST, seed: int = 7) -> Model:
    """A model of about per_language rows of each language of labelled; their subwords are counted by the executors."""
    rows = labelled.select(F.col(quoted(text_col)).alias("text"), F.col(quoted(lang_col)).alias("lang")).filter("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))]), F.col("lang"))
    place = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 30)) / F.lit(1 << 30)
    picked = rows.filter(place < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = [counted(x) for x in stretches(text)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(made)), pa.array([a.astype(np.int32).tobytes() for a, _ in made]), pa.array([b.astype(np.int32).tobytes() for _, b in made])], ["lang", "ids", "counts"])

    languages = sorted(sizes)
    number = {x: k for k, x in enumerate(languages)}
    found = [(number[r.lang], np.frombuffer(r.ids, np.int32), np.frombuffer(r.counts, np.int32)) for r in picked.mapInArrow(count, "lang string, ids binary, counts binary").repartition(8).toLocalIterator() if r.ids]
    found = sorted(found, key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(found))
    held, used = order[: len(order) // 10], order[len(order) // 10 :]
    table, weights, bias = rng.normal(0, 0.1, (BUCKETS, dim)), np.zeros((dim, len(languages))), np.zeros(len(languages))
    total = epochs * len(used)
    for step in range(total):
        lang, ids, counts = found[rng.choice(used) if step >= len(used) else used[step]]
        rate = 0.5 * (1 - step / total)
        share_of = counts / counts.sum()
        mean = share_of @ table[ids]
        error = softmax(mean @ weights + bias)
        error[lang] -= 1
        back = weights @ error
        weights -= rate * np.outer(mean, error)
        bias -= rate * 0.1 * error
        table[ids] -= (rate * len(ids) ** 0.5) * np.outer(share_of, back)
    scores = table @ weights
    temperature, reject_below = calibrated([(lang, (counts / counts.sum()) @ scores[ids] + bias) for lang, ids, counts in (found[k] for k in held)], reject_most)
    return Model(languages, scores.astype(np.float32), bias, temperature, reject_below)


def calibrated(held: list[tuple[int, np.ndarray]], reject_most: float) -> tuple[float, float]:
    """The temperature of the best likelihood on the held rows, and the score below which to reject."""
    if not held:
        return 1.0, 0.0
    right, raw = np.array([k for k, _ in held]), np.array([x for _, x in held])
    loss = lambda t: -np.log(softmax(raw / t)[np.arange(len(right)), right] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    p = softmax(raw / temperature)
    sure = np.sort(p.max(1)[p.argmax(1) == right])
    return temperature, float(min(reject_most, sure[len(sure) // 1000])) if len(sure) else 0.0


def identify(documents: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", rejected_col: str = "rejected") -> DataFrame:
    """documents with the predicted language, its probability, and whether the model rejects the text."""
    bundle = documents.sparkSession.sparkContext.broadcast(model)

    def make(texts: list) -> list[list]:
        return [list(x) for x in zip(*map(bundle.value.predict, texts), strict=True)] or [[], [], []]

    return add_columns(documents, text_col, [T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType()), T.StructField(rejected_col, T.BooleanType())], make)


def understood(documents: DataFrame, model: Callable[[], Model] | Model, text_col: str = "text") -> DataFrame:
    """documents without those that the model rejects, with their own columns."""
    inner = documents.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(documents.columns)])
    out = identify(inner, model() if callable(model) else model, f"c{documents.columns.index(text_col)}", "lang_out", "score_out", "rejected_out")
    return out.filter(~F.col("rejected_out")).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(documents.columns)])


def held_out(doc_id: Column, n: int, k: int) -> Column:
    """Whether crc32 of the id as text is k modulo n; false for a null id."""
    from tollgate.llm.common import crc_mod

    return F.coalesce(crc_mod(doc_id, n) == k, F.lit(False))
