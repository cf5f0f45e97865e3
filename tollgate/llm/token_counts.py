"""Token counts with a digest cache.

The cache is a table of (content digest, count) in one folder for each tokenizer version, which is the digest of the
vocabulary file and the library's version. Contents are joined to it by digest; only distinct contents that it lacks
are encoded, with the tokenizer's own library, and appended.

Cases: null counts as the empty text, which has no tokens; repeated texts are encoded once; a digest that concurrent
runs have appended twice counts once; an empty table gives an empty one; other columns are kept, except those named as
the new ones, which are replaced. Copies meet in one row per task before they are shuffled, and the join back to the
documents can be split where one content holds many rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm.common import quoted, slices, stored

CACHE = "digest binary, n_tokens bigint"
#: Words whose counts a worker remembers; it bounds memory only.
MEMO = 300_000


def version_of(file: str) -> str:
    """Digest of a vocabulary file and of the version of the library that reads it."""
    import sentencepiece
    import tokenizers

    library = sentencepiece if file.endswith(".model") else tokenizers
    return hashlib.sha256(Path(file).read_bytes() + f"{library.__name__} {library.__version__}".encode()).hexdigest()


def counter(data: bytes, model: bool) -> Callable[[list[str]], list[int]]:
    """The library's token counts of a list of texts, without tokens added at the ends, truncation or padding."""
    if model:
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(data)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def lengths(texts: list[str]) -> list[int]:
        return [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    about = json.loads(data)
    step = about["pre_tokenizer"] or {}
    if about["model"]["type"] != "BPE" or step.get("type") != "ByteLevel" or step.get("add_prefix_space") or not step.get("use_regex", True) or about["normalizer"] or about["post_processor"]:
        return lengths
    return by_pieces(lengths, [t["content"] for t in about["added_tokens"]])


def by_pieces(lengths: Callable[[list[str]], list[int]], special: list[str]) -> Callable[[list[str]], list[int]]:
    """Counts from remembered counts of the stretches from a space to the next.

    Byte-level splitting takes a space to the word behind it, so a text's tokens are those of its stretches; texts with
    white space on both sides of a space, or with a special token's string, go to the library whole.
    """
    whole = re.compile("|".join([r"\s \s", *map(re.escape, special)]))
    memo: dict[str, int] = {}
    older: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        out, rest = [0] * len(texts), []
        for k, text in enumerate(texts):
            if whole.search(text):
                out[k] = lengths([text])[0]
                continue
            first, *pieces = text.split(" ")
            if len(memo) >= MEMO:
                older.clear()
                older.update(memo)
                memo.clear()
            if new := {p for p in pieces if p not in memo}:
                memo.update([(p, older[p]) for p in new if p in older])
                listed = [p for p in new if p not in memo]
                memo.update(zip(listed, lengths([f" {p}" for p in listed]), strict=True))
            rest.append((k, first))
            out[k] = sum(map(memo.__getitem__, pieces))
        for (k, _), n in zip(rest, lengths([x for _, x in rest]), strict=True):
            out[k] += n
        return out

    return count


_loaded: dict[str, Callable[[list[str]], list[int]]] = {}


def count_tokens(documents: DataFrame, file: str, cache: str, text_col: str = "text") -> DataFrame:
    """documents with n_bytes (UTF-8) and n_tokens; cache is a folder in a store that all executors share."""
    spark = documents.sparkSession
    version, folder = version_of(file), None
    folder = f"{cache.rstrip('/')}/{version}"
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    known = cached(spark, folder)
    fresh = documents.select(digest.alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    if known is not None:
        known = stored(known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "known")
        fresh = fresh.join(known, "digest", "left_anti")
    bundle, model = spark.sparkContext.broadcast(Path(file).read_bytes()), file.endswith(".model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if version not in _loaded:
            _loaded[version] = counter(bundle.value, model)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(_loaded[version](part.column("text").to_pylist()), pa.int64())], ["digest", "n_tokens"])

    fresh.mapInArrow(run, CACHE).write.mode("append").parquet(folder)
    # Concurrent runs may have appended a digest twice, be it before this one looked or since.
    counts = cached(spark, folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = counts.withColumnsRenamed({"digest": "digest_in", "n_tokens": "n_tokens_in"})
    keep = [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(documents.columns) if c.lower() not in ("n_bytes", "n_tokens")]
    names = [c for c in documents.columns if c.lower() not in ("n_bytes", "n_tokens")]
    sized = documents.select(*[c.alias(f"c{names.index(n)}") for c, n in zip(keep, names, strict=True)], F.octet_length(text).cast("long").alias("n_bytes_in"), digest.alias("own_digest"))
    joined = sized.join(counts, sized.own_digest == counts.digest_in, "left")
    return joined.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], F.col("n_bytes_in").alias("n_bytes"), F.col("n_tokens_in").alias("n_tokens"))


def cached(spark: SparkSession, folder: str) -> DataFrame | None:
    """The cache in folder, None if there is none yet."""
    try:
        return spark.read.schema(CACHE).parquet(folder)
    except AnalysisException:
        return None
