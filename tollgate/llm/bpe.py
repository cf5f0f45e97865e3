"""Byte-level BPE: encoding by a queue of merge ranks over a linked list of symbols, and decoding.

The queue holds (rank, place, left id, right id); an entry is stale, and skipped, if the symbols at its place are no
longer those two. The vocabulary file is read by the driver and sent to the workers: its size is fixed.

Cases: null and empty texts have no tokens and decode to the empty text; a special token's string inside a text is that
token, as the tokenizers library has it by default; very long words take n log n steps; rows are independent, so
repeated ones are encoded alike; an empty table gives an empty one; other columns are kept, except those named as the
new ones, which are replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from pathlib import Path

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tollgate.llm.common import add_columns

#: Fixed value: the pattern that public byte-level vocabularies of this kind split text by before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words whose ids a worker remembers.
MEMO = 100_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Memo(dict):
    """Remembers a function's results, those of the last MEMO arguments at least; it bounds memory only."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= MEMO:
            self.old = self.copy()
            self.clear()
        self[key] = out
        return out


class Bpe:
    """Encoder and decoder of one vocabulary file of the tokenizers library: byte-level BPE without a normaliser."""

    def __init__(self, file: str):
        data = json.loads(file)
        model, step = data["model"], data["pre_tokenizer"]
        if model["type"] != "BPE" or step["type"] != "ByteLevel" or step.get("add_prefix_space") or data["normalizer"]:
            raise ValueError("only byte-level BPE without a normaliser or a prefix space")
        letters = byte_letters()
        number = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.letters = [vocab[c] for c in letters]
        self.strings: dict[int, bytes] = {i: bytes(number[c] for c in t) for t, i in vocab.items()}
        self.strings |= {i: t.encode() for t, i in added.items()}
        self.ranks: dict[int, int] = {}
        self.results: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a] << 32 | vocab[b]] = rank
            self.results.append(vocab[a + b])
        self.added = {t: np.uint32(i).astype("<u4").tobytes() for t, i in added.items()}
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.split = regex.compile(SPLIT)
        self.twisted = re.compile(r"\s \s")
        self.by_word = Memo(self.word)
        self.by_piece = Memo(lambda piece: self.stretch(f" {piece}"))

    def merged(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of lowest rank, leftmost among equals, is merged until none is left.

        A queue entry is rank and place in one integer; it is stale if the pair at its place has another rank by now.
        """
        ids = [self.letters[b] for b in word]
        n, ranks = len(ids), self.ranks
        if n < 2:
            return ids
        queue = [r << 32 | i for i in range(n - 1) if (r := ranks.get(ids[i] << 32 | ids[i + 1])) is not None]
        if not queue:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heapq.heapify(queue)
        while queue:
            top = heapq.heappop(queue)
            i, rank = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if ids[i] < 0 or j < 0 or ranks.get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i] = self.results[rank]
            ids[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := ranks.get(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(queue, r << 32 | h)
        return [i for i in ids if i >= 0]

    def word(self, word: str) -> bytes:
        return array("I", self.merged(word.encode())).tobytes()

    def stretch(self, text: str) -> bytes:
        """The ids of a stretch of text, as little-endian unsigned 32-bit integers."""
        if text[1:].isalpha() and text[0] == " ":
            return self.word(text)
        return b"".join([self.by_piece[w[1:]] if w[0] == " " and w[1:].isalpha() else self.by_word[w] for w in self.split.findall(text)])

    def plain(self, text: str) -> bytes:
        """The ids of text without special tokens.

        The pattern takes a space to the word behind it, so text falls apart before each space into stretches that are
        split alone as they are together, but for white space on both sides of a space; such texts are split whole.
        """
        if self.twisted.search(text):
            return self.stretch(text)
        first, *rest = text.split(" ")
        return self.stretch(first) + b"".join(map(self.by_piece.__getitem__, rest)) if first else b"".join(map(self.by_piece.__getitem__, rest))

    def encode(self, text: str | None) -> bytes:
        """All ids of a text, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.apart is None:
            return self.plain(text)
        return b"".join(self.added[x] if k % 2 else self.plain(x) for k, x in enumerate(self.apart.split(text)) if x)

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of ids, joined; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def bpe_round_trip(documents: DataFrame, file: str, text_col: str = "text") -> DataFrame:
    """documents with n_tokens, ids (binary, little-endian unsigned 32-bit integers) and decoded (the text of those ids)."""
    bundle = documents.sparkSession.sparkContext.broadcast(Path(file).read_text())
    name = file

    def make(texts: list) -> list[list]:
        if name not in _loaded:
            _loaded[name] = Bpe(bundle.value)
        bpe = _loaded[name]
        ids = [bpe.encode(t) for t in texts]
        return [[len(x) // 4 for x in ids], ids, [bpe.decode(x) for x in ids]]

    return add_columns(documents, text_col, [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())], make)
