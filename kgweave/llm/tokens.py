"""Encoding of the whole corpus with a public byte-level BPE vocabulary (problem 6).

A sentencepiece BPE model is serialised directly from the vocabulary's rank file: each token's bytes are mapped to
printable characters, its score is its negative rank, normalisation is the identity. Texts are cut into pre-tokens by
the vocabulary's pattern, each pre-token is byte-mapped and encoded, and ids are decoded by the inverse mapping. The
model is broadcast (about 1 MB, fixed by the vocabulary); no text leaves its partition and nothing is shuffled.

Defined results: a null or empty text gives an empty list; blank texts, and strings that look like special tokens, are
ordinary text; texts of any length are encoded whole; repeated rows and other columns are kept; an empty table gives an
empty one.
"""

from __future__ import annotations

import base64
import struct
import sys
import types

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers with their ids.
REMEMBERED = 300_000


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next beyond U+00FF."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(path: str = VOCABULARY) -> bytes:
    """The serialised model: pieces in order of rank, so that piece ids are the vocabulary's ids, then <unk>."""
    letters = byte_letters()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    pieces, size = [], max(ranks.values()) + 1
    by_rank = {r: "".join(letters[b] for b in token) for token, r in ranks.items()}
    for r in range(size):
        kind = b"" if r in by_rank else _field(3, 5)
        pieces.append(_field(1, by_rank.get(r, f"<unused {r}>").encode()) + b"\x15" + struct.pack("<f", -float(r)) + kind)
    pieces.append(_field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _field(3, 2))
    none = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, size + 1) + _field(40, size) + _field(41, none) + _field(42, none) + _field(43, none)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(PATTERN).findall
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.bytes = {c: b for b, c in self.letters.items()}
        self.known: dict[str, list[int]] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        new = list(words)
        mapped = [w.encode("utf-8", "replace").decode("latin-1").translate(self.letters) for w in new]
        self.known.update(zip(new, self.model.encode(mapped, num_threads=1)))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        out = []
        for text in texts:
            words = self.cut(text) if text else []
            if missing := {w for w in words if w not in self.known}:
                self.learn({*words} if len(self.known) + len(missing) > REMEMBERED else missing)
            known = self.known
            out.append([i for w in words for i in known[w]])
        return out

    def decode(self, ids: list[int]) -> str:
        return bytes(self.bytes[c] for i in ids for c in self.model.id_to_piece(int(i))).decode("utf-8", "replace")


def encoder(model: Broadcast) -> Encoder:
    """This worker's encoder; it outlives the task."""
    kept = sys.modules.setdefault("_kgweave_worker", types.ModuleType("_kgweave_worker"))
    key = f"encoder {model._path if hasattr(model, '_path') else id(model)}"
    if getattr(kept, "key", None) != key:
        kept.encoder, kept.key = Encoder(model.value), key
    return kept.encoder


def broadcast_model(spark: SparkSession, path: str = VOCABULARY) -> Broadcast:
    return spark.sparkContext.broadcast(model_bytes(path))


def token_ids(col: Column | str, model: Broadcast) -> Column:
    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series(encoder(model).encode(texts.tolist()), dtype=object)

    return ids(col)


def token_count(col: Column | str, model: Broadcast) -> Column:
    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(x) for x in encoder(model).encode(texts.tolist())], dtype="int32")

    return count(col)


def decoded(col: Column | str, model: Broadcast) -> Column:
    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        e = encoder(model)
        return pd.Series([None if x is None else e.decode(x) for x in ids], dtype=object)

    return text(col)
