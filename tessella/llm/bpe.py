"""Byte-level BPE by a sentencepiece model that is serialised straight from a ranked vocabulary.

Each vocabulary entry becomes a piece whose characters stand for its bytes, scored by its negative rank, with an
identity normaliser.  sentencepiece then merges the adjacent pair of best score, leftmost first, which is the merge
order of the ranks.  Pre-tokens that are vocabulary entries as a whole take that entry, as ranked BPE does.
Decoding maps ids back to pieces and characters back to bytes.

Edge cases: a null or empty text has no ids; any text of valid UTF-8 round-trips exactly; repeated rows give equal
results; further columns are ignored unless named in ``keep``; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import bounded, extended
from ._text import settle, slices

CACHE_ENTRIES = 300_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else from U+0100 on in byte order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: the vocabulary in rank order, then the unknown piece that the format asks for."""
    chars = byte_characters()
    out = [_field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1)) for rank, token in enumerate(vocabulary)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    n = len(vocabulary)
    out.append(_field(2, _field(3, 2) + _field(4, n + 1) + _field(40, n) + b"".join(_field(k, (1 << 64) - 1) for k in (41, 42, 43))))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


def load_ranks(lines: Iterable[bytes]) -> list[tuple[bytes, int]]:
    pairs = [line.split() for line in lines if line.strip()]
    return sorted(((base64.b64decode(t), int(r)) for t, r in pairs), key=lambda x: x[1])


class Codec:
    """Encodes and decodes texts; keeps the ids of at most ``CACHE_ENTRIES`` pre-tokens."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str):
        import regex
        import sentencepiece

        self.tokens = [t for t, _ in ranks]
        self.ids = [r for _, r in ranks]
        if sorted({len(t) for t in self.tokens})[:1] != [1] or len({*(t for t in self.tokens if len(t) == 1)}) != 256:
            raise ValueError("the vocabulary must hold every single byte")
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialise(self.tokens))
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # Unicode White_Space, the same in every engine
        pattern = pattern.replace(r"[^\s", f"[^{space}").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
        self.split = regex.compile(pattern).findall
        self.to_chars = dict(enumerate(byte_characters()))
        self.whole = {t: struct.pack("<I", r) for t, r in ranks}
        self.by_id = dict(zip(self.ids, self.tokens, strict=True))
        self.known: dict[str, bytes] = {}

    def learn(self, pre_tokens: set[str]) -> None:
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        known, todo, raw = self.known, [], []
        for p in pre_tokens:
            if p not in known:
                b = p.encode()
                if (one := self.whole.get(b)) is not None:
                    known[p] = one
                else:
                    todo.append(p)
                    raw.append(b.decode("latin-1").translate(self.to_chars))
        for p, ids in zip(todo, self.model.encode(raw, out_type=int, num_threads=1) if raw else (), strict=True):
            known[p] = struct.pack(f"<{len(ids)}I", *(self.ids[i] for i in ids))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pre = self.split(text)
        self.learn(set(pre))
        return b"".join(map(self.known.__getitem__, pre))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.by_id.__getitem__, memoryview(ids).cast("I")))


@cache
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process; the vocabulary file is part of each machine's Python installation."""
    with open(path, "rb") as f:
        return Codec(load_ranks(f), pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digests: bool = False) -> DataFrame:
    """Adds ``ids`` array<int> and ``decoded`` binary to the columns of ``keep``; with ``digests`` their SHA-256 and count instead."""
    out_schema = extended(df, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        settle("bpe", codec.cache_clear)
        c = codec(path, pattern)
        for rows, _, _ in slices(batches, "_text"):
            ids = [c.encode(t or "") for t in rows.column(rows.num_columns - 1).to_pylist()]
            decoded = [c.decode(x) for x in ids]
            head = [rows.column(i) for i in range(len(keep))]
            if digests:
                tail = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
            else:
                tail = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32))), pa.array(decoded, pa.binary())]
            yield pa.RecordBatch.from_arrays([*head, *tail], names=out_schema.names)

    return bounded(df.select(*keep, F.col(text).alias("_text"))).mapInArrow(run, out_schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The bytes of an ``array<int>`` column of ids, as ``decoded`` binary; a null is empty."""
    schema = extended(df, keep, "decoded binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("bpe", codec.cache_clear)
        c = codec(path, pattern)
        for rows in batches:
            out = [c.decode(struct.pack(f"<{len(x or ())}I", *(x or ()))) for x in rows.column(rows.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(keep))), pa.array(out, pa.binary())], names=schema.names)

    return bounded(df.select(*keep, F.col(ids).alias("_ids"))).mapInArrow(run, schema)
