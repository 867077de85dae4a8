"""Vectorised byte-level text helpers shared by the Arrow operators of this subpackage.

Texts arrive as Arrow string arrays.  Everything here works on one contiguous byte buffer plus offsets, in slices
of at most ``SLICE_BYTES`` (or one text), so memory is bounded by the longest single text.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
U64 = np.uint64

#: White space of the word rule: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place on a fresh copy."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + mix(np.full(n, seed, U64)))


BYTE_VALUES = stream(256, 7)
LOWER_VALUES = BYTE_VALUES[LOWER]
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(int(BASE), -1, 1 << 64))
SHINGLE = stream(65, 11) | U64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n; grown on demand, kept for the worker's life."""
    if not _powers or len(_powers[0]) < n:
        size = -(-n >> 16) << 16
        out = []
        for b in (BASE, BASE_INV):
            p = np.full(size, b, U64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            out.append(p)
        _powers[:] = out
    return _powers[0], _powers[1]


def buffer(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks)
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    offs = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts record batches into slices of at most ``limit`` text bytes (or one row): (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, offs = buffer(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
            yield batch.slice(lo, hi - lo), buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            lo = hi
    handed_back()


_kept: dict[str, Callable[[], None]] = {}


def settle(owner: str, let_go: Callable[[], None] | None = None) -> None:
    """To be called where an operator's work begins in a worker, which Spark uses again for other operators: what those
    keep there for their own tasks goes.  let_go: drops what this one keeps."""
    others = [f for name, f in _kept.items() if name != owner]
    _kept.clear()
    if let_go is not None:
        _kept[owner] = let_go
    if others:
        for f in others:
            f()
        gc.collect()
        handed_back()


def handed_back() -> None:
    """Returns what this worker has freed to the machine: it may wait for its next task beside other workers."""
    pa.default_memory_pool().release_unused()
    if (trim := _libc()) is not None:
        trim(0)


@cache
def _libc() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # no GNU C library
        return None


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the maximal runs without white space, none across texts; and each text's first word."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~SPACE[buf]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offs)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans (polynomial prefix sums over random byte values, then mixed)."""
    n = len(buf)
    power, inverse = powers(n + 1)
    p = np.empty(n + 1, U64)
    p[0] = 0
    np.cumsum((LOWER_VALUES if lower else BYTE_VALUES)[buf] * power[:n], out=p[1:])
    return mix((p[end] - p[start]) * inverse[start])


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles by text and their offsets; a text of fewer words has its whole sequence as one."""
    count = np.diff(first)
    each = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    offs = np.concatenate([[0], np.cumsum(each)])
    out = np.empty(offs[-1], U64)
    full = count >= k
    if full.any():
        m = len(h) - k + 1
        acc = h[:m] * SHINGLE[0]
        for j in range(1, k):
            acc += h[j : m + j] * SHINGLE[j]
        at = np.arange(offs[-1]) + np.repeat(first[:-1] - offs[:-1], each)
        is_full = np.repeat(full, each)
        out[is_full] = acc[at[is_full]]
    short = np.flatnonzero((count > 0) & ~full)
    if len(short):
        acc = SHINGLE[64] * count[short].astype(U64)
        for j in range(k - 1):
            on = count[short] > j
            acc[on] += h[first[short[on]] + j] * SHINGLE[j]
        out[offs[short]] = acc
    return mix(out), offs


def distinct(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each segment."""
    values = values.copy()
    for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        if hi - lo > 1:
            values[lo:hi].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[offs[:-1][offs[:-1] < len(values)]] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], at[offs]


def segment_sum(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments, 0 for empty ones."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offs[1:]] - total[offs[:-1]]


def segment_max(values: np.ndarray, offs: np.ndarray, empty: float) -> np.ndarray:
    out = np.full(len(offs) - 1, empty, np.float64)
    some = offs[1:] > offs[:-1]
    if some.any():
        out[some] = np.maximum.reduceat(values, offs[:-1][some])
    return out
