"""Language identification by string kernels.

Texts are cut into blocks of ``BLOCK`` bytes.  The blended-spectrum presence kernel of two blocks counts the hashed byte
n-grams (1 to 4, lower case) that both hold, over the root of the product of their own numbers.  Nystrom landmarks are
training blocks; one-versus-rest kernel ridge regression is solved in their feature space.  Scoring is two matrix
products a batch: presence x landmarks, then x coefficients.  A text's margins are the means over all its blocks.

The fit reads the whole texts of a bounded sample of rows: ``per_lang`` of a language, fewer where there are so many
languages that ``most`` rows would be exceeded, but ``LEAST`` of each at least.

Edge cases: a null text or one without a letter is ``und`` with score 0; without training rows every text is ``und``;
ties go to the first language in order; repeated rows score alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import bounded, extended, sample_ids
from ._text import LOWER_VALUES, U64, segment_sum, slices

BLOCK = 2048
BITS = 13
DIM = 1 << BITS
ORDERS = (1, 2, 3, 4)
GROUP = 256  # blocks in one matrix product
LEAST = 8


def blocks(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the blocks of each text, the last two evened out, and the first block of each text."""
    n = np.diff(offs)
    each = -(-n // BLOCK)
    first = np.concatenate([[0], np.cumsum(each)])
    i = np.arange(first[-1]) - np.repeat(first[:-1], each)
    lo = np.repeat(offs[:-1], each) + i * np.repeat(n, each) // np.maximum(1, np.repeat(each, each))
    return lo, first


def presence(buf: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """float32 rows of hashed n-gram presence, one for each block [edges[i], edges[i + 1])."""
    buf, edges = buf[edges[0] : edges[-1]], edges - edges[0]
    out = np.zeros((len(edges) - 1, DIM), np.float32)
    v = LOWER_VALUES[buf]
    row = np.repeat(np.arange(len(edges) - 1) * DIM, np.diff(edges))
    last = np.repeat(edges[1:], np.diff(edges))
    flat, at = out.ravel(), np.arange(len(buf))
    h = np.zeros(len(buf), U64)
    for n in ORDERS:
        if len(buf) < n:
            break
        h = h[: len(buf) - n + 1] * U64(0x9E3779B97F4A7C15) + v[n - 1 :]
        ids = (h ^ h >> U64(29)) * U64(0xBF58476D1CE4E5B9) >> U64(64 - BITS)
        ok = at[: len(ids)] + n <= last[: len(ids)]
        flat[(row[: len(ids)] + ids.astype(np.int64))[ok]] = 1
    return out


def means(buf: np.ndarray, offs: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Each text's mean over its blocks of presence over its norm, times the matrix."""
    lo, first = blocks(offs)
    edges = np.append(lo, offs[-1])
    out = np.zeros((len(lo), matrix.shape[1]))
    for i in range(0, len(lo), GROUP):
        e = edges[i : i + GROUP + 1]
        x = presence(buf, e)
        out[i : i + GROUP] = x @ matrix / np.sqrt(np.maximum(1, x.sum(1)))[:, None]
    return segment_sum(out, first) / np.maximum(1, np.diff(first))[:, None]


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    landmarks: np.ndarray  # DIM x m, presence over its norm
    coefficients: np.ndarray  # m x languages
    scale: float

    def margins(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return means(buf, offs, self.landmarks) @ self.coefficients


def fit(texts: list[str], langs: list[str], m: int = 96, ridge: float = 1e-2, seed: int = 5) -> Model:
    names = tuple(sorted(set(langs)))
    if not names:
        return Model((), np.zeros((DIM, 0), np.float32), np.zeros((0, 0)), 1.0)
    raw = [t.encode() for t in texts]
    y = np.array([names.index(s) for s in langs])
    rng = np.random.default_rng(seed)
    z = []
    for i in np.concatenate([rng.permutation(np.flatnonzero(y == c))[: -(-m // len(names))] for c in range(len(names))]).tolist():
        lo, _ = blocks(np.array([0, len(raw[i])]))
        k = int(rng.integers(max(1, len(lo))))
        z.append(presence(np.frombuffer(raw[i], np.uint8), np.append(lo, len(raw[i]))[k : k + 2]) if len(lo) else np.zeros((1, DIM), np.float32))
    z = np.concatenate(z)
    z /= np.sqrt(np.maximum(1, z.sum(1)))[:, None]
    value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = value > 1e-6 * max(value[-1], 1e-12)
    white = vector[:, good] / np.sqrt(value[good])
    f = np.concatenate([means(np.frombuffer(b"".join(raw[i : i + GROUP]), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw[i : i + GROUP]])]), z.T) for i in range(0, len(raw), GROUP)]) @ white
    weight = np.sqrt(len(y) / len(names) / np.maximum(1, np.bincount(y, minlength=len(names))))[y]
    t = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0 / max(1, len(names) - 1))
    fw = f * weight[:, None]
    solved = np.linalg.solve(fw.T @ fw + ridge * len(y) / 100 * np.eye(f.shape[1]), fw.T @ (t * weight[:, None]))
    return Model(names, np.ascontiguousarray(z.T), white @ solved, 6.0)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 400, most: int = 100_000, seed: int = 23) -> Model:
    """Fits on at most ``per_lang`` texts of each language."""
    some = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull() & (F.length(text) > 0))
    per = max(LEAST, min(per_lang, most // max(1, some.select(lang).distinct().count())))
    ids = sample_ids(some, key, lang, per, seed)
    rows = some.select(key, F.col(lang), F.col(text).alias("_t")).join(F.broadcast(ids), [key, lang]).select("_t", lang).distinct().collect()
    rows.sort()
    return fit([r[0] for r in rows], [r[1] for r in rows])


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``lang_pred`` and ``score``, a softmax of the margins."""
    schema = extended(docs, keep, "lang_pred string, score double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for rows, buf, offs in slices(batches, "_text"):
            n = rows.num_rows
            letters = np.array(rows.column(rows.num_columns - 1).to_pylist(), bool)
            if m.langs:
                z = m.margins(buf, offs) * m.scale
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                value = np.where(letters, p[np.arange(n), best], 0.0)
                best = np.where(letters, best, len(m.langs))
            else:
                best, value = np.zeros(n, np.int64), np.zeros(n)
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(keep))), pa.array(names[best], pa.string()), pa.array(value)], names=schema.names)

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return bounded(docs.select(*keep, F.col(text).alias("_text"), letters.alias("_letters"))).mapInArrow(run, schema)
