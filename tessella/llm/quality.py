"""Ordinal cumulative-link regression on graded ratings over hashed text.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight vector for all grades, thresholds in order.  x is the mean of
one-hot hashed features of a text's words, of its words' shapes, and a few of its length and repetition.  The expected
grade is the sum of the tail probabilities.

The fit reads the whole texts of a bounded sample, at most ``per_grade`` labelled rows of each grade.

Edge cases: null and empty texts score by the intercept features alone; labels without a document, null grades and
repeated rows are allowed; without two grades every probability is the share of the grade; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import bounded, extended, sample_ids
from ._text import LOWER, segment_sum, slices, span_hashes, words

BITS = 15
DIM = 1 << BITS
EXTRA = 32  # features of length and repetition


def _shape_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91], t[97:123], t[48:58], t[128:] = 65, 97, 48, 98
    return t


SHAPE = _shape_table()


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """((word ids, shape ids), the words' offsets by text, extra ids); extra has two ids a text."""
    start, end, first = words(buf, offs)
    h = span_hashes(buf, start, end) if len(start) else np.zeros(0, np.uint64)
    shaped = SHAPE[buf]
    s = span_hashes(shaped, start, np.minimum(end, start + 12), lower=False) if len(start) else h
    n = np.diff(first)
    again = np.zeros(len(h))
    if len(h) > 1:
        again[1:] = (h[1:] >> np.uint64(52)) == (h[:-1] >> np.uint64(52))
    length = np.minimum(15, np.log2(n + 1).astype(np.int64))
    upper = segment_sum((buf != LOWER[buf]).astype(np.float64), offs) / np.maximum(1, np.diff(offs))
    extra = np.stack([length, 16 + np.minimum(15, (upper * 16).astype(np.int64))], 1)
    return np.stack([(h & np.uint64(DIM - 1)).astype(np.int32), (s & np.uint64(DIM - 1)).astype(np.int32) + np.int32(DIM)]), first, extra + 2 * DIM


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, 2 * DIM + EXTRA
    thresholds: np.ndarray  # ascending
    grades: tuple[int, ...]

    def linear(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        ids, first, extra = features(buf, offs)
        each = self.weights[ids[0]] + self.weights[ids[1]]
        return segment_sum(each, first) / np.maximum(1, np.diff(first)) + self.weights[extra].sum(1)

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -40, 40)))


def gathered(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`features` of a list of texts, a few at a time."""
    parts = []
    for lo in range(0, len(texts), 200):
        raw = [t.encode() for t in texts[lo : lo + 200]]
        parts.append(features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])))
    each = np.concatenate([np.diff(p[1]) for p in parts])
    return np.concatenate([p[0] for p in parts], 1), np.concatenate([[0], np.cumsum(each)]), np.concatenate([p[2] for p in parts])


def fit(texts: list[str], grades: np.ndarray, steps: int = 250, l2: float = 1e-5, rate: float = 0.1) -> Model:
    """Full-batch Adam on the mean negative log-likelihood, each grade weighted alike up to a factor of 4."""
    levels = tuple(sorted({int(g) for g in grades}))
    if len(levels) < 2:
        return Model(np.zeros(2 * DIM + EXTRA, np.float32), np.zeros(0), levels or (0,))
    ids, first, extra = gathered(texts)
    n, k = len(texts), len(levels) - 1
    scale = 8.0  # the words' mean moves as fast as the other features
    share = np.repeat(scale / np.maximum(1, np.diff(first)), np.diff(first))
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
    y = np.searchsorted(levels, grades)
    count = np.bincount(y, minlength=k + 1)
    weight = np.minimum(4.0, n / (k + 1) / np.maximum(1, count))[y]
    weight /= weight.sum()
    w = np.zeros(2 * DIM + EXTRA)
    cut = np.cumsum(count)[:-1] / n
    t = np.concatenate([[np.log(cut[0] / (1 - cut[0]))], np.full(k - 1, np.log(0.5))])  # first threshold, then log gaps
    m, v, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)
    for step in range(1, steps + 1):
        th = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
        z = np.bincount(doc, weights=(w[ids[0]] + w[ids[1]]) * share, minlength=n) + w[extra].sum(1)
        edge = np.concatenate([[-np.inf], th, [np.inf]])
        upper, lower = (1 / (1 + np.exp(np.clip(-(edge[y + i] - z), -40, 40))) for i in (1, 0))
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        gz = weight * (du - dl) / p
        each = gz[doc] * share
        g = sum(np.bincount(i, weights=each, minlength=len(w)) for i in ids) + np.bincount(extra.ravel(), weights=np.repeat(gz, 2), minlength=len(w)) + l2 * w
        gth = np.array([-(weight * du / p)[y == j].sum() + (weight * dl / p)[y == j + 1].sum() for j in range(k)])
        gt = np.concatenate([[gth.sum()], [gth[j:].sum() * np.exp(t[j]) for j in range(1, k)]])
        for x, gx, a, b in ((w, g, m, v), (t, gt, mt, vt)):
            a += 0.1 * (gx - a)
            b += 0.01 * (gx * gx - b)
            x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9)
    w[: 2 * DIM] *= scale
    return Model(w.astype(np.float32), np.cumsum(np.concatenate([t[:1], np.exp(t[1:])])), levels)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "grade", per_grade: int = 1500, seed: int = 17) -> Model:
    """Fits on at most ``per_grade`` rows of each grade of ``labels`` (key, grade)."""
    ids = sample_ids(labels.where(F.col(grade).isNotNull() & F.col(key).isNotNull()).select(key, grade), key, grade, per_grade, seed)
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")).join(F.broadcast(ids), key).select("_t", grade, key).dropDuplicates([key, grade]).collect()
    rows.sort(key=lambda r: (r[2], r[1]))
    return fit([r[0] for r in rows], np.array([int(r[1]) for r in rows]))


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tail_at: int | None = None) -> DataFrame:
    """Adds ``expected_grade`` and ``tail`` = P(grade >= tail_at), by default of the second lowest grade."""
    schema = extended(docs, keep, "expected_grade double, tail double")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    j = max(0, int(np.searchsorted(model.grades, model.grades[0] if tail_at is None else tail_at)) - (tail_at is not None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        gaps = np.diff(m.grades)
        for rows, buf, offs in slices(batches, "_text"):
            tails = m.tails(m.linear(buf, offs))
            expected = m.grades[0] + tails @ gaps
            tail = tails[:, j] if tails.shape[1] else np.full(rows.num_rows, float(tail_at is None or m.grades[0] >= tail_at))
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(keep))), pa.array(expected), pa.array(tail)], names=schema.names)

    return bounded(docs.select(*keep, F.col(text).alias("_text"))).mapInArrow(run, schema)
