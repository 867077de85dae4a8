"""Benchmark decontamination by latent semantic retrieval.

1. Texts become lists of 32-bit word hashes, written once; all later passes read those.
2. Passages are runs of ``BLOCK`` words.  Their hashed terms' passage frequencies over the whole corpus give inverse
   document frequencies (counted in ``DIM`` bins).
3. Randomised SVD of the passage x term matrix A: each task adds up its share of A'A W for a random W, sums merge in a
   tree, and the Nystrom form of A'A gives singular values and right vectors without a further pass.
4. Windows of two passages, half overlapping, and the benchmark items' windows are projected, each direction scaled by
   its singular value; pairs of a cosine over a bar that depends on the item's length are candidates, if the window holds
   enough of the item window's terms; sums of bytes that bound that share from above go first.
5. Around each candidate the longest common subsequence of words with the item, and with the item's answer (its last
   third), decide: enough of the whole, or less of the whole with nearly all of the answer.

The benchmark is a stated query set: blocks of ``ITEMS`` items go against all rows.

Edge cases: null and empty texts, and items without words, match nothing; equal items each match; a document gives a
row for each item that it holds, repeated rows repeat it; an empty corpus or benchmark gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import bounded, table
from ._text import handed_back, mix, settle, slices, span_hashes, words

BLOCK = 16
DIM = 4096
RANK = 96
OVER = 8
ITEMS = 1024
SHARED = 0.3  # of an item window's inverse document frequencies, that a document's window must hold
UNITS = 255 - 2 * BLOCK - 1  # of a share, for its bound in bytes
CHUNK = 1 << 15  # words in one step
MERGE = 32


def hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, w): packed 32-bit hashes of the lower-cased words, signs at their ends left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("decontam")
        for rows, buf, offs in slices(batches, "_text"):
            h, first = word_ids(buf, offs)
            raw = h.tobytes()
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([raw[4 * a : 4 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())], names=["id", "w"])

    return bounded(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("_text"))).mapInArrow(run, "id long, w binary")


SIGN = np.ones(256, bool)
SIGN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_ids(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = words(buf, offs)
    if not len(start):
        return np.zeros(0, np.uint32), first
    for _ in range(3):
        start = start + (SIGN[buf[start]] & (end - start > 1))
        end = end - (SIGN[buf[end - 1]] & (end - start > 1))
    return (span_hashes(buf, start, end) >> np.uint64(32)).astype(np.uint32), first


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, word hashes, each document's first) of runs of documents of about CHUNK words."""
    for batch in batches:
        w, ids = batch.column(1), batch.column(0).to_pylist()
        size = np.array([len(x) // 4 for x in w.to_pylist()], np.int64)
        lo = 0
        total = np.concatenate([[0], np.cumsum(size)])
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + CHUNK, side="right")) - 1)
            yield ids[lo:hi], np.frombuffer(b"".join(w.slice(lo, hi - lo).to_pylist()), np.uint32), total[lo : hi + 1] - total[lo]
            lo = hi
    handed_back()


def blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each passage, and each document's first passage."""
    each = -(-np.diff(first) // BLOCK)
    at = np.concatenate([[0], np.cumsum(each)])
    i = np.arange(at[-1]) - np.repeat(at[:-1], each)
    return np.repeat(first[:-1], each) + i * BLOCK, at


def grid(w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms as rows of BLOCK, a row for each passage, DIM where a document's last passage has no more words; the first
    word of each passage, and each document's first passage."""
    at, doc_at = blocks(first)
    out = np.full(len(at) * BLOCK, DIM, np.int16)
    shift = np.repeat(doc_at[:-1] * BLOCK - first[:-1], np.diff(first))
    out[np.arange(len(w)) + shift] = w & np.uint32(DIM - 1)
    return out.reshape(-1, BLOCK), at, doc_at


def row_sums(table_: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The sum of the table's rows over each passage's terms; the table's last row is zero."""
    y = table_[terms[:, 0]]
    for j in range(1, terms.shape[1]):
        y += table_[terms[:, j]]
    return y


def summed(parts: DataFrame, width: int, tasks: int) -> np.ndarray:
    """Adds up packed float64 rows (slice, salt, x) in a tree of at most MERGE rows a group; returns DIM x width."""

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in rows.column("x").to_pylist())
        return pa.table([rows.column("slice").slice(0, 1), pa.array([rows.column("salt")[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "salt", "x"])

    schema = "slice int, salt int, x binary"
    while True:
        tasks = -(-tasks // MERGE)
        parts = parts.withColumn("salt", F.expr(f"cast(salt div {MERGE} as int)")).groupBy("slice", "salt").applyInArrow(add, schema)
        if tasks <= 1:
            break
    rows = sorted((r["slice"], r["x"]) for r in parts.collect())  # DIM * width values, whatever the corpus
    return np.frombuffer(b"".join(x for _, x in rows), np.float64).reshape(DIM, width) if rows else np.zeros((DIM, width))


def spread(total: np.ndarray) -> pa.RecordBatch:
    """A task's DIM x width sums in 16 slices, salted by its partition."""
    from pyspark import TaskContext

    n = 16
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array([x.tobytes() for x in np.split(total, n)], pa.binary())], names=["slice", "salt", "x"])


def frequencies(ids: DataFrame) -> np.ndarray:
    """Passages that hold each term, and in the last place the number of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((DIM, 2))
        for _, w, first in chunks(batches):
            t, at, _ = grid(w, first)
            if len(at):
                t.sort(axis=1)
                new = np.ones(t.shape, bool)
                new[:, 1:] = t[:, 1:] != t[:, :-1]
                total[:, 0] += np.bincount(t[new], minlength=DIM + 1)[:DIM]
                total[0, 1] += len(at)
        yield spread(total)

    return summed(ids.mapInArrow(run, "slice int, salt int, x binary"), 2, ids.rdd.getNumPartitions())


def right_vectors(ids: DataFrame, idf: np.ndarray, seed: int = 71) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (DIM x RANK) and singular values of the TF-IDF passage matrix."""
    width = RANK + OVER
    w0 = np.random.default_rng(seed).standard_normal((DIM, width))
    weighted = ids.sparkSession.sparkContext.broadcast(np.concatenate([w0 * idf[:, None], np.zeros((1, width))]).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, omega = np.zeros((DIM, width)), weighted.value
        for _, w, first in chunks(batches):
            t, at, _ = grid(w, first)
            if not len(at):
                continue
            y = row_sums(omega, t)  # A W, a row for each passage
            flat, by_column = t.ravel().astype(np.intp), np.ascontiguousarray(y.T)
            for d in range(width):  # A' (A W), column by column
                total[:, d] += np.bincount(flat, weights=np.repeat(by_column[d], BLOCK), minlength=DIM + 1)[:DIM]
        yield spread(total)

    y = summed(ids.mapInArrow(run, "slice int, salt int, x binary"), width, ids.rdd.getNumPartitions()) * idf[:, None]
    shift = 1e-9 * max(1e-9, np.linalg.norm(y))
    y = y + shift * w0
    core = w0.T @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    value = np.maximum(value, 1e-12 * max(value[-1], 1e-300))
    u, s, _ = np.linalg.svd(y @ (vector / np.sqrt(value)), full_matrices=False)
    return u[:, :RANK], np.sqrt(np.maximum(s[:RANK] ** 2 - shift, 0))


def projection(ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Inverse document frequencies, 0 in the last place, and float32 DIM x RANK, and a row of zeros: what a word adds to a window's latent vector."""
    f = frequencies(ids)
    idf = np.log((1 + f[0, 1]) / (1 + f[:, 0])) + 0.05
    v, s = right_vectors(ids, idf)
    scale = np.where(s > 1e-6 * max(s[0], 1e-300), 1 / np.maximum(s, 1e-300), 0.0)
    p = idf[:, None] * v * scale
    return np.append(idf, 0.0), np.concatenate([p / max(1e-300, np.sqrt((p * p).sum(1).mean())), np.zeros((1, RANK))]).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-9, np.sqrt((x * x).sum(1, keepdims=True)))


def windows(p: np.ndarray, w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors, document, first word in it, terms) of the windows of two passages."""
    t, at, doc_at = grid(w, first)
    if not len(at):
        return np.zeros((0, RANK), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2 * BLOCK), np.int16)
    x = row_sums(p, t)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(doc_at))
    pair = np.zeros(len(at), bool)
    pair[:-1] = doc[1:] == doc[:-1]
    head = np.ones(len(at), bool)
    head[1:] = ~pair[:-1]
    keep = pair | head
    x[:-1][pair[:-1]] += x[1:][pair[:-1]].copy()
    terms = np.full((len(at), 2 * BLOCK), DIM, np.int16)
    terms[:, :BLOCK] = t
    terms[:-1, BLOCK:][pair[:-1]] = t[1:][pair[:-1]]
    return unit(x[keep]), doc[keep], (at - first[doc])[keep], terms[keep]


def once_each(terms: np.ndarray) -> np.ndarray:
    terms = np.sort(terms, axis=1)
    terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = DIM
    return terms


def bounds(weights: np.ndarray) -> np.ndarray:
    """Weights rounded up to 1 / UNITS, a row for each term: their sums over a window's terms bound its share in each
    item window from above.  A share is 1 at most and rounding adds under a unit a term, so the sums fit into a byte."""
    return np.ascontiguousarray(np.ceil(weights.T.astype(np.float64) * UNITS).astype(np.uint8))


def candidates(x: np.ndarray, terms: np.ndarray, vectors: np.ndarray, bars: np.ndarray, weights: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, item window, cosine) of the pairs over the bar that share enough; the bound spares the others the exact sum."""
    sim = x @ vectors
    i, j = np.nonzero((row_sums(above, terms) >= int(np.ceil(SHARED * UNITS - 0.01))) & (sim >= bars))
    ok = np.zeros(len(i), bool)
    for c in range(0, len(i), CHUNK):
        ok[c : c + CHUNK] = weights[j[c : c + CHUNK, None], terms[i[c : c + CHUNK]]].sum(1) >= SHARED
    i, j = i[ok], j[ok]
    return i, j, sim[i, j]


def lcs(positions: dict[int, int], n: int, text: list[int]) -> int:
    """Longest common subsequence; positions: bits of each word's places in the pattern of n words."""
    full = (1 << n) - 1
    v = full
    for c in text:
        if m := positions.get(c):
            u = v & m
            v = (v + u | v - u) & full
    return n - v.bit_count()


def places(pattern: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def search(ids: DataFrame, items: list[tuple[int, str]], idf: np.ndarray, p: np.ndarray, whole: float, part: float, answer: float) -> DataFrame:
    raw = [t.encode() for _, t in items]
    w, first = word_ids(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    lists = [w[a:b].tolist() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    vectors, item, at, terms = windows(p, w, first)
    weights = np.zeros((len(item), DIM + 1), np.float32)  # a window's terms by inverse document frequency, over their sum
    np.put_along_axis(weights, terms.astype(np.int64), idf[terms].astype(np.float32), 1)
    weights[:, DIM] = 0
    weights /= np.maximum(1e-9, weights.sum(1, keepdims=True))
    n = np.diff(first)[item]
    bars = 0.2 * np.sqrt(np.minimum(2 * BLOCK, n) / (2 * BLOCK))
    shared = ids.sparkSession.sparkContext.broadcast((p, [i for i, _ in items], lists, np.ascontiguousarray(vectors.T), item, at, bars.astype(np.float32), weights, bounds(weights)))
    schema = "id long, item_id long, cosine double, common double, answer double, start long, stop long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, names, lists, vectors, item, item_at, bars, weights, above = shared.value
        known = [(places(x), places(x[len(x) - max(1, len(x) // 3) :])) for x in lists]
        for ids_, w, first in chunks(batches):
            x, doc, at, terms = windows(p, w, first)
            out, terms = [], once_each(terms)
            for lo in range(0, len(x), 2048):
                i, j, cosine = candidates(x[lo : lo + 2048], terms[lo : lo + 2048], vectors, bars, weights, above)
                found: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
                for a, b, s in zip((i + lo).tolist(), j.tolist(), cosine.tolist(), strict=True):
                    m = len(lists[item[b]])
                    begin = int(at[a]) - int(item_at[b])  # where the item would start
                    found.setdefault((int(doc[a]), int(item[b])), []).append((begin - BLOCK, begin + m + 2 * BLOCK, s))
                for (d, b), spans in found.items():
                    text = w[first[d] : first[d + 1]]
                    best = None
                    for begin, stop in {(max(0, s[0]), min(len(text), s[1])) for s in spans}:
                        part_ = text[begin:stop].tolist()
                        m, k = len(lists[b]), max(1, len(lists[b]) // 3)
                        c, r = lcs(known[b][0], m, part_) / m, lcs(known[b][1], k, part_) / k
                        if c >= whole or (c >= part and r >= answer):
                            best = max(best or (-1.0,), (c, r, -begin, stop))
                    if best:
                        out.append((ids_[d], names[b], max(s[2] for s in spans), best[0], best[1], -best[2], best[3], d))
            if out:
                best_of: dict[tuple[int, int], tuple] = {}
                for o in out:
                    k = (o[7], o[1])
                    best_of[k] = max(best_of.get(k, o), o, key=lambda t: (t[3], t[2]))
                cols = list(zip(*best_of.values(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:5]), *(pa.array(c, pa.int64()) for c in cols[5:7])], names=["id", "item_id", "cosine", "common", "answer", "start", "stop"])

    return bounded(ids.select("id", "w")).mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", whole: float = 0.65, part: float = 0.5, answer: float = 0.85) -> DataFrame:
    """(key, item_id, cosine, common, answer, start, stop): documents that hold benchmark items, and the words where.

    whole: share of an item's words that in order suffices; part, answer: shares that do together."""
    ids = table(hashed(docs, key, text), "words")
    idf, p = projection(ids)
    found, block = None, []

    def against(block: list) -> None:
        nonlocal found
        one = search(ids, block, idf, p, whole, part, answer)
        found = one if found is None else found.unionByName(one)

    for row in benchmark.where(F.col(item_text).rlike(r"\S") & F.col(item).isNotNull()).select(item, item_text).orderBy(item).toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == ITEMS:
            against(block)
            block = []
    against(block)
    return found.withColumnRenamed("id", key)
