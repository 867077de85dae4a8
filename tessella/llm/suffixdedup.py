"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document of smaller key, or earlier in
the same one.  The first copy of every string stays.

Equal strings meet by anchors.  In every window of LENGTH bytes the leftmost least hash of its GRAM-byte substrings
is an anchor; equal windows have equal anchors at equal places.  An anchor with the bytes that any window around it can
reach is its context.

1. Anchors and hashes of their contexts are packed by bucket of the anchor's hash and shuffled.  An anchor that occurs
   once is done.  Of equal contexts every one but the earliest is covered whole.
2. Where an anchor has several contexts, the earliest of each is compared: the contexts' suffixes are sorted, and the
   previous and next smaller positions in suffix order give each suffix its longest previous factor.  Windows whose
   factor reaches LENGTH are covered.
3. Covered windows return to their documents, which lose the union.

Memory: a bucket of packed anchors, and the contexts of one bucket in step 2; documents pass one at a time.

Edge cases: a null or empty text has no bytes; repeated keys are ordered by their texts' hashes; a null key comes
first; texts shorter than LENGTH lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import bounded, table
from ._text import BYTE_VALUES, U64, mix, powers, slices

SLICE = 2 << 20  # bytes of text whose marks go out together, a row for each bucket
LENGTH = 100
GRAM = 24
SPAN = LENGTH - GRAM  # bytes that a window can reach on either side of its anchor
CONTEXT = LENGTH + SPAN
PLACE_BITS = 22
NO_KEY = -(1 << 63)
ANCHOR = np.dtype([("gram", "<u8"), ("context", "<u8"), ("key", "<i8"), ("sub", "<i4"), ("at", "<u4"), ("right", "u1")])
#: bytes [lo, hi) to remove; or, with lo = hi, an anchor at lo whose context is to be compared
MARK = np.dtype([("key", "<i8"), ("sub", "<i4"), ("lo", "<u4"), ("hi", "<u4"), ("gram", "<u8")])
PLACED = np.dtype([("key", "<i8"), ("sub", "<i4"), ("at", "<u4"), ("left", "u1"), ("n", "u1"), ("text", "u1", CONTEXT)])


def anchors(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, place in the document, hash, hash of the context, bytes from the place to the context's end) of every anchor."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.view(U64), none.view(U64), none
    power, inverse = powers(n + 1)
    p = np.empty(n + 1, U64)
    p[0] = 0
    np.cumsum(BYTE_VALUES[buf] * power[:n], out=p[1:])
    gram = mix((p[GRAM:] - p[:-GRAM]) * inverse[: n - GRAM + 1])
    room = np.repeat(offs[1:], np.diff(offs)) - LENGTH
    found = []
    step = 1 << PLACE_BITS
    for lo in range(0, len(gram), step - SPAN):  # parts overlap, so that every window lies in one
        g = gram[lo : lo + step]
        if len(g) <= SPAN:
            break
        low = (g & ~U64(step - 1)) | np.arange(len(g), dtype=U64)
        width = 1
        while width * 2 <= SPAN + 1:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = SPAN + 1 - width
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        start = np.flatnonzero(room[lo : lo + len(low)] >= np.arange(lo, lo + len(low)))
        place = (low[start] & U64(step - 1)).astype(np.int64) + lo
        found.append(place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place)
    place = np.unique(np.concatenate(found)) if len(found) > 1 else (found[0] if found else none)
    doc = np.searchsorted(offs, place, side="right") - 1
    left, right = np.maximum(offs[doc], place - SPAN), np.minimum(offs[doc + 1], place + LENGTH)
    context = mix((p[right] - p[left]) * inverse[left] + mix((place - left).astype(U64) << U64(32) | (right - place).astype(U64)))
    return doc, place - offs[doc], gram[place], context, right - place


def packed(records: np.ndarray, bucket: np.ndarray) -> list[pa.Array]:
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    there, at = np.unique(bucket, return_index=True)
    cut = [*at.tolist(), len(records)]
    return [pa.array(there.astype(np.int32)), pa.array([records[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())]


def by_key(marks: np.ndarray, parts: int) -> pa.Table:
    return pa.table(packed(marks, (mix(marks["key"].copy().view(U64)) % U64(parts)).astype(np.int32)), names=["bucket", "blob"])


def unpacked(rows: pa.Table, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("blob").to_pylist()), kind)


def meet(parts: int):
    """Step 1 in one bucket."""

    def run(rows: pa.Table) -> pa.Table:
        r = unpacked(rows, ANCHOR)
        r = r[np.argsort(r["gram"], kind="stable")]
        again = r["gram"][1:] == r["gram"][:-1]
        r = r[np.concatenate([[False], again]) | np.concatenate([again, [False]])]
        r = r[np.lexsort((r["at"], r["sub"], r["key"], r["context"], r["gram"]))]
        n = len(r)
        same_gram, same = np.zeros(n, bool), np.zeros(n, bool)
        same_gram[1:] = r["gram"][1:] == r["gram"][:-1]
        same[1:] = same_gram[1:] & (r["context"][1:] == r["context"][:-1])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        later = same & ((r["key"] != r["key"][first]) | (r["sub"] != r["sub"][first]) | (r["at"] != r["at"][first]))
        group = np.cumsum(~same_gram) - 1
        contexts = np.bincount(group, weights=~same)[group] if n else np.zeros(0)
        compare = ~same & (contexts > 1)
        out = np.zeros(int(later.sum() + compare.sum()), MARK)
        x = np.concatenate([r[later], r[compare]])
        out["key"], out["sub"], out["gram"] = x["key"], x["sub"], x["gram"]
        m = int(later.sum())
        at = x["at"].astype(np.int64)
        out["lo"] = np.where(np.arange(len(x)) < m, np.maximum(0, at - SPAN), at)
        out["hi"] = np.where(np.arange(len(x)) < m, at + x["right"], at)
        return by_key(out, parts)

    return run


def gather(rows: pa.Table) -> pa.Table:
    """Marks of one bucket by document: (key, sub, gone, todo), gone merged into maximal runs."""
    r = unpacked(rows, MARK)
    r = r[np.lexsort((r["lo"], r["sub"], r["key"]))]
    new = np.concatenate([[True], (r["key"][1:] != r["key"][:-1]) | (r["sub"][1:] != r["sub"][:-1])])
    cut = [*np.flatnonzero(new).tolist(), len(r)]
    gone, todo = [], []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        d = r[a:b]
        runs = d["lo"] < d["hi"]
        gone.append(merged(d["lo"][runs], d["hi"][runs]).tobytes())
        t = d[~runs]
        todo.append(t["lo"].tobytes() + t["gram"].tobytes())
    at = np.flatnonzero(new)
    return pa.table([pa.array(r["key"][at]), pa.array(r["sub"][at]), pa.array(gone, pa.binary()), pa.array(todo, pa.binary())], names=["key", "sub", "gone", "todo"])


def merged(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Maximal runs, as rows (lo, hi), of ranges in order of lo."""
    if not len(lo):
        return np.zeros((0, 2), np.uint32)
    reach = np.maximum.accumulate(hi)
    new = np.concatenate([[True], lo[1:] > reach[:-1]])
    return np.stack([lo[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)]], 1).astype(np.uint32)


def smaller(at: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the previous and the next smaller value of each entry, -1 and n where there is none."""
    n = len(at)
    prev, nxt = [-1] * n, [n] * n
    stack: list[int] = []
    for i, x in enumerate(at):
        while stack and at[stack[-1]] > x:
            nxt[stack.pop()] = i
        if stack:
            prev[i] = stack[-1]
        stack.append(i)
    return np.array(prev, np.int64), np.array(nxt, np.int64)


def common(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common prefixes of fixed-width rows."""
    differ = rows[i] != rows[j]
    return np.where(differ.any(1), differ.argmax(1), rows.shape[1])


def previous_factors(suffixes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix, up to the rows' width.

    suffixes: uint8 rows; at: distinct text positions.  Rows are sorted into suffix order, equal ones by position; the
    previous and next smaller positions there hold the earlier suffixes nearest in order, and the longer of the two
    common prefixes is the factor."""
    width = suffixes.shape[1]
    by_place = np.argsort(at, kind="stable")
    order = by_place[np.argsort(np.ascontiguousarray(suffixes[by_place]).view(f"S{width}").ravel(), kind="stable")]
    prev, nxt = smaller(at[order].tolist())
    out = np.zeros(len(at), np.int64)
    for near, ok in ((prev, prev >= 0), (nxt, nxt < len(at))):
        i = np.flatnonzero(ok)
        out[order[i]] = np.maximum(out[order[i]], common(suffixes, order[i], order[near[i]]))
    return out


def compare(parts: int):
    """Step 2 in one bucket.  Equal windows lie alike about equal anchors, so suffixes are taken place by place."""

    def run(rows: pa.Table) -> pa.Table:
        c = unpacked(rows, PLACED)
        c = c[np.lexsort((c["at"], c["sub"], c["key"]))]
        new = np.ones(len(c), bool)  # once each
        new[1:] = (c["key"][1:] != c["key"][:-1]) | (c["sub"][1:] != c["sub"][:-1]) | (c["at"][1:] != c["at"][:-1])
        c = c[new]
        rank, left = np.arange(len(c)), c["left"].astype(np.int64)
        power, inverse = powers(CONTEXT + 1)
        sums = np.zeros((len(c), CONTEXT + 1), U64)
        np.cumsum(BYTE_VALUES[c["text"]] * power[:CONTEXT], axis=1, out=sums[:, 1:])
        found = []
        for shift in range(-SPAN, 1):
            i = np.flatnonzero((left + shift >= 0) & (left + shift + LENGTH <= c["n"]))
            if len(i) < 2:
                continue
            lo = left[i] + shift
            h = mix((sums[i, lo + LENGTH] - sums[i, lo]) * inverse[lo])
            _, at, times = np.unique(h, return_inverse=True, return_counts=True)
            i = i[times[at] > 1]  # a window without an equal hash has no equal here
            if len(i) < 2:
                continue
            lo = left[i] + shift
            windows = c["text"][i[:, None], lo[:, None] + np.arange(LENGTH)]
            hit = i[previous_factors(windows, rank[i]) >= LENGTH]
            if len(hit):
                m = np.zeros(len(hit), MARK)
                m["key"], m["sub"] = c["key"][hit], c["sub"][hit]
                m["lo"] = c["at"][hit].astype(np.int64) + shift
                m["hi"] = m["lo"] + LENGTH
                found.append(m)
        return by_key(np.concatenate(found) if found else np.zeros(0, MARK), parts)

    return run


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents as key, sub, id, body; runs of bytes to remove as key, sub, marks: a list of packed (lo, hi) pairs)."""
    spark = docs.sparkSession
    by_doc = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 2 * by_doc
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.hash(body).alias("sub"), F.col(key).cast("long").alias("id"), body.alias("body"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in slices(batches, "body", SLICE):
            doc, at, gram, context, right = anchors(buf, offs)
            r = np.empty(len(doc), ANCHOR)
            r["gram"], r["context"], r["at"], r["right"] = gram, context, at, right
            r["key"], r["sub"] = (batch.column(i).to_numpy(zero_copy_only=False)[doc] for i in (0, 1))
            yield pa.RecordBatch.from_arrays(packed(r, (gram >> U64(20)).astype(np.int64) % parts), names=["bucket", "blob"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in slices(batches, "body", SLICE):
            out, gram = [], []
            key, sub, todo = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            for d in range(batch.num_rows):
                m = len(todo[d]) // 12
                at = np.frombuffer(todo[d], "<u4", m).astype(np.int64)
                t = buf[offs[d] : offs[d + 1]]
                p = np.zeros(m, PLACED)
                left = np.minimum(at, SPAN)
                n = np.minimum(len(t), at + LENGTH) - (at - left)
                p["key"], p["sub"], p["at"], p["left"], p["n"] = key[d], sub[d], at, left, n
                i = np.arange(CONTEXT)
                p["text"] = np.where(i < n[:, None], t[np.minimum((at - left)[:, None] + i, len(t) - 1)], 0)
                out.append(p)
                gram.append(np.frombuffer(todo[d], "<u8", m, 4 * m))
            p, gram = np.concatenate(out), np.concatenate(gram)
            yield pa.RecordBatch.from_arrays(packed(p, (gram >> U64(20)).astype(np.int64) % parts), names=["bucket", "blob"])

    schema, marked = "bucket int, blob binary", "key long, sub int, gone binary, todo binary"
    met = bounded(rows.select("key", "sub", "body")).mapInArrow(mark, schema)
    first = table(met.groupBy("bucket").applyInArrow(meet(by_doc), schema).groupBy("bucket").applyInArrow(gather, marked), "marks")
    todo = first.where(F.octet_length("todo") > 0).select("key", "sub", F.col("todo").alias("marks"))
    contexts = rows.select("key", "sub", "body").join(todo.hint("merge"), ["key", "sub"]).select("key", "sub", "body", "marks").mapInArrow(cut, schema)
    second = contexts.groupBy("bucket").applyInArrow(compare(by_doc), schema).groupBy("bucket").applyInArrow(gather, marked)
    runs = first.where(F.octet_length("gone") > 0).select("key", "sub", "gone").unionByName(second.select("key", "sub", "gone"))
    return rows, table(runs, "runs")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans) and ``kept`` binary, or with ``digests`` its SHA-256 as ``kept_sha256``.

    kept: the bytes that stay.  They need not be valid UTF-8, as a run may end within a character."""
    rows, runs = repeats(docs, key, text)
    schema = f"{key} long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digests else "kept binary")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in slices(batches, "body"):
            marks = batch.column(2).to_pylist()
            removed, spans, kept = [], [], []
            for d in range(batch.num_rows):
                t = buf[offs[d] : offs[d + 1]].tobytes()
                r = np.frombuffer(b"".join(marks[d] or ()), "<u4").reshape(-1, 2)
                r = merged(*r[np.argsort(r[:, 0], kind="stable")].T) if len(r) else r
                edge = [0, *r.ravel().tolist(), len(t)]
                removed.append(int((r[:, 1].astype(np.int64) - r[:, 0]).sum()))
                spans.append(len(r))
                kept.append(b"".join(t[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)))
            last = pa.array([hashlib.sha256(x).hexdigest() for x in kept]) if digests else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), last], names=[x.split()[0] for x in schema.split(", ")])

    marks = runs.groupBy("key", "sub").agg(F.collect_list("gone").alias("marks"))
    return rows.join(marks.hint("merge"), ["key", "sub"], "left").select("id", "body", "marks").mapInArrow(keep, schema)
