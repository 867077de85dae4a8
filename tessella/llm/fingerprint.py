"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (lines, and their sentences).  Each has a 64-bit digest, of which 16 bits check the other
48; a paragraph that comes again counts as another one.  The sketch has three tables of C cells; a digest goes into one
cell of each, which adds 1 to its count and is XORed into its value.  The difference of two sketches is a sketch of the
differing digests, which peeling recovers: a cell of count 1 or -1 whose value passes its check is a digest, and is taken
out of its three cells.  C is the smallest power of two at which a text's own sketch peels; sketches of different C
are compared at the smaller one (tables fold in half by addition), and larger ones are tried while peeling fails.  Two
paragraphs of one digest in a text never peel: after DOUBLINGS larger sizes its sorted digests stand in for the sketch.
Likeness is 1 for equal multisets of paragraphs, 0 for disjoint ones (shared over all).

Edge cases: null and empty texts have the empty sketch, like each other with 1; equal texts have equal fingerprints;
rows of a null key come first in the order of versions, rows of equal keys in the order of their texts' hashes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import bounded, extended
from ._text import BYTE_VALUES, U64, mix, powers, slices, stream

LOW = U64((1 << 48) - 1)
SEEDS = stream(3, 41)
LEAST = 4
DOUBLINGS = 6
ROUNDS = 200  # of peeling, far more than sketches that peel need; then it has failed


def checked(low: np.ndarray) -> np.ndarray:
    """48-bit values with their 16-bit checks on top."""
    low = low & LOW
    return low | (mix(low ^ SEEDS[0]) & ~LOW)


def paragraphs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all paragraphs in order of text, and each text's first one."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    n = len(buf)
    if not n:
        return np.zeros(0, U64), np.zeros(len(texts) + 1, np.int64)
    gap = (buf == 10) | (buf == 13)
    gap[1:] |= (buf[1:] == 32) & ((buf[:-1] == 46) | (buf[:-1] == 33) | (buf[:-1] == 63))
    inside = ~gap
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:], after[-1], after[:-1] = False, inside[:-1], False, inside[1:]
    before[offs[:-1][offs[:-1] < n]] = False
    after[offs[1:][offs[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    power, inverse = powers(n + 1)
    p = np.empty(n + 1, U64)
    p[0] = 0
    np.cumsum(BYTE_VALUES[buf] * power[:n], out=p[1:])
    h = mix((p[end] - p[start]) * inverse[start])
    first = np.searchsorted(start, offs)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    order = np.lexsort((h, doc))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
    again = np.zeros(len(h), U64)
    again[order] = run.astype(U64)
    return checked(mix(h + again * SEEDS[1])), first


class Sketches:
    """Sketches of many texts in flat arrays; text i has 3 * size[i] cells from base[i] on."""

    def __init__(self, size: np.ndarray):
        self.size = size.astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum(3 * self.size)])
        self.count = np.zeros(self.base[-1], np.int64)
        self.value = np.zeros(self.base[-1], U64)
        self.plain: dict[int, np.ndarray] = {}  # sorted digests of texts whose sketches are empty because they do not peel

    def digests(self, i: int) -> np.ndarray:
        """Sorted digests of a text."""
        return self.plain[i] if i in self.plain else np.sort(self.take(np.array([i]), self.size[i : i + 1]).peel()[1])

    def cells(self, doc: np.ndarray, digest: np.ndarray) -> list[np.ndarray]:
        c = self.size[doc]
        return [self.base[doc] + j * c + (mix(digest ^ SEEDS[j]) >> U64(20)).astype(np.int64) % c for j in range(3)]

    def add(self, doc: np.ndarray, digest: np.ndarray, sign: int | np.ndarray = 1) -> None:
        for at in self.cells(doc, digest):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.value, at, digest)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, digests, whether each text's sketch came out empty); destroys the sketches."""
        owner = np.repeat(np.arange(len(self.size)), 3 * self.size)
        docs, digests, signs = [], [], []
        look = np.flatnonzero(self.count != 0)
        for _ in range(ROUNDS):
            v = self.value[look]
            pure = (np.abs(self.count[look]) == 1) & (checked(v) == v)
            at = look[pure]
            # a value that passes its check by chance seldom belongs into the cell that it is in
            at = at[np.logical_or.reduce([x == at for x in self.cells(owner[at], self.value[at])])] if len(at) else at
            if not len(at):
                break
            key = np.stack([owner[at].astype(U64), self.value[at]], 1)
            _, one = np.unique(key, axis=0, return_index=True)
            at = at[one]
            doc, digest, sign = owner[at], self.value[at].copy(), self.count[at].copy()
            docs.append(doc), digests.append(digest), signs.append(sign)
            self.add(doc, digest, -sign)
            look = np.unique(np.concatenate(self.cells(doc, digest)))
            look = look[self.count[look] != 0]
        left = np.bincount(owner, weights=((self.count != 0) | (self.value != 0)), minlength=len(self.size))
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, U64), left == 0
        doc, digest, sign = np.concatenate(docs), np.concatenate(digests), np.concatenate(signs)
        # A value that passed its check by chance was taken out and later put back: its signs cancel.
        order = np.lexsort((digest, doc))
        doc, digest, sign = doc[order], digest[order], sign[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])]))
        there = np.add.reduceat(sign, new) != 0
        return doc[new][there], digest[new][there], left == 0

    def take(self, docs: np.ndarray, size: np.ndarray) -> "Sketches":
        """Copies of the sketches of ``docs``, folded to ``size`` cells a table."""
        out = Sketches(size)
        n = 3 * self.size[docs]
        doc = np.repeat(np.arange(len(docs)), n)
        i = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)
        c, d = self.size[docs][doc], size[doc]
        src, dst = self.base[docs][doc] + i, out.base[doc] + i // c * d + i % c % d
        np.add.at(out.count, dst, self.count[src])
        np.bitwise_xor.at(out.value, dst, self.value[src])
        return out


def build(digests: np.ndarray, first: np.ndarray) -> Sketches:
    """The smallest sketch of each text from which its digests can all be recovered."""
    n = np.diff(first)
    size = np.maximum(LEAST, 1 << np.ceil(np.log2(np.maximum(1, n / 2))).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), n)
    todo = np.arange(len(n))
    for _ in range(DOUBLINGS + 1):
        on = np.isin(doc, todo)
        trial = Sketches(size[todo])
        trial.add(np.searchsorted(todo, doc[on]), digests[on])
        _, _, ok = trial.peel()
        todo = todo[~ok]
        if not len(todo):
            break
        size[todo] *= 2
    size[todo] = LEAST
    out = Sketches(size)
    on = ~np.isin(doc, todo)
    out.add(doc[on], digests[on])
    out.plain = {i: np.sort(digests[first[i] : first[i + 1]]) for i in todo.tolist()}
    return out


def common(x: np.ndarray, y: np.ndarray) -> int:
    """What two sorted multisets share."""
    values = np.unique(np.concatenate([x, y]))
    count = lambda z: np.searchsorted(z, values, side="right") - np.searchsorted(z, values)
    return int(np.minimum(count(x), count(y)).sum())


def likeness(s: Sketches, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared over all paragraphs of the texts a[i] and b[i], from their sketches."""
    out = np.empty(len(a))
    size = np.minimum(s.size[a], s.size[b])
    plain = np.isin(a, [*s.plain]) | np.isin(b, [*s.plain])

    def exact(some: np.ndarray) -> None:
        for i in some.tolist():
            both = common(s.digests(int(a[i])), s.digests(int(b[i])))
            out[i] = both / max(1, int(n[a[i]] + n[b[i]]) - both) if n[a[i]] + n[b[i]] else 1.0

    exact(np.flatnonzero(plain))
    todo = np.flatnonzero(~plain)
    size = size[todo]
    x, y = s.take(a[todo], size), s.take(b[todo], size)
    x.count -= y.count
    x.value ^= y.value
    for turn in range(DOUBLINGS + 1):
        doc, _, ok = x.peel()
        d = np.bincount(doc, minlength=len(todo))
        total = n[a[todo]] + n[b[todo]]
        out[todo[ok]] = ((total - d) / np.maximum(1, total + d))[ok]
        out[todo[ok & (total == 0)]] = 1.0
        todo, size = todo[~ok], size[~ok] * 2
        if not len(todo) or turn == DOUBLINGS:
            break
        # The next size: each side's digests are all recovered from its own sketch and entered again.
        x = Sketches(size)
        for side, sign in ((a, 1), (b, -1)):
            own = s.take(side[todo], s.size[side[todo]])
            doc, digest, _ = own.peel()
            x.add(doc, digest, sign)
    exact(todo)
    return out


def printed(s: Sketches, n: np.ndarray) -> list[str]:
    """Paragraphs, cells a table, and the cells (count modulo 256, value) in base 64; of sorted digests 0 cells and those."""
    out = []
    count, value = (s.count & 255).astype(np.uint8).tobytes(), s.value.astype("<u8").tobytes()
    for i, (lo, hi) in enumerate(zip(s.base[:-1].tolist(), s.base[1:].tolist(), strict=True)):
        if i in s.plain:
            out.append(f"{n[i]}:0:{base64.b64encode(s.plain[i].astype('<u8').tobytes()).decode()}")
            continue
        out.append(f"{n[i]}:{s.size[i]}:{base64.b64encode(count[lo:hi] + value[8 * lo : 8 * hi]).decode()}" if n[i] else "0:0:")
    return out


def parsed(said: str) -> tuple[Sketches, np.ndarray]:
    n, size, cells = said.split(":")
    s = Sketches(np.array([int(size or 0) or LEAST]))
    raw = base64.b64decode(cells)
    if int(n) and int(size):
        m = 3 * int(size)
        s.count = np.frombuffer(raw[:m], np.int8).astype(np.int64)
        s.value = np.frombuffer(raw[m:], "<u8").astype(U64)
    elif int(n):
        s.plain[0] = np.frombuffer(raw, "<u8").astype(U64)
    return s, np.array([int(n)])


def compare(a: str, b: str) -> float:
    """Likeness of two printed fingerprints."""
    (s, n), (t, m) = parsed(a), parsed(b)
    both = Sketches(np.array([s.size[0], t.size[0]]))
    both.count, both.value = np.concatenate([s.count, t.count]), np.concatenate([s.value, t.value])
    both.plain = {i: x.plain[0] for i, x in enumerate((s, t)) if x.plain}
    return float(likeness(both, np.concatenate([n, m]), np.array([0]), np.array([1]))[0])


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds each text's printed ``fingerprint``."""
    schema = extended(df, keep, "fingerprint string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in slices(batches, "_text"):
            digests, first = paragraphs([(t or "").encode() for t in rows.column(rows.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(keep))), pa.array(printed(build(digests, first), np.diff(first)))], names=schema.names)

    return bounded(df.select(*keep, F.col(text).alias("_text"))).mapInArrow(run, schema)


NO_KEY = -(1 << 63)


def successors(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows dealt into ranges of the key, each followed by the row that comes next: columns _b, _after, _key, _text.

    Ranges are bounded by quantiles of the key, as many as the session has shuffle partitions; a range's first row is
    copied to the range before, the very first to the last.  Texts are shuffled once.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    k = F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY))
    cuts = docs.select(k.alias("k")).agg(F.percentile_approx("k", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("q")).head()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield rows.append_column("_b", pa.array(np.searchsorted(bounds, rows.column(0).to_numpy(zero_copy_only=False), side="right").astype(np.int32)))

    keys = docs.select(k.alias("_k"))
    heads = sorted(keys.mapInArrow(place, extended(keys, ("_k",), "_b int")).groupBy("_b").agg(F.min("_k")).collect())  # a row for each range
    first = np.array([h[1] for h in heads], np.int64)
    before = np.array([heads[i - 1][0] for i in range(len(heads))], np.int32)
    rows = docs.select(k.alias("_k"), F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kk = batch.column(0).to_numpy(zero_copy_only=False)
            names = [*batch.schema.names, "_b", "_after"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.searchsorted(bounds, kk, side="right").astype(np.int32)), pa.array(np.zeros(len(kk), bool))], names=names)
            head = np.flatnonzero(np.isin(kk, first))
            if len(head):
                more = batch.take(pa.array(head))
                yield pa.RecordBatch.from_arrays([*more.columns, pa.array(before[np.searchsorted(first, kk[head])]), pa.array(np.ones(len(head), bool))], names=names)

    dealt = bounded(rows).mapInArrow(deal, extended(rows, ("_k", "_key", "_text"), "_b int, _after boolean"))
    return dealt.repartitionById(parts, F.col("_b")).sortWithinPartitions("_b", "_after", "_k", F.xxhash64("_text")).select("_b", "_after", "_key", "_text")


def versions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited version (its second half replaced by the start of the next text) and
    their likeness: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    schema = f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def done(keys: list, texts: list[str]) -> pa.RecordBatch:
        """texts has one more than keys."""
        m = len(keys)
        edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(texts[:-1], texts[1:], strict=True)]
        raw = [t.encode() for t in (*texts, *edited)]
        digests, first = paragraphs(raw)
        n, s = np.diff(first), build(digests, first)
        said = printed(s, n)
        i = np.arange(m)
        near = likeness(s, n, np.concatenate([i, i]), np.concatenate([m + 1 + i, i + 1]))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(t) for t in texts[:m]], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw[m + 1 :]], pa.string()), pa.array(said[:m], pa.string()), pa.array(said[m + 1 :], pa.string()), pa.array(near[:m]), pa.array(near[m:])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row seen, whose next is still to come
        for rows, _, _ in slices(batches, "_text", 1 << 20):
            b, after, keys, texts = (rows.column(i).to_pylist() for i in range(4))
            if held is not None:
                b, after, keys, texts = [held[0], *b], [held[1], *after], [held[2], *keys], [held[3], *texts]
            lo = 0
            while lo < len(b) - 1:  # runs of rows of one range, each with its next
                hi = lo
                while hi < len(b) - 1 and b[hi + 1] == b[lo] and not after[hi]:
                    hi += 1
                if hi > lo:
                    yield done(keys[lo:hi], texts[lo : hi + 1])
                lo = hi + (after[hi] or b[min(hi + 1, len(b) - 1)] != b[hi])
            held = (b[-1], after[-1], keys[-1], texts[-1])

    return bounded(successors(docs, key, text)).mapInArrow(run, schema)
