"""MinHash near-duplicates by an LSH forest.

A document's set is its distinct k-word shingles.  Documents of equal sets are one class, and only classes go on.  A
signature of ``HASHES`` minima is cut into ``TREES`` orders; in each, classes sort by their signature, and those that
share a prefix of ``DEPTH`` values form a region.  A class's candidates are its neighbours in the sort (longest common
prefix) and the region's least; a sketch of the signature screens them.  Links are confirmed on full sets.

Rounds: every class checks its best candidate; confirmed links join components; then candidates are sought only
between different components of a region, the best of each class again, and in the last round all of them that can
be linked at all, whatever the region's size: shingles that no other set has bound what a pair can share.  A link that
is skipped joins two classes that are connected already.

At similarity s a pair shares no region with probability (1 - s**DEPTH)**TREES: under 3e-7 at 0.85.  A pair of which the
sketches agree less than SCREEN_SIGMAS under what s leads one to expect is screened out: under 2e-6 of such pairs.

Edge cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a null key is in
no component; rows of one key are one node; repeated rows are one class; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import bounded, few, table
from ._text import U64, distinct, handed_back, mix, settle, shingles, slices, span_hashes, stream, words
from .components import components

HASHES, TREES, DEPTH = 128, 16, 3
EACH = HASHES // TREES
STEP = 1 << 16  # pairs in one step
SKETCH = HASHES // 2  # bytes: four bits of each minimum
FACTORS = stream(HASHES, 101) | U64(1)
RUN = 1024  # sets whose shingles are told apart at once
FIELDS = [("key", "<u8"), ("id", "<i8"), ("n", "<i4"), ("own", "<i4"), ("comp", "<i8"), ("tree", "u1"), ("sketch", "u1", SKETCH)]
BEST, EVERY = np.dtype([*FIELDS, ("deep", "<u8")]), np.dtype([*FIELDS, ("keys", "<u4", TREES)])  # entries of the rounds
EQUAL = np.array([(not x & 15) + (not x & 240) for x in range(256)], np.uint8)
SCREEN_SIGMAS = 4.8


def sets(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = words(buf, offs)
    if not len(start):
        return np.zeros(0, U64), np.zeros(len(offs), np.int64)
    return distinct(*shingles(span_hashes(buf, start, end), first, k))


def minima(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """uint32 rows of HASHES minima for each non-empty segment; zeros for an empty one."""
    out = np.zeros((len(offs) - 1, HASHES), np.uint32)
    some = np.flatnonzero(offs[1:] > offs[:-1])
    if len(some):
        at = offs[:-1][some]
        low = (values >> U64(32)).astype(np.uint32)
        high = (values & U64(0xFFFFFFFF)).astype(np.uint32)
        for j in range(HASHES):
            f = int(FACTORS[j])
            h = low * np.uint32(f >> 32 | 1)
            h ^= h >> np.uint32(15)
            h += high * np.uint32(f & 0xFFFFFFFF)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(13)
            out[some, j] = np.minimum.reduceat(h, at)
    return out


def signatures(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(id, n, s1, s2, sig): the set's size, two sums over it that stand for its content, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("neardup")
        for rows, buf, offs in slices(batches, "_text"):
            values, at = sets(buf, offs, k)
            sums = []
            for salt in (0x1234567, 0x89ABCDEF):
                total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(values ^ U64(salt)))])
                sums.append(pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)))
            sig = minima(values, at)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(at)), *sums, pa.array([x.tobytes() for x in sig], pa.binary())], names=["id", "n", "s1", "s2", "sig"])

    return bounded(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("_text"))).mapInArrow(run, "id long, n long, s1 long, s2 long, sig binary")


def deal(classes: DataFrame, every: bool, parts: int) -> DataFrame:
    """Entries of all trees as packed rows (bucket, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            m = rows.num_rows
            if not m:
                continue
            ids, n, comp, own = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4))
            sig = np.frombuffer(b"".join(rows.column(2).to_pylist()), "<u4").reshape(m, HASHES)
            half = sig & np.uint32(15)
            sketch = (half[:, ::2] | half[:, 1::2] << np.uint32(4)).astype(np.uint8)
            out = np.empty((TREES, m), EVERY if every else BEST)
            for t in range(TREES):
                part = sig[:, t * EACH : (t + 1) * EACH].astype(U64)
                key = np.full(m, t + 1, U64)
                for j in range(DEPTH):
                    key = mix(key * U64(0x9E3779B97F4A7C15) + part[:, j])
                e = out[t]
                e["tree"], e["key"], e["id"], e["n"], e["own"], e["comp"], e["sketch"] = t, key, ids, n, own, comp, sketch
                if every:
                    out["keys"][:, :, t] = key.astype(np.uint32)
                    continue
                deep = np.zeros(m, U64)
                for j in range(DEPTH, DEPTH + 4):
                    deep = deep << U64(16) | part[:, j] & U64(0xFFFF)
                e["deep"] = deep
            out = out.ravel()
            bucket = (out["key"] % U64(parts)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            out, bucket = out[order], bucket[order]
            there, at = np.unique(bucket, return_index=True)
            cut = [*at.tolist(), len(out)]
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array([out[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["bucket", "blob"])

    return bounded(classes.select("id", "n", "sig", "comp", "own")).mapInArrow(run, "bucket int, blob binary")


def seek(every: bool, similarity: float):
    """Candidates of one bucket: (a, b, est), a > b.  Where ``every`` is not set, only each class's best."""
    p = similarity + (1 - similarity) / 16
    least = (p - SCREEN_SIGMAS * (p * (1 - p) / HASHES) ** 0.5) * HASHES

    def screened(e: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lo, hi = np.minimum(e["n"][i], e["n"][j]), np.maximum(e["n"][i], e["n"][j])
        most = np.minimum(e["n"][i] - e["own"][i], e["n"][j] - e["own"][j])  # what both can share
        ok = (e["comp"][i] != e["comp"][j]) & (most >= similarity * (lo + hi - most) - 1e-6)
        i, j = i[ok], j[ok]
        differ = e["sketch"][i] ^ e["sketch"][j]
        same = EQUAL[differ].sum(1)
        ok = same >= least
        if every:
            # A pair that shares the prefixes of several trees is left to the first of them, which compares it whatever
            # its region's size.  32 bits of the keys tell: other prefixes agree in them with a chance under 4e-9.
            i, j, same = i[ok], j[ok], same[ok]
            met = e["keys"][i] == e["keys"][j]
            ok = ~(met & (np.arange(TREES) < e["tree"][i][:, None])).any(1)
        i, j, same = i[ok], j[ok], same[ok]
        a, b = e["id"][i], e["id"][j]
        return np.maximum(a, b), np.minimum(a, b), same.astype(np.int32)

    def run(rows: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(rows.column("blob").to_pylist()), EVERY if every else BEST)
        e = e[np.lexsort((e["id"], e["comp" if every else "deep"], e["key"]))]
        new = np.ones(len(e), bool)
        new[1:] = e["key"][1:] != e["key"][:-1]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(e)))
        region = np.repeat(np.arange(len(at)), size)
        found = []
        if len(at):
            if every:
                # sorted by component, an entry goes against those of its region that come before its component
                part = new.copy()
                part[1:] |= e["comp"][1:] != e["comp"][:-1]
                lo, before = at[region], np.flatnonzero(part)[np.cumsum(part) - 1]
                before -= lo
                total = np.concatenate([[0], np.cumsum(before)])
                for begin in range(0, int(total[-1]), STEP):
                    pair = np.arange(begin, min(begin + STEP, int(total[-1])))
                    i = np.searchsorted(total, pair, side="right") - 1
                    found.append(screened(e, i, lo[i] + pair - total[i]))
            else:
                differs = np.minimum.reduceat(e["comp"], at) != np.maximum.reduceat(e["comp"], at)
                live = np.flatnonzero(differs[region])
                i = live[(live > 0) & ~new[live]]
                found.append(screened(e, i, i - 1))
                least_at = np.lexsort((e["id"], region))[at]
                found.append(screened(e, live, least_at[region[live]]))
        a, b, s = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3))
        if len(a):
            order = np.lexsort((b, -s, a))
            a, b, s = a[order], b[order], s[order]
            keep = np.ones(len(a), bool)
            keep[1:] = (a[1:] != a[:-1]) | ((b[1:] != b[:-1]) if every else False)
            a, b, s = a[keep], b[keep], s[keep]
        each = np.unique(np.concatenate([a, b]))  # a row of its own, so that its set is at hand in later rounds
        a, b, s = np.concatenate([a, each]), np.concatenate([b, each]), np.concatenate([s, np.full(len(each), -1)])
        handed_back()
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.int32())], names=["a", "b", "est"])

    return run


def candidates(classes: DataFrame, every: bool, similarity: float) -> DataFrame:
    parts = 4 * int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = deal(classes, every, parts).groupBy("bucket").applyInArrow(seek(every, similarity), "a long, b long, est int")
    if every:
        return found.groupBy("a", "b").agg(F.max("est").alias("est"))
    return found.groupBy("a").agg(F.max(F.struct("est", (-F.col("b")).alias("b"))).alias("x")).select("a", (-F.col("x.b")).alias("b"), "x.est")


def ids_of(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Semi-join on ``id``."""
    return df.join(few(ids), "id", "left_semi")


def full_sets(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(id, set): sorted distinct shingle hashes as packed 64-bit values; one row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("neardup")
        for rows, buf, offs in slices(batches, "_text"):
            values, at = sets(buf, offs, k)
            raw = values.tobytes()
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], names=["id", "set"])

    return bounded(docs.select(F.col(key).alias("id"), F.col(text).alias("_text"))).mapInArrow(run, "id long, set binary")


def unshared(whole: DataFrame) -> DataFrame:
    """(id, own): how many shingles of each set are in no other one.  Shingles meet packed by bucket, as the entries do;
    of a shingle that is common within a run of sets only two entries go on, enough to tell that it is no set's own."""
    parts = 4 * int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pair = np.dtype([("h", "<u8"), ("id", "<i8")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for lo in range(0, rows.num_rows, RUN):
                raw = rows.column(1).slice(lo, RUN).to_pylist()
                e = np.empty(sum(len(x) for x in raw) // 8, pair)
                e["h"] = np.frombuffer(b"".join(raw), U64)
                e["id"] = np.repeat(rows.column(0).slice(lo, RUN).to_numpy(zero_copy_only=False), [len(x) // 8 for x in raw])
                e = e[np.argsort(e["h"], kind="stable")]
                third = np.zeros(len(e), bool)
                third[2:] = e["h"][2:] == e["h"][:-2]
                e = e[~third]
                bucket = (e["h"] >> U64(24)) % U64(parts)
                order = np.argsort(bucket, kind="stable")
                e, bucket = e[order], bucket[order].astype(np.int32)
                there, at = np.unique(bucket, return_index=True)
                cut = [*at.tolist(), len(e)]
                yield pa.RecordBatch.from_arrays([pa.array(there), pa.array([e[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["bucket", "blob"])

    def alone(rows: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(rows.column("blob").to_pylist()), pair)
        order = np.argsort(e["h"], kind="stable")
        h = e["h"][order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        last = np.concatenate([new[1:], [True]])
        ids, n = np.unique(e["id"][order][new & last], return_counts=True)
        del e, order, h, new, last
        handed_back()
        return pa.table([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["id", "own"])

    return whole.select("id", "set").mapInArrow(run, "bucket int, blob binary").groupBy("bucket").applyInArrow(alone, "id long, own long").groupBy("id").agg(F.sum("own").alias("own"))


def confirmed(pairs: DataFrame, whole: DataFrame, hundredths: int) -> DataFrame:
    """The pairs with 100 * intersection >= hundredths * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ok = []
            for x, y in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True):
                both = np.concatenate([np.frombuffer(x, U64), np.frombuffer(y, U64)])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= hundredths * (len(both) - shared))
            yield rows.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        handed_back()

    sides = pairs.select("a", "b").join(whole.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(whole.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return bounded(sides.select("a", "b", "x", "y")).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, hundredths: int = 85, best_rounds: int = 1) -> DataFrame:
    """(key, n_shingles, component_id, kept): component_id is the least key that links reach, kept whether it is the row's own."""
    similarity = hundredths / 100
    every = table(signatures(docs, key, text, k), "signatures")
    mine: Column = F.col("id")
    some = every.where("n > 0 and id is not null")
    reps = some.groupBy("s1", "s2").agg(F.min("id").alias("rep"))
    classes = some.join(reps.withColumnRenamed("rep", "id"), ["s1", "s2", "id"], "left_semi").dropDuplicates(["s1", "s2", "id"])
    classes = table(classes, "classes")
    whole, links, roots = None, [], None
    for turn in range(best_rounds + 1):
        last = turn == best_rounds
        with_comp = classes.withColumn("comp", mine) if roots is None else classes.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("root", mine)).drop("root")
        if last:
            # a class of which too much is in no other set can't have a link, nor can a pair that can't share enough
            with_comp = with_comp.join(table(unshared(whole), "unshared"), "id", "left").withColumn("own", F.coalesce("own", F.lit(0)))
            with_comp = with_comp.where(f"100 * (n - own) >= {hundredths} * n")
        else:
            with_comp = with_comp.withColumn("own", F.lit(0))
        pairs = table(candidates(with_comp, last, similarity), "candidates")
        ids = pairs.select(F.col("a").alias("id")).distinct()  # each has a row of its own
        if whole is not None:
            ids = ids.join(whole, "id", "left_anti")
        ids = table(ids, "ids")
        if whole is None or ids.limit(1).count():
            texts = ids_of(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("_text")), ids)
            more = table(full_sets(texts, "id", "_text", k).dropDuplicates(["id"]), "sets")
            whole = more if whole is None else whole.unionByName(more)
        links.append(table(confirmed(pairs.where("a != b"), whole, hundredths), "links"))
        roots = components(reduce(DataFrame.unionByName, links))
        roots = table(roots, "roots")
    final = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("root", "rep").alias("root"))
    out = every.join(final, ["s1", "s2"], "left")
    component = F.when((F.col("n") > 0) & mine.isNotNull(), F.coalesce("root", mine)).otherwise(mine)
    return out.select(mine.alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == mine, F.lit(True)).alias("kept"))
