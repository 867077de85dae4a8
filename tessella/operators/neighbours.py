"""Exact nearest neighbours over coordinates and embeddings, homogeneous neighbourhoods, graphs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import exprs as E
from tessella.operators.relational import top_k


def settled(df: DataFrame) -> DataFrame:
    """The rows as written to spark.checkpoint.dir, where it is set, so that later uses don't make them again."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def _parts(n: int, extents: Sequence[float], size: int) -> int:
    """Into how many parts the first of ``extents`` is cut, a power of two, so that n points make near-square leaves of ``size``."""
    free = [i for i, e in enumerate(extents) if e > 0]
    while free:
        w = float(np.exp((sum(np.log(extents[i]) for i in free) - np.log(max(1.0, n / size))) / len(free)))
        if all(extents[i] >= w for i in free):
            break
        free = [i for i in free if extents[i] >= w]
    return 2 ** round(float(np.log2(extents[0] / w))) if 0 in free else 1


def _leaf_of(g: np.ndarray, at: Sequence[np.ndarray], cuts: dict) -> np.ndarray:
    """The leaf of each point: dimension by dimension, node l of a group becomes l * width + part."""
    leaf = np.zeros(len(g), np.int64)
    for i, c in enumerate(at):
        order = np.lexsort((leaf, g))
        starts = np.flatnonzero(np.r_[True, (np.diff(g[order]) != 0) | (np.diff(leaf[order]) != 0)]) if len(g) else []
        part, width = np.zeros(len(g), np.int64), cuts.get(("width", i), 1)
        for a, b in zip(starts, [*starts[1:], len(g)]):
            rows = order[a:b]
            cut = cuts.get((i, int(g[rows[0]]), int(leaf[rows[0]])))
            if cut is not None:
                part[rows] = np.searchsorted(cut, c[rows], "right")
        leaf = leaf * width + part
    return leaf


def _leaves(places: DataFrame, by: Sequence[str], coords: Sequence[str], size: int):
    """(a function that adds ``_g`` and ``_leaf`` to a table, {group: (leaves, counts, least, greatest coordinates)}).

    Groups of more than 2 * size points are cut by quantiles into leaves of about ``size``, one dimension after the other, each
    node by its own count and extents; what is gathered is a row for each node and a box for each leaf.  Other groups are one leaf."""
    spark, cols, d = places.sparkSession, list(by), len(coords)
    big = places.groupBy(*cols).count().where(F.col("count") > 2 * size).select(*cols).collect()
    if not big:
        return (lambda df: df.withColumns({"_g": F.lit(-1), "_leaf": F.lit(0).cast("long")})), {}
    cuts: dict = {}

    def shared(rows: list, kind: T.StructType | str) -> DataFrame:
        df = spark.createDataFrame(rows, kind)
        return F.broadcast(df) if len(rows) <= 100_000 else df

    if cols:
        names = shared([(*r, i) for i, r in enumerate(big)], places.select(*cols, F.lit(0).alias("_g")).schema)

    def tagged(df: DataFrame) -> DataFrame:
        known = dict(cuts)

        @F.pandas_udf("long")
        def leaf(g: pd.Series, *at: pd.Series) -> pd.Series:
            return pd.Series(_leaf_of(g.to_numpy(), [c.to_numpy(np.float64) for c in at], known))

        out = df.join(names, cols, "left").withColumn("_g", F.coalesce("_g", F.lit(-1))) if cols else df.withColumn("_g", F.lit(0))
        return out.withColumn("_leaf", leaf("_g", *(F.col(c).cast("double") for c in coords)) if known else F.lit(0).cast("long"))

    for i in range(d):
        rows = tagged(places).where("_g >= 0")
        spread = [x for c in coords[i:] for x in (F.percentile_approx(c, [0.05, 0.95], 1000), F.array(F.min(c), F.max(c)))]
        parts: dict = {}
        for g, leaf, n, *s in rows.groupBy("_g", "_leaf").agg(F.count(F.lit(1)), *spread).collect():
            extents = [(q[1] - q[0]) or (m[1] - m[0]) for q, m in zip(s[::2], s[1::2])]
            parts.setdefault(_parts(n, [float(e) for e in extents], size), []).append((g, leaf))
        cuts["width", i] = max(parts)
        found = {}
        for p, nodes in parts.items():
            if p > 1:
                own = rows.join(shared(nodes, "_g int, _leaf long"), ["_g", "_leaf"], "left_semi")
                for g, leaf, q in own.groupBy("_g", "_leaf").agg(F.percentile_approx(coords[i], [j / p for j in range(1, p)], max(1000, 10 * p))).collect():
                    found[i, g, leaf] = np.array(q, np.float64)
        cuts |= found
    boxes: dict = {}
    limits = [f(F.col(c).cast("double")) for f in (F.min, F.max) for c in coords]
    for g, *box in tagged(places).where("_g >= 0").groupBy("_g", "_leaf").agg(F.count(F.lit(1)), *limits).collect():
        boxes.setdefault(g, []).append(box)
    arrays = {g: np.array(b, np.float64) for g, b in boxes.items()}
    return tagged, {g: (a[:, 0].astype(np.int64), a[:, 1], a[:, 2 : 2 + d], a[:, 2 + d :]) for g, a in arrays.items()}


def _gaps(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: bool = False) -> np.ndarray:
    """Least (or greatest) distances of points from boxes, by the same steps as distances, so rounding can't turn their order."""
    total = np.zeros((len(x), len(lo)))
    for i in range(x.shape[1]):
        a, b = lo[None, :, i] - x[:, None, i], x[:, None, i] - hi[None, :, i]
        e = np.maximum(np.abs(a), np.abs(b)) if most else np.maximum(0.0, np.maximum(a, b))
        total += e * e
    return np.sqrt(total)


def _visits(x: np.ndarray, far: np.ndarray, k: int, leaf: int, boxes: tuple | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """(reach, leaves): the other leaves that may hold one of a point's k nearest, as the k-th of its own is ``far`` away."""
    if boxes is None:
        return far, [np.zeros(0, np.int64)] * len(x)
    leaves, counts, lo, hi = boxes
    far = far.copy()
    for i in np.flatnonzero(np.isinf(far)):  # fewer than k in its own leaf: so many boxes that they hold k
        most = _gaps(x[i : i + 1], lo, hi, True)[0]
        order = np.argsort(most)
        enough = np.searchsorted(np.cumsum(counts[order]), k)
        far[i] = most[order[enough]] if enough < len(order) else np.inf
    low, high = x.min(0), x.max(0)
    near = (np.sqrt((np.maximum(0.0, np.maximum(lo - high, low - hi)) ** 2).sum(1)) * (1 - 1e-9) <= far.max()) & (leaves != leaf)
    lo, hi, leaves, out = lo[near], hi[near], leaves[near], []
    step = max(1, (1 << 19) // max(1, len(leaves)))
    for a in range(0, len(x), step):
        out += [leaves[row] for row in _gaps(x[a : a + step], lo, hi) <= far[a : a + step, None]]
    return far, out


def _nearest(x: np.ndarray, pool: np.ndarray, k: int, reach: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, dist) of the k nearest of ``pool`` within reach, in order of row, distance and place."""
    found = []
    step = max(1, (1 << 19) // max(1, len(pool)))
    for a in range(0, len(x), step):
        at = x[a : a + step]
        dist = np.zeros((len(at), len(pool)))
        for i in range(x.shape[1]):
            e = at[:, None, i] - pool[None, :, i]
            dist += e * e
        np.sqrt(dist, dist)
        bar = np.partition(dist, k - 1, 1)[:, k - 1] if len(pool) > k else np.full(len(at), np.inf)
        if reach is not None:
            bar = np.minimum(bar, reach[a : a + step])
        r, c = np.nonzero(dist <= bar[:, None])
        v = dist[r, c]
        order = np.lexsort((c, v, r))
        r, c, v = r[order], c[order], v[order]
        n = np.bincount(r, minlength=len(at))
        keep = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n) < k
        found.append((r[keep] + a, c[keep], v[keep]))
    return tuple(np.concatenate(z) for z in zip(*found))  # type: ignore[return-value]


def _search(k: int, n_by: int, d: int, boxes: dict | None):
    """A function over batches of (by, _g, _leaf, _asked, _reach, key, nbr, coordinates), sorted by all up to _asked and then by nbr.

    The pool rows of a leaf come first and are held; the queries after them are answered a few at a time.  With ``boxes``
    the reach and the leaves to visit are found, without them the reach is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, waiting, ready = None, [], [], 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            new[0] = True
            for i in (*range(n_by), n_by + 1):
                new[1:] |= pc.not_equal(batch.column(i).slice(1), batch.column(i).slice(0, n - 1)).to_numpy(zero_copy_only=False)
            asked = batch.column(n_by + 2).to_numpy(zero_copy_only=False)
            x = np.stack([batch.column(n_by + 6 + i).to_numpy(zero_copy_only=False) for i in range(d)], 1)
            starts = np.flatnonzero(new)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n]):
                leaf = tuple(batch.column(i)[a].as_py() for i in (*range(n_by), n_by + 1))
                if leaf != here:
                    here, held = leaf, []
                mid = a + int(np.searchsorted(asked[a:b], 1))
                if mid > a:
                    held.append((x[a:mid], batch.column(n_by + 5).slice(a, mid - a)))
                if mid == b:
                    continue
                if len(held) > 1:
                    held = [(np.concatenate([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]))]
                pool, names = held[0] if held else (np.zeros((0, d)), batch.column(n_by + 5).slice(0, 0))
                own, m = batch.slice(mid, b - mid), b - mid
                reach = None if boxes is not None else own.column(n_by + 3).to_numpy(zero_copy_only=False)
                r, c, v = _nearest(x[mid:b], pool, k, reach)
                ends = np.cumsum(np.bincount(r, minlength=m))
                visits: list = [np.zeros(0, np.int64)] * m
                if boxes is not None:
                    reach = np.full(m, np.inf)
                    full = np.diff(ends, prepend=0) == k
                    reach[full] = v[ends[full] - 1]
                    reach, visits = _visits(x[mid:b], reach, k, leaf[-1], boxes.get(own.column(n_by)[0].as_py()))
                offsets = lambda e: pa.array(np.r_[0, e].astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets(ends), names.take(pa.array(c))), pa.ListArray.from_arrays(offsets(ends), pa.array(v)), pa.ListArray.from_arrays(offsets(np.cumsum([len(z) for z in visits])), pa.array(np.concatenate(visits)))]
                columns = [*(own.column(i) for i in (*range(n_by + 1), n_by + 4, *range(n_by + 6, n_by + 6 + d))), pa.array(reach), *lists]
                waiting.append(pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))]))
                ready += m + len(c)
                if ready > 1 << 16:
                    yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                    waiting, ready = [], 0
        if waiting:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()

    return run


def knn(query: DataFrame, pool: DataFrame, k: int, by: Sequence[str] = (), key: str = "cell", coords: Sequence[str] = ("x", "y"), per_leaf: int = 512) -> DataFrame:
    """(query key, nbr, dist, pos): the k nearest pool points of each query point in its group, itself included if it is there.

    Quantiles cut each large group into near-square leaves of about ``per_leaf`` places, or 8 * k.  A query's k nearest in
    its own leaf bound its reach; it visits the other leaves whose boxes are within that, so the result is exact and no pair
    outside a leaf's own search leaves a task.  Ties go to the smaller key; of pool rows at one place the k smallest keys count.
    Rows without a place, or with a null in ``by``, are no one's neighbours and have none."""
    cols, d, size = list(by), len(coords), max(per_leaf, 8 * k)
    some = reduce(lambda a, b: a & b, (*(F.col(c).isNotNull() for c in cols), *(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in coords)))
    places = settled(top_k(pool.where(some).select(*cols, F.col(key).alias("nbr"), *coords), [*cols, *coords], ["nbr"], k))
    tagged, boxes = _leaves(places, cols, coords, size)
    kinds = {"_key": query.schema[key].dataType, "nbr": places.schema["nbr"].dataType}
    names = ["_key", *(f"_c{i}" for i in range(d)), "_reach", "_nbrs", "_dists", "_visits"]
    schema = T.StructType([*(places.schema[c] for c in cols), T.StructField("_g", T.IntegerType()), T.StructField("_key", kinds["_key"]), *(T.StructField(f"_c{i}", T.DoubleType()) for i in range(d)), T.StructField("_reach", T.DoubleType()), T.StructField("_nbrs", T.ArrayType(kinds["nbr"])), T.StructField("_dists", T.ArrayType(T.DoubleType())), T.StructField("_visits", T.ArrayType(T.LongType()))])
    held = tagged(places).select(*cols, "_g", "_leaf", F.lit(0).alias("_asked"), F.lit(0.0).alias("_reach"), F.lit(None).cast(kinds["_key"]).alias("_key"), "nbr", *(F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(coords)))

    def searched(queries: DataFrame, found: dict | None) -> DataFrame:
        rows = held.unionByName(queries.withColumns({"_asked": F.lit(1), "nbr": F.lit(None).cast(kinds["nbr"])})).repartition(*cols, "_leaf")
        return rows.sortWithinPartitions(*cols, "_leaf", "_asked", "nbr").mapInArrow(_search(k, len(cols), d, found), schema)

    flat = lambda df: df.select(*cols, F.col("_key").alias(key), F.posexplode(F.arrays_zip("_nbrs", "_dists")).alias("pos", "_x")).select(*cols, key, F.col("_x._nbrs").alias("nbr"), F.col("_x._dists").alias("dist"), (F.col("pos") + 1).alias("pos"))
    asked = tagged(query.where(some).select(*cols, F.col(key).alias("_key"), *coords)).select(*cols, "_g", "_leaf", F.lit(0.0).alias("_reach"), "_key", *(F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(coords)))
    first = searched(asked, boxes)
    if not boxes:
        return flat(first)
    first = settled(first)
    more = first.where(F.size("_visits") > 0)
    there = searched(more.select(*cols, "_g", F.explode("_visits").alias("_leaf"), *names[: d + 2]), None)
    best = top_k(flat(more).unionByName(flat(there)).drop("pos"), [*cols, key], ["dist", "nbr"], k, "pos")
    return flat(first.where(F.size("_visits") == 0)).unionByName(best)


def embedding_knn(query: DataFrame, pool: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", metric: str = "cosine", block_rows: int = 4096) -> DataFrame:
    """(key, nbr, sim, pos): the k most similar pool rows of each query row, exactly, by blocked matrix products.

    The pool is read once for each block of ``block_rows`` queries, a stated query set that is broadcast; each task keeps
    its own k best of each query, which one window then merges.  metric: cosine, or euclidean (sim is minus the distance)."""
    out = None
    block: list = []

    def against(rows: list) -> DataFrame:
        q = np.array([r[1] for r in rows], np.float64)
        ids = np.array([r[0] for r in rows])
        shared = pool.sparkSession.sparkContext.broadcast((ids, q / np.maximum(1e-12, np.linalg.norm(q, axis=1, keepdims=True)) if metric == "cosine" else q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best_s, best_i = np.full((len(q), 0), 0.0), np.full((len(q), 0), 0)
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = np.array(batch.column(1).to_pylist(), np.float64)
                names = batch.column(0).to_numpy(zero_copy_only=False)
                if metric == "cosine":
                    s = q @ (v / np.maximum(1e-12, np.linalg.norm(v, axis=1, keepdims=True))).T
                else:
                    s = -np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] - 2 * q @ v.T + (v * v).sum(1)))
                s = np.concatenate([best_s, s], 1)
                i = np.concatenate([best_i, np.tile(names, (len(q), 1))], 1)
                order = np.lexsort((i, -np.round(s, 12)), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            n = best_s.shape[1]
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n), pa.int64()), pa.array(best_i.ravel(), pa.int64()), pa.array(best_s.ravel())], names=["_q", "nbr", "sim"])

        part = pool.select(F.col(key).cast("long"), vector).mapInArrow(run, "_q long, nbr long, sim double")
        return top_k(part, ["_q"], [F.round("sim", 12).desc(), "nbr"], k, "pos").withColumnRenamed("_q", key)

    for row in query.select(F.col(key).cast("long"), vector).orderBy(key).toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == block_rows:
            part, block = against(block), []
            out = part if out is None else out.unionByName(part)
    if block or out is None:
        part = against(block) if block else query.select(F.col(key).cast("long").alias(key), F.lit(0).cast("long").alias("nbr"), F.lit(0.0).alias("sim"), F.lit(0).alias("pos")).limit(0)
        out = part if out is None else out.unionByName(part)
    return out


def fuzzy_weights(neighbours: DataFrame, key: str, k: int, steps: int = 40, normalised: bool = True) -> DataFrame:
    """Weights exp(-max(0, dist - rho) / sigma), rho the least distance over 0, sigma by bisection so that they sum to
    log2 k; a row's own place has none.  Normalised to 1 unless asked otherwise."""
    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf["dist"].to_numpy()
        rho = d[d > 0].min() if (d > 0).any() else 0.0
        lo, hi = 1e-9, max(1e-6, d.max() * 1e3)
        for _ in range(steps):
            s = (lo + hi) / 2
            lo, hi = (s, hi) if np.exp(-np.maximum(0, d - rho) / s).sum() < np.log2(k) else (lo, s)
        w = np.exp(-np.maximum(0, d - rho) / hi)
        return pdf.assign(weight=w / w.sum() if normalised else w)[[key, "nbr", "weight"]]

    kind = dict(neighbours.dtypes)
    others = neighbours.where(F.col(key) != F.col("nbr"))
    return others.select(key, "nbr", "dist").groupBy(key).applyInPandas(weigh, f"`{key}` {kind[key]}, nbr {kind['nbr']}, weight double")


def fuzzy_union(weights: DataFrame, k: int, key: str = "cell") -> DataFrame:
    """The symmetric union a + b - a b of directed weights; each row's k heaviest neighbours, normalised to 1."""
    back = weights.select(F.col("nbr").alias(key), F.col(key).alias("nbr"), F.col("weight").alias("_b"))
    both = weights.join(back, [key, "nbr"], "full").fillna(0.0, ["weight", "_b"]).withColumn("weight", F.col("weight") + F.col("_b") - F.col("weight") * F.col("_b")).drop("_b")
    best = top_k(both, [key], [F.desc("weight"), "nbr"], k)
    total = F.sum("weight").over(Window.partitionBy(key))
    return best.withColumn("weight", F.when(total > 0, F.col("weight") / total).otherwise(0.0))


def embedding_graph(cells: DataFrame, k: int, vector: str = "emb_cell", by: str = "annotation", key: str = "cell") -> DataFrame:
    """(key, nbr, weight): the k-NN graph of embeddings within each group, for cells that have no place."""
    numbered = cells.select(key, by, vector, F.xxhash64(key).alias("_id"))
    out = None
    for (g,) in cells.select(by).distinct().orderBy(by).collect():  # a group's label each
        own = numbered.where(F.col(by).eqNullSafe(F.lit(g))).select("_id", vector)
        near = embedding_knn(own, own, k, "_id", vector, "euclidean").select("_id", "nbr", (-F.col("sim")).alias("dist"))
        part = fuzzy_union(fuzzy_weights(near, "_id", k, normalised=False), k, "_id")
        out = part if out is None else out.unionByName(part)
    names = numbered.select("_id", key)
    named = out.join(names, "_id").select(key, F.col("nbr").alias("_id"), "weight")
    return named.join(names.withColumnRenamed(key, "nbr"), "_id").select(key, "nbr", "weight")


def cross_slice_knn(cells: DataFrame, k: int, k_adjacent: int, n_adjacent: int = 1, by: Sequence[str] = ("annotation",), slice_col: str = "slice", key: str = "cell", coords: Sequence[str] = ("x", "y")) -> DataFrame:
    """Neighbours within the own slice (slot 0) and in each of 2n adjacent slices (slots +1, -1, +2, -2, ...).

    Where one side lacks slices, deeper slices of the other stand in, up to 2n in all."""
    own = knn(cells, cells, k, [*by, slice_col], key, coords).select(*by, key, "nbr", "dist", "pos", F.lit(0).alias("slot"))
    if not n_adjacent:
        return own
    slices = cells.select(slice_col).distinct().withColumn("_i", F.dense_rank().over(Window.orderBy(slice_col)))
    pairs = slices.alias("a").join(slices.alias("b"), F.abs(F.col("a._i") - F.col("b._i")).between(1, 2 * n_adjacent)).select(F.col(f"a.{slice_col}").alias("_own"), F.col(f"b.{slice_col}").alias(slice_col), (F.col("b._i") - F.col("a._i")).alias("_off"))
    w = Window.partitionBy("_own").orderBy(F.abs("_off"), F.desc("_off"))
    pairs = pairs.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= 2 * n_adjacent)
    asked = cells.withColumnRenamed(slice_col, "_own").join(pairs.select("_own", slice_col, "slot"), "_own")
    asked = asked.withColumn("_asked", F.struct(F.col(key).alias("k"), F.col("slot").alias("s")))
    pool = cells.withColumn("_asked", F.struct(F.col(key).alias("k"), F.lit(0).alias("s")))
    near = knn(asked, pool, k_adjacent, [*by, slice_col], "_asked", coords)
    return own.unionByName(near.select(*by, F.col("_asked.k").alias(key), F.col("nbr.k").alias("nbr"), "dist", "pos", F.col("_asked.s").alias("slot")))


def homogeneous(neighbours: DataFrame, cells: DataFrame, k: int, cell_threshold: float = 0.0, niche_threshold: float = 0.6, key: str = "cell", cell_vec: str = "emb_cell", niche_vec: str | None = "emb_niche", per_slot: bool = False) -> DataFrame:
    """The k best neighbours by cell similarity (0 under its threshold) plus 2 where the niche similarity reaches its own.

    Without niche vectors every niche is alike.  ``per_slot``: k of each slot, in order of slots.  Weights are the cell
    similarities over their sum, 0 where that is 0."""
    vecs = [cell_vec, *([niche_vec] if niche_vec else [])]
    a = cells.select(key, *(F.col(v).alias(f"_a_{v}") for v in vecs))
    b = cells.select(F.col(key).alias("nbr"), *(F.col(v).alias(f"_b_{v}") for v in vecs))
    sim = F.expr(E.cosine(f"_a_{cell_vec}", f"_b_{cell_vec}"))
    near = neighbours.join(a, key).join(b, "nbr").withColumn("sim", sim).withColumn("sim", F.when(F.col("sim") >= cell_threshold, F.col("sim")).otherwise(0.0))
    niche = (F.expr(E.cosine(f"_a_{niche_vec}", f"_b_{niche_vec}")) >= niche_threshold).cast("double") if niche_vec else F.lit(1.0)
    near = near.withColumn("score", F.col("sim") + 2.0 * niche)
    group = [key, *(["slot"] if per_slot else [])]
    best = top_k(near, group, [F.desc("score"), "pos", "nbr"], k, "rank")
    total = F.sum("sim").over(Window.partitionBy(*group))
    return best.withColumn("weight", F.when(total > 0, F.col("sim") / total).otherwise(0.0)).select(*group, "nbr", "sim", "score", "rank", "weight")


def neighbour_qc(homog: DataFrame, key: str = "cell") -> DataFrame:
    """(key, n_valid, median_sim) over similarities over 0."""
    return homog.groupBy(key).agg(F.count_if(F.col("sim") > 0).alias("n_valid"), F.expr("percentile(CASE WHEN sim > 0 THEN sim END, 0.5D)").alias("median_sim"))


def graph_edges(neighbours: DataFrame, key: str = "cell", symmetric: bool = True) -> DataFrame:
    """(src, dst): distinct undirected pairs, in both directions if ``symmetric``, without loops."""
    one = neighbours.where(F.col(key) != F.col("nbr")).select(F.least(key, "nbr").alias("src"), F.greatest(key, "nbr").alias("dst")).distinct()
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if symmetric else one


def propagate(edges: DataFrame, x: DataFrame, hops: int = 3, key: str = "cell", feature: str = "feature", value: str = "value") -> DataFrame:
    """Hops 1 to K of x' = D^-1/2 (A + I) D^-1/2 x as (key, hop, feature, value)."""
    loops = x.select(F.col(key).alias("src")).distinct().withColumn("dst", F.col("src"))
    a = edges.select("src", "dst").unionByName(loops)
    degree = a.groupBy("dst").agg(F.count(F.lit(1)).alias("d"))
    norm = a.join(degree.select(F.col("dst").alias("src"), F.col("d").alias("_s")), "src").join(degree.select("dst", F.col("d").alias("_t")), "dst").select("src", "dst", (1 / F.sqrt(F.col("_s") * F.col("_t"))).alias("w"))
    out, now = None, x.select(F.col(key).alias("src"), feature, value)
    for hop in range(1, hops + 1):
        now = now.join(norm, "src").groupBy("dst", feature).agg(F.sum(F.col("w") * F.col(value)).alias(value)).withColumnRenamed("dst", "src")
        part = now.select(F.col("src").alias(key), F.lit(hop).alias("hop"), feature, value)
        out = part if out is None else out.unionByName(part)
    return out


def principal_components(df: DataFrame, vector: str, k: int, out: str = "pca") -> DataFrame:
    """k principal components of an array column; the deterministic stand-in for learned embeddings and for 2-D layouts."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(v).transform(v).withColumn(out, vector_to_array("_p")).drop("_v", "_p")


def category_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """Codes from 0 in order of the label; the distinct labels are numbered, not the rows."""
    codes = df.select(column).distinct().withColumn(name, F.dense_rank().over(Window.orderBy(column)) - 1)
    return df.join(codes, column)
