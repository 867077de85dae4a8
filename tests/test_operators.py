"""Invariants and branches of the operators on small tables."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import exprs as E
from tessella.operators import expression, ldscores, neighbours, relational, stats, sumstats


def one(spark, sql):
    return spark.sql(f"SELECT {sql} AS v").head()[0]


@pytest.mark.parametrize("z", [-6.0, -1.0, 0.0, 0.3, 2.0, 5.0, 12.0, 35.0])
def test_normal_upper_tail(spark, z):
    assert one(spark, E.norm_sf(E.num(z))) == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-11)


@pytest.mark.parametrize("p", [1e-200, 1e-30, 1e-5, 0.02, 0.3, 0.5, 0.7, 0.999])
def test_normal_quantile(spark, p):
    assert one(spark, E.norm_isf(E.num(p))) == pytest.approx(-NormalDist().inv_cdf(p), rel=1e-9, abs=1e-12)
    assert one(spark, E.norm_isf(E.num(0))) is None


@pytest.mark.parametrize(
    "values,want",
    [([0.2] * 5, 0.2), ([0.5, 0.0], 0.0), ([1.0, 1.0], 1.0), ([1e-20, 0.5], 2e-20), ([], 1.0), ([None, 0.3], 0.3), ([1e-3, 0.4, 0.9], None)],
)
def test_cauchy_combination(spark, values, want):
    got = spark.createDataFrame([(v,) for v in values], "p double").agg(stats.acat("p")).head()[0]
    if want is None:
        t = np.mean(np.tan((0.5 - np.array(values)) * math.pi))
        want = 0.5 - math.atan(t) / math.pi
    assert got == pytest.approx(want, rel=1e-9)


def test_cauchy_combination_with_weights(spark):
    df = spark.createDataFrame([(0.01, 1.0), (0.5, 3.0)], "p double, w double")
    t = (math.tan(0.49 * math.pi) + 3 * math.tan(0.0)) / 4
    assert df.agg(stats.acat("p", "w")).head()[0] == pytest.approx(math.atan2(1, t) / math.pi)
    assert df.agg(stats.acat("CASE WHEN p > 0.1 THEN 1D ELSE p END", strict=True)).head()[0] == 1.0


def test_trims(spark):
    df = spark.createDataFrame([("constant", 1.0)] * 5 + [("outlier", float(i)) for i in (1, 2, 3, 4, 100)] + [("single", 7.0)], "g string, x double")
    count = lambda d: {r[0]: r[1] for r in d.groupBy("g").count().collect()}
    assert count(stats.iqr_trim(df, "x", ["g"])) == {"outlier": 4}
    assert count(stats.mad_trim(df, "x", ["g"])) == {"constant": 5, "outlier": 4, "single": 1}
    summary = {r["g"]: r for r in stats.region_summary(df, "x", ["g"]).collect()}
    assert (summary["constant"]["p_cauchy"], summary["constant"]["p_median"], summary["constant"]["top_95_quantile"], summary["constant"]["total_spots"]) == (1.0, 1.0, 0.0, 0)


def test_fisher():
    assert stats.fisher_exact(8, 2, 1, 5) == pytest.approx(0.034965, abs=1e-6)
    assert stats.fisher_exact(0, 5, 5, 0) == pytest.approx(2 / math.comb(10, 5))


def test_each_quality_rule(spark):
    rows = [("ok", "A", "C", 1.0, 0.5, 0.1, 0.3, 1000.0, 0.95), ("ok", "A", "C", 9.0, 0.5, 0.1, 0.3, 1000.0, 0.95), ("info", "A", "C", 1.0, 0.5, 0.1, 0.3, 1000.0, 0.5), ("noinfo", "A", "C", 1.0, 0.5, 0.1, 0.3, 1000.0, None), ("maf", "A", "C", 1.0, 0.5, 0.1, 0.01, 1000.0, 0.95), ("p0", "A", "C", 1.0, 0.5, 0.0, 0.3, 1000.0, 0.95), ("p1", "A", "C", 1.0, -0.5, 1.0, 0.3, 1000.0, 0.95), ("strand", "A", "T", 1.0, 0.5, 0.1, 0.3, 1000.0, 0.95), ("null", "A", "C", 1.0, None, 0.1, 0.3, 1000.0, 0.95), ("few", "A", "C", 1.0, 0.5, 0.1, 0.3, 10.0, 0.95)]
    df = spark.createDataFrame(rows, "rsid string, a1 string, a2 string, ord double, beta double, pval double, eaf double, n double, info double")
    out = {r["SNP"]: r for r in sumstats.clean(df, order=["ord"]).collect()}
    assert set(out) == {"ok", "p1"} and out["ok"]["ord"] == 1.0
    assert out["ok"]["Z"] == pytest.approx(1.6448536, abs=1e-6) and out["p1"]["Z"] == pytest.approx(0.0, abs=1e-9)
    with pytest.raises(ValueError):
        sumstats.rename(spark.createDataFrame([(1, 2)], "SNP int, rsid int"))
    with pytest.raises(ValueError):
        sumstats.with_z(spark.createDataFrame([(0.5,)], "P double"))
    with pytest.raises(ValueError):
        sumstats.check_cojo(df)


def test_overlap_bounds_and_bins(spark):
    points = spark.createDataFrame([("a", "1", 9), ("b", "1", 10), ("c", "1", 19), ("d", "1", 20), ("e", "2", 15)], "snp string, chrom string, pos long")
    features = spark.createDataFrame([("1", 10, 20, "f", 1.0, "+"), ("1", 12, 20, "g", 1.0, "-")], "f_chrom string, start long, stop long, feature string, score double, strand string")
    want = {("b", "f"), ("c", "f"), ("c", "g")}
    for size in (1, 3, 10, 1000):
        assert {tuple(r) for r in relational.overlap_join(points, features, 0, size).select("snp", "feature").collect()} == want
    best = {r["snp"]: r["feature"] for r in relational.map_features(points, features, "score", 0, 7).collect()}
    assert best == {"a": "Unmapped", "b": "f", "c": "f", "d": "Unmapped", "e": "Unmapped"}
    assert {r["snp"]: r["feature"] for r in relational.map_features(points, features, "tss", 0, 7).collect()}["c"] == "g"
    with pytest.raises(ValueError):
        relational.map_features(points, features, "nearest")


def test_sparse_ranks_equal_dense_ones(spark):
    rng = np.random.default_rng(0)
    x = rng.poisson(0.8, (30, 12)).astype(float)
    x[0] = rng.permutation(12) + 1
    rows = [(c, f"g{g}", float(x[c, g])) for c in range(30) for g in range(12) if x[c, g]]
    ranks = expression.log_ranks(spark.createDataFrame(rows, "cell long, gene string, value double"), 12)

    def average(v):
        return np.array([(v < y).sum() + ((v == y).sum() + 1) / 2 for y in v])

    dense = np.log(np.array([average(v) for v in x]))
    assert all(r["lr"] == pytest.approx(dense[r["cell"], int(r["gene"][1:])]) for r in ranks.collect())
    stats_ = {r["gene"]: r for r in expression.gene_stats(ranks, 30).collect()}
    assert all(stats_[f"g{g}"]["g_mean"] == pytest.approx(dense[:, g].mean()) and stats_[f"g{g}"]["frac"] == pytest.approx((x[:, g] > 0).mean()) for g in range(12))


def test_jackknife_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(400, 3)), np.ones((400, 1))], 1)
    y, w = x @ [0.5, 1, -1, 2] + rng.normal(size=400), rng.uniform(0.5, 2, 400)
    rows = [("c", i // 20, *map(float, x[i]), float(y[i]), float(w[i])) for i in range(400)]
    df = spark.createDataFrame(rows, "cell string, block int, a double, b double, c double, d double, y double, w double")
    got = stats.jackknife_wls(df, ["cell"], "block", ["a", "b", "c", "d"], "y", "w", 2.0).head()
    xw, yw = x * w[:, None], y * w
    full = np.linalg.lstsq(xw, yw, rcond=None)[0]
    less = [np.linalg.lstsq(np.delete(xw, range(20 * b, 20 * b + 20), 0), np.delete(yw, range(20 * b, 20 * b + 20)), rcond=None)[0] for b in range(20)]
    pseudo = 20 * full - 19 * np.array(less)
    assert got["beta"] == pytest.approx(pseudo.mean(0)[0] / 2)
    assert got["se"] == pytest.approx(math.sqrt(pseudo.var(0, ddof=1)[0] / 20) / 2)
    scaled = stats.jackknife_wls(df.withColumn("w", F.col("w") * 7), ["cell"], "block", ["a", "b", "c", "d"], "y", "w", 2.0).head()
    assert scaled["beta"] == pytest.approx(got["beta"])
    singular = stats.jackknife_wls(df.withColumn("b", F.col("a")), ["cell"], "block", ["a", "b", "d"], "y", "w").head()
    assert singular["beta"] is None or math.isfinite(singular["beta"])


@pytest.mark.parametrize(("kind", "names"), [("string", ["A", "B"]), ("bigint", [5, 7]), ("tinyint", [1, 2]), ("date", [dt.date(2024, 1, 1), dt.date(2024, 1, 2)])])
def test_rank_sum_keeps_the_groups_type(spark, kind, names):
    groups = spark.createDataFrame([(i, names[i % 2]) for i in range(8)], f"cell long, group {kind}")
    expr = spark.createDataFrame([(i, "g", float(1 + i + 10 * (i % 2))) for i in range(8)], "cell long, gene string, value double")
    got = expression.rank_sum(expr, groups, 8)
    assert dict(got.dtypes)["group"] == kind
    z = {r["group"]: r["z"] for r in got.collect()}
    assert z[names[1]] == pytest.approx(8 / math.sqrt(12)) and z[names[0]] == pytest.approx(-8 / math.sqrt(12))


def test_rank_sum_of_more_cells_than_a_cube_holds(spark):
    n, some = 9_000_000, 40
    groups = spark.range(n).select(F.col("id").alias("cell"), (F.col("id") % 3).alias("group"))
    expr = groups.where(F.col("cell") < some).select("cell", F.lit("g").alias("gene"), (F.col("cell") % 4 + 1).cast("double").alias("value"))
    expr = expr.unionByName(groups.where(F.col("group") == 1).select("cell", F.lit("h").alias("gene"), F.lit(2.0).alias("value")))
    got = {(r["gene"], r["group"]): r["z"] for r in expression.rank_sum(expr, groups, n).collect()}
    m, k = n // 3, n // 3  # gene h: all of group 1, and no other cell, hold one value
    tt = (k**3 - k) + ((n - k) ** 3 - (n - k))
    sd = math.sqrt(m * (n - m) / 12 * ((n + 1) - tt / (n * (n - 1))))
    assert got["h", 1] == pytest.approx((m * (n - k + (k + 1) / 2) - m * (n + 1) / 2) / sd)
    assert got["h", 0] == pytest.approx((m * (n - k + 1) / 2 - m * (n + 1) / 2) / sd)
    assert len(got) == 6 and all(math.isfinite(z) for z in got.values())


def test_nearest_neighbours_with_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"s{i % 3}", float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 12, (150, 2)))] + [(200, "tiny", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "cell long, annotation string, x double, y double")
    got = {(r["cell"], r["pos"]): r["nbr"] for r in neighbours.knn(df, df, 6, ["annotation"]).collect()}
    for i, a, x, y in rows:
        order = sorted((math.hypot(x - u, y - v), j) for j, b, u, v in rows if a == b)[:6]
        assert [got[i, k + 1] for k in range(len(order))] == [j for _, j in order]
    assert (200, 2) not in got


def shapes(name):
    rng = np.random.default_rng(7)
    if name == "strip":
        return [rng.normal(size=(400, 2)) * [1, 1000]] * 2
    if name == "skewed":
        return [np.exp(rng.normal(size=(400, 2)) * 8)] * 2
    if name == "outliers":
        return [np.r_[rng.random((400, 2)), [[1e9, 0.0], [1e9, 3.0]]]] * 2
    if name == "copies":
        return [np.where(rng.random((400, 1)) < 0.8, 0.0, rng.random((400, 2)))] * 2
    if name == "lattice":
        return [rng.integers(0, 9, (300, 2)).astype(float), rng.integers(0, 9, (400, 2)).astype(float)]
    if name == "apart":
        return [rng.random((100, 2)) + 100, rng.random((400, 2))]
    return [rng.random((300, 3))] * 2


@pytest.mark.parametrize("name", ["strip", "skewed", "outliers", "copies", "lattice", "apart", "space"])
def test_nearest_neighbours_across_leaves(spark, name):
    asked, pool = shapes(name)
    coords = ["x", "y", "z"][: pool.shape[1]]
    frame = lambda at: spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(at)], "cell long, " + ", ".join(f"{c} double" for c in coords))
    got = {}
    for r in neighbours.knn(frame(asked), frame(pool), 5, coords=coords, per_leaf=8).orderBy("cell", "pos").collect():
        got.setdefault(r["cell"], []).append(r["nbr"])
    for i, x in enumerate(asked):
        dist = sum(((x[j] - pool[:, j]) ** 2 for j in range(len(coords))), np.zeros(len(pool)))
        assert got[i] == np.lexsort((np.arange(len(pool)), np.sqrt(dist)))[:5].tolist()


@pytest.mark.parametrize("name", ["strip", "skewed", "outliers"])
def test_leaves_stay_small_whatever_the_shape(spark, name):
    at = shapes(name)[1]
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(at)], "nbr long, x double, y double")
    tagged, boxes = neighbours._leaves(df, [], ["x", "y"], 16)
    sizes = [r["count"] for r in tagged(df).groupBy("_leaf").count().collect()]
    assert sum(sizes) == len(at) and max(sizes) <= 48 and len(boxes[0][0]) == len(sizes)


def test_rows_without_a_place_have_no_neighbours(spark):
    df = spark.createDataFrame([(1, "t", 0.0, 0.0), (2, "t", 1.0, None), (3, "t", 2.0, 0.0), (4, "t", float("nan"), 0.0), (5, None, 0.0, 0.0)], "cell long, annotation string, x double, y double")
    got = neighbours.knn(df, df, 3, ["annotation"]).collect()
    assert sorted((r["cell"], r["nbr"], r["pos"]) for r in got) == [(1, 1, 1), (1, 3, 2), (3, 1, 2), (3, 3, 1)]


def test_missing_slices_are_made_up_for(spark):
    rows = [(s * 10 + i, s, "t", float(i), 0.0) for s in range(3) for i in range(4)]
    df = spark.createDataFrame(rows, "cell long, slice int, annotation string, x double, y double")
    got = neighbours.cross_slice_knn(df, 2, 2, 1).collect()
    slices = {}
    for r in got:
        slices.setdefault((r["cell"] // 10, r["slot"]), set()).add(r["nbr"] // 10)
    assert slices == {(0, 0): {0}, (0, 1): {1}, (0, 2): {2}, (1, 0): {1}, (1, 1): {2}, (1, 2): {0}, (2, 0): {2}, (2, 1): {1}, (2, 2): {0}}


def test_row_index_and_blocks(spark):
    df = spark.range(0, 103).select((F.col("id") % 10).alias("k"), "id").repartition(7)
    got = relational.row_index(df, "k", ["id"]).orderBy("row_idx").collect()
    assert [(r["k"], r["id"]) for r in got] == sorted((i % 10, i) for i in range(103))
    assert [r["row_idx"] for r in got] == list(range(103))
    blocks = relational.assign_blocks(relational.row_index(df, "k", ["id"]), 10).groupBy("block").count().collect()
    assert {r["count"] for r in blocks} == {10} and len(blocks) == 10
    assert relational.row_index(df.limit(0), "k").count() == 0


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.04, 0.5]
    got = sorted((r["p"], round(r["q"], 6)) for r in relational.bh_fdr(spark.createDataFrame([("g", x) for x in p], "g string, p double"), "p", ["g"]).collect())
    assert got == [(0.01, 0.05), (0.03, 0.05), (0.04, 0.05), (0.04, 0.05), (0.5, 0.5)]


def test_ld_of_genotypes(spark):
    rng = np.random.default_rng(4)
    g = rng.integers(0, 3, (6, 40)).astype(float)
    g[1] = g[0]
    g[2] = 1.0
    x = g.tolist()
    x[3][0] = None
    geno = spark.createDataFrame([(f"v{i}", v) for i, v in enumerate(x)], "snp string, dosages array<double>")
    kept = {r["snp"] for r in ldscores.variant_filter(geno).collect()}
    assert "v2" not in kept and {"v0", "v1", "v3"} <= kept
    v = spark.createDataFrame([(f"v{i}", "1", 1000 * i, 0.0, i) for i in range(6)], "snp string, chrom string, pos long, cm double, row_idx long")
    pairs = ldscores.ld_pairs(v, v, 1.0, "CM", 2)
    assert pairs.count() == 36  # all within a megabase
    assert ldscores.ld_pairs(v, v, 1.0, "KB", 1).count() == 6 + 2 * 5
    assert ldscores.ld_pairs(v, v, 1.0, "SNP", 1).count() == 6 + 5
    l2 = {(r[0], r[1]): r[2] for r in ldscores.ld_r2(geno.where("snp <> 'v2'"), pairs).collect()}
    assert l2["v0", "v1"] == pytest.approx(1.0)
    r = np.corrcoef(g[4], g[5])[0, 1]
    assert l2["v4", "v5"] == pytest.approx(r * r - (1 - r * r) / 38)
    listed = ldscores.regression_weights(geno, v, v.select("snp"))
    assert {c for c in listed.columns} == {"chrom", "snp", "pos", "cm", "l2"}


def test_propagation_keeps_constants_on_regular_graphs(spark):
    n = 8
    edges = spark.createDataFrame([(i, (i + d) % n) for i in range(n) for d in (1, n - 1)], "src long, dst long")
    x = spark.createDataFrame([(i, "f", 2.0) for i in range(n)], "cell long, feature string, value double")
    assert {round(r["value"], 9) for r in neighbours.propagate(edges, x, 3).collect()} == {2.0}


def test_regression_of_cells_equals_plain_numpy(spark, monkeypatch):
    """Block by block against weighted least squares over all SNPs, with an extra annotation and a gene without weights."""
    from tessella.operators import ldscores

    monkeypatch.setattr(ldscores, "ENTRIES", 300)  # several passes
    monkeypatch.setattr(ldscores, "CHUNK", 40)
    monkeypatch.setattr(ldscores, "CELLS", 2)
    rng = np.random.default_rng(7)
    n, genes, cells, b = 203, 9, 5, 10
    w = rng.exponential(size=(n, genes)) * (rng.random((n, genes)) < 0.3)
    un = rng.exponential(size=n)
    score = rng.exponential(size=(cells, genes + 1)) * (rng.random((cells, genes + 1)) < 0.7)
    z, size, l2, extra = rng.normal(size=n) * 1.4, rng.uniform(2e4, 6e4, n), 0.5 + rng.exponential(size=n), rng.random(n)
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    weights = frame([(f"s{i:03}", f"g{j}", float(w[i, j])) for i in range(n) for j in range(genes) if w[i, j]] + [(f"s{i:03}", "Unmapped", float(un[i])) for i in range(n)], "snp string, feature string, w double")
    scores = frame([(c, f"g{j}", float(score[c, j])) for c in range(cells) for j in range(genes + 1) if score[c, j]], "cell long, gene string, score double")
    table = frame([(f"s{i:03}", float(z[i]), float(size[i]), i) for i in range(n)], "snp string, z double, n double, row_idx long")
    got = {r["cell"]: r for r in ldscores.spatial_ldsc(weights, scores, table, frame([(f"s{i:03}", float(l2[i])) for i in range(n)], "snp string, l2 double"), b, frame([(f"s{i:03}", float(extra[i])) for i in range(n)], "snp string, e double")).collect()}
    m = n // b * b
    n_bar = size.mean()
    base, every, y = (un + w.sum(1))[:m], w.sum(1)[:m], (z * z)[:m]
    block = np.arange(m) // (m // b)
    for c in range(cells):
        ld = (w @ score[c, :genes])[:m]
        hsq = min(1.0, max(0.0, 10000 * (y.mean() - 1) / ((ld + base) * size[:m]).mean()))
        wt = np.sqrt(1 / (2 * (1 + hsq * size[:m] / 10000 * np.maximum(ld + base, 1)) ** 2 * np.maximum(l2[:m], 1)))
        x = np.stack([ld, *(v * size[:m] / n_bar for v in (base, every, extra[:m])), np.ones(m)], 1) * wt[:, None]
        yw = y * wt
        full = np.linalg.solve(x.T @ x, x.T @ yw)
        pseudo = []
        for k in range(b):
            on = block != k
            pseudo.append(b * full - (b - 1) * np.linalg.solve(x[on].T @ x[on], x[on].T @ yw[on]))
        pseudo = np.array(pseudo)[:, 0]
        assert got[c]["beta"] == pytest.approx(pseudo.mean() / n_bar, rel=1e-6)
        assert got[c]["se"] == pytest.approx(np.sqrt(pseudo.var(ddof=1) / b) / n_bar, rel=1e-6)
    assert ldscores.spatial_ldsc(weights.limit(0), scores, table.limit(0), weights.limit(0).selectExpr("snp", "w AS l2"), b).count() == 0


@pytest.mark.parametrize("narrow", [20_000, 10])
def test_quantiles_of_groups_beyond_memory(spark, monkeypatch, narrow):
    """The bracketed form equals the built-in one, with ties, nulls, groups of one row and of equal values."""
    from tessella.operators import relational

    rng = np.random.default_rng(4)
    rows = [(int(g), None if rng.random() < 0.02 else float(np.round(rng.normal(), 2 if g else 6))) for g, n in enumerate((4000, 3000, 7, 1, 2, 30)) for _ in range(n)] + [(9, 5.0)] * 300 + [(10, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    ps = (0.0, 0.05, 0.25, 0.5, 0.95, 1.0)
    want = {r["g"]: r["_q"] for r in relational.quantiles(df, "v", ["g"], ps).collect()}
    every = relational.quantiles(df, "v", (), ps).head()["_q"]
    monkeypatch.setattr(relational, "IN_MEMORY", 0)
    monkeypatch.setattr(relational, "NARROW", narrow)
    if narrow < 100:
        df = df.where("g in (0, 1, 9)")
        want = {g: q for g, q in want.items() if g in (0, 1, 9)}
        every = None
    got = {r["g"]: r["_q"] for r in relational.quantiles(df, "v", ["g"], ps).collect()}
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], abs=1e-12)
    if every:
        assert relational.quantiles(df, "v", (), ps).head()["_q"] == pytest.approx(every, abs=1e-12)
    spots = df.selectExpr("g", "abs(v) as x").where("x is not null")
    large = sorted(map(tuple, stats.region_summary(spots, "x", ["g"]).collect()))
    monkeypatch.setattr(relational, "IN_MEMORY", 1 << 40)
    small = sorted(map(tuple, stats.region_summary(spots, "x", ["g"]).collect()))
    assert [x[0] for x in large] == [x[0] for x in small] and np.allclose([x[1:] for x in large], [x[1:] for x in small])


def test_blocks_of_variants_give_the_pairs_correlations(spark, monkeypatch):
    monkeypatch.setattr(ldscores, "BLOCK", 4)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (30, 40)).astype(float)
    x[rng.random(x.shape) < 0.05] = np.nan
    x[7] = 1.0
    geno = spark.createDataFrame([(f"v{i:02}", "1" if i < 18 else "2", i if i < 18 else i - 18, [None if np.isnan(v) else float(v) for v in x[i]]) for i in range(30)], "snp string, chrom string, row_idx long, dosages array<double>")
    pairs = [(f"v{i:02}", f"v{j:02}") for i in range(30) for j in range(30) if abs(i - j) < 6 and (i < 18) == (j < 18)]
    asked = spark.createDataFrame(pairs, "target string, ref string")
    got = {(r[0], r[1]): r[2] for r in ldscores.ld_r2(geno, asked).collect()}
    want = {(r[0], r[1]): r[2] for r in ldscores.ld_r2(geno.drop("chrom", "row_idx"), asked).collect()}
    assert got.keys() == want.keys() == set(pairs)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
