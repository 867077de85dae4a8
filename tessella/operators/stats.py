"""Statistics over groups: Cauchy combination, trims, summaries, enrichment, correlation, jackknife regression."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import exprs as E
from tessella.operators.relational import in_memory, quantiles


def acat(p: str, w: str | None = None, strict: bool = False) -> Column:
    """Cauchy combination of p-values as an aggregate.

    A zero gives 0, all ones give 1; p under 1e-16 count as w / (p pi); a statistic over 1e15 gives 1 / (it * pi).
    ``strict``: any one gives 1, and ones together with zeros give null (an error of the caller's)."""
    weight = w or E.num(1)
    term = f"{weight} * (CASE WHEN {p} < {E.num(1e-16)} THEN {E.num(1)} / (nullif({p}, 0) * pi()) ELSE tan(({E.num(0.5)} - {p}) * pi()) END)"
    stat = f"(sum({term}) / sum(CASE WHEN {p} IS NOT NULL THEN {weight} END))"
    value = f"CASE WHEN {stat} > {E.num(1e15)} THEN {E.num(1)} / ({stat} * pi()) ELSE {E.cauchy_sf(stat)} END"
    ones = f"max({p}) >= 1" if strict else f"min({p}) >= 1"
    both = f"WHEN min({p}) <= 0 AND max({p}) >= 1 THEN NULL " if strict else ""
    return F.expr(f"CASE WHEN count({p}) = 0 THEN {E.num(1)} {both}WHEN min({p}) <= 0 THEN {E.num(0)} WHEN {ones} THEN {E.num(1)} ELSE {value} END")


def iqr_trim(df: DataFrame, value: str, by: Sequence[str], k: float = 3.0) -> DataFrame:
    """Rows with value < median + k * (q75 - q25) of their group, strictly: a constant group is emptied."""
    q = quantiles(df, value, by, (0.25, 0.5, 0.75))
    return df.join(q, list(by)).where(F.col(value) < F.col("_q")[1] + k * (F.col("_q")[2] - F.col("_q")[0])).drop("_q")


def mad_trim(df: DataFrame, value: str, by: Sequence[str], threshold: float = 3.5) -> DataFrame:
    """Rows with |0.6745 (x - median) / MAD| <= threshold; a group of MAD 0 is kept whole."""
    m = quantiles(df, value, by, (0.5,)).select(*by, F.col("_q")[0].alias("_m"))
    near = df.join(m, list(by)).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    mad = quantiles(near, "_d", by, (0.5,)).select(*by, F.col("_q")[0].alias("_mad"))
    return near.join(mad, list(by)).where((F.col("_mad") == 0) | (0.6745 * F.col("_d") / F.col("_mad") <= threshold)).drop("_m", "_d", "_mad")


def region_summary(df: DataFrame, x: str, by: Sequence[str], background: Sequence[str] = (), k: float = 3.0, alpha: float = 0.05) -> DataFrame:
    """Per region: p_cauchy, p_median, top_95_quantile, sig_spots, total_spots of x = -log10 p after the IQR trim.

    The significance bar divides alpha by the untrimmed rows of the background (all, or the same sample).  A region that
    the trim empties has 1, 1 and 0."""
    counts = df.groupBy(*background).agg(F.count(F.lit(1)).alias("_n")) if background else df.agg(F.count(F.lit(1)).alias("_n"))
    regions = quantiles(df, x, by, (0.25, 0.5, 0.75))
    regions = regions.join(counts, list(background)) if background else regions.withColumn("_n", counts.scalar())
    keep = F.col(x) < F.col("_q")[1] + k * (F.col("_q")[2] - F.col("_q")[0])
    rows = df.join(regions, list(by)).select(*by, "_n", F.when(keep, F.expr(E.from_neg_log10(x))).alias("_p"), F.when(keep, F.col(x)).alias("_x"))
    sums = [acat("_p").alias("p_cauchy"), F.count_if(F.col("_p") < F.lit(alpha) / F.col("_n")).alias("sig_spots"), F.count("_p").alias("total_spots")]
    if in_memory(df, by):
        out = rows.groupBy(*by).agg(*sums, F.expr("percentile(_p, 0.5D)").alias("p_median"), F.expr("percentile(_x, 0.95D)").alias("top_95_quantile"))
    else:
        middle = quantiles(rows, "_p", by, (0.5,)).select(*by, F.col("_q")[0].alias("p_median"))
        high = quantiles(rows, "_x", by, (0.95,)).select(*by, F.col("_q")[0].alias("top_95_quantile"))
        out = rows.groupBy(*by).agg(*sums).join(middle, list(by), "left").join(high, list(by), "left")
    return out.fillna({"p_median": 1.0, "top_95_quantile": 0.0}).select(*by, "p_cauchy", "p_median", "top_95_quantile", "sig_spots", "total_spots")


def lambda_gc(df: DataFrame, z: str, median: float = 0.4559364) -> DataFrame:
    """Genomic control factor, mean, median and greatest chi-square, and how many exceed 29."""
    c = df.select((F.col(z) * F.col(z)).alias("c"))
    middle = F.lit(quantiles(c, "c", (), (0.5,)).head()["_q"][0] if c.limit(1).count() else None).cast("double")
    return c.agg((middle / median).alias("lambda_gc"), F.avg("c").alias("mean_chi2"), middle.alias("median_chi2"), F.max("c").alias("max_chi2"), F.count_if(F.col("c") > 29).alias("n_over_29"))


def enrichment(df: DataFrame, region: str, significant: str) -> DataFrame:
    """2 x 2 table of each region against all others: counts, odds ratio (inf as 1e4), Wald interval of its logarithm."""
    total = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(significant).alias("s"))
    each = df.groupBy(region).agg(F.count_if(significant).alias("a"), F.count_if(~F.col(significant)).alias("b"))
    each = each.withColumn("c", total.select("s").scalar() - F.col("a")).withColumn("d", total.select(F.col("n") - F.col("s")).scalar() - F.col("b"))
    odds = F.expr("CASE WHEN b * c > 0 THEN a * d / cast(b * c AS double) WHEN a * d > 0 THEN 1e4D END")
    out = each.withColumn("odds_ratio", odds).withColumn("_se", F.expr("CASE WHEN a > 0 AND b > 0 AND c > 0 AND d > 0 THEN sqrt(1D / a + 1D / b + 1D / c + 1D / d) END"))
    return out.withColumn("ci_low", F.expr("exp(ln(odds_ratio) - 1.96D * _se)")).withColumn("ci_high", F.expr("exp(ln(odds_ratio) + 1.96D * _se)")).drop("_se")


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p: tables of the same margins that are no likelier than this one."""
    r1, r2, c1 = a + b, c + d, a + c
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    base = log_choose(r1 + r2, c1)
    logp = [log_choose(r1, x) + log_choose(r2, c1 - x) - base for x in range(max(0, c1 - r2), min(r1, c1) + 1)]
    here = logp[a - max(0, c1 - r2)]
    return min(1.0, math.fsum(math.exp(x) for x in logp if x <= here + 1e-7))


def with_fisher(df: DataFrame) -> DataFrame:
    """Adds ``p_fisher`` to a table of counts a, b, c, d."""
    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([fisher_exact(*map(int, x)) for x in zip(a, b, c, d, strict=True)], dtype="float64")

    return df.withColumn("p_fisher", p("a", "b", "c", "d"))


def best_annotation(df: DataFrame, annotation: str, gene: str, value: str) -> DataFrame:
    """Each gene's annotation of the greatest median, ties by name."""
    m = df.groupBy(annotation, gene).agg(F.expr(f"percentile({value}, 0.5D)").alias("median"))
    return m.groupBy(gene).agg(F.max_by(annotation, F.struct("median", F.col(annotation))).alias(annotation), F.max("median").alias("median"))


def correlation(df: DataFrame, by: Sequence[str], x: str, y: str, eps: float = 1e-12) -> DataFrame:
    """Pearson's r in each group, centred: sum(dx dy) / (|dx| |dy| + eps)."""
    return df.groupBy(*by).agg((F.covar_pop(x, y) * F.count(F.lit(1)) / (F.sqrt(F.var_pop(x) * F.count(F.lit(1))) * F.sqrt(F.var_pop(y) * F.count(F.lit(1))) + eps)).alias("pcc"))


def jackknife_sums(df: DataFrame, by: Sequence[str], block: str, xs: Sequence[str], y: str, w: str) -> DataFrame:
    """X'WX (upper triangle) and X'Wy of each group and block; rows are scaled by the weight w on both sides."""
    k = len(xs)
    sums = [F.sum(F.col(xs[i]) * F.col(xs[j]) * F.col(w) * F.col(w)).alias(f"xx_{i}_{j}") for i in range(k) for j in range(i, k)]
    return df.groupBy(*by, block).agg(*sums, *(F.sum(F.col(xs[i]) * F.col(y) * F.col(w) * F.col(w)).alias(f"xy_{i}") for i in range(k)))


def jackknife_wls(df: DataFrame, by: Sequence[str], block: str, xs: Sequence[str], y: str, w: str, scale: float = 1.0) -> DataFrame:
    """Weighted least squares with a delete-one-block jackknife, for the first column's coefficient of each group.

    Block sums are built by aggregation; only they, a few numbers a block, reach the solver.  A singular group has nulls.
    Returns by, beta, se, z, p (one-sided), neg_log10_p; beta and se are divided by ``scale``."""
    return jackknife_solved(jackknife_sums(df, by, block, xs, y, w), by, block, len(xs), scale)


def jackknife_solved(sums: DataFrame, by: Sequence[str], block: str, k: int, scale: float = 1.0) -> DataFrame:
    """The estimate of :func:`jackknife_wls` from the block sums of :func:`jackknife_sums` over k columns."""
    import numpy as np

    tri = [(i, j) for i in range(k) for j in range(i, k)]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(block)
        b = len(pdf)
        xx = np.empty((b, k, k))
        for i, j in tri:
            xx[:, i, j] = xx[:, j, i] = pdf[f"xx_{i}_{j}"]
        xy = np.stack([pdf[f"xy_{i}"] for i in range(k)], 1)
        beta = se = float("nan")
        if b > 1:
            try:
                full = np.linalg.solve(xx.sum(0), xy.sum(0))
                less = np.linalg.solve(xx.sum(0) - xx, (xy.sum(0) - xy)[:, :, None])[:, :, 0]
                pseudo = b * full - (b - 1) * less
                beta, se = pseudo.mean(0)[0] / scale, math.sqrt(pseudo.var(0, ddof=1)[0] / b) / scale
            except np.linalg.LinAlgError:
                pass
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "beta": [beta], "se": [se]})

    schema = ", ".join(f"`{c}` {dict(sums.dtypes)[c]}" for c in by) + ", beta double, se double"
    out = sums.groupBy(*by).applyInPandas(solve, schema)
    out = out.select(*by, *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("beta", "se")))
    return out.withColumn("z", F.expr("beta / nullif(se, 0)")).withColumn("p", F.expr(E.norm_sf("z"))).withColumn("neg_log10_p", F.expr(E.neg_log10("p")))


def detect_z_axis(df: DataFrame, sample: str, axes: Sequence[str]) -> DataFrame:
    """(axis, mean_var): the axis of the least mean variance within samples of more than one row."""
    per = df.groupBy(sample).agg(F.count(F.lit(1)).alias("n"), *(F.var_pop(a).alias(a) for a in axes)).where("n > 1")
    means = per.agg(*(F.avg(a).alias(a) for a in axes))
    best = F.array_min(F.array(*(F.struct(F.col(a).alias("mean_var"), F.lit(i).alias("i"), F.lit(a).alias("axis")) for i, a in enumerate(axes))))
    return means.select(best.alias("b")).select("b.axis", "b.mean_var")


def colour_limits(df: DataFrame, by: Sequence[str], value: str, top: int = 20) -> DataFrame:
    """q99.9, q99.5 of the finite values and the median of the ``top`` greatest."""
    finite = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    q = finite.groupBy(*by).agg(F.expr(f"percentile({value}, 0.999D)").alias("q999"), F.expr(f"percentile({value}, 0.995D)").alias("q995"))
    w = Window.partitionBy(*by).orderBy(F.col(value).desc())
    head = finite.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).groupBy(*by).agg(F.expr(f"percentile({value}, 0.5D)").alias("median_top"))
    return q.join(head, list(by))


def pivot_traits(df: DataFrame, annotation: str, trait: str, p: str, traits: Sequence[str]) -> DataFrame:
    """-log10 p by annotation and trait, a column each."""
    return df.groupBy(annotation).pivot(trait, list(traits)).agg(F.first(F.expr(E.neg_log10(p))))


def zscore(df: DataFrame, value: str, by: Sequence[str], name: str = "zscore") -> DataFrame:
    """(x - mean) / sd of the group, 0 where it doesn't vary."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(stats, list(by)).withColumn(name, F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")


def best_gene(df: DataFrame, snp: str, gene: str, weight: str, floor: float = 1.0) -> DataFrame:
    """Each SNP's gene of the greatest weight, ties by name; 'None' where that is not over the floor."""
    out = df.groupBy(snp).agg(F.max_by(gene, F.struct(F.col(weight), F.col(gene))).alias(gene), F.max(weight).alias(weight))
    return out.withColumn(gene, F.when(F.col(weight) > floor, F.col(gene)).otherwise("None"))


def smallest_or_under(df: DataFrame, p: str, key: str, bar: float, n: int) -> DataFrame:
    """Rows of p under the bar if there are more than n of them, else the n smallest."""
    under = df.where(F.col(p) < bar)
    return under if under.count() > n else df.orderBy(p, key).limit(n)
