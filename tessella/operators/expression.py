"""Cells x genes in long form (cell, gene, value): filters, log-ranks, gene statistics, variable genes, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.relational import bh_fdr, quantiles


def filter_cells(cells: DataFrame, annotation: str = "annotation", min_cells: int = 1, min_genes: int = 20, n_genes: str = "n_genes") -> DataFrame:
    """Cells with an annotation, in groups of at least ``min_cells`` annotated cells, with at least ``min_genes`` genes."""
    named = cells.where(F.col(annotation).isNotNull())
    large = named.groupBy(annotation).count().where(F.col("count") >= min_cells).select(annotation)
    return named.join(large, annotation, "left_semi").where(F.col(n_genes) >= min_genes)


def filter_stats(cells: DataFrame, annotation: str = "annotation", min_cells: int = 1, min_genes: int = 20, n_genes: str = "n_genes") -> DataFrame:
    """One row: cells at the start and after each step of :func:`filter_cells`, in one pass over groups."""
    per = cells.groupBy(annotation).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(n_genes) >= min_genes).alias("g"))
    ok = F.col(annotation).isNotNull()
    return per.agg(F.sum("n").alias("n_start"), F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("n_annotated"), F.sum(F.when(ok & (F.col("n") >= min_cells), F.col("n")).otherwise(0)).alias("n_large_group"), F.sum(F.when(ok & (F.col("n") >= min_cells), F.col("g")).otherwise(0)).alias("n_kept"))


def genes_per_cell(expr: DataFrame) -> DataFrame:
    return expr.groupBy("cell").agg(F.count_if(F.col("value") != 0).alias("n_genes"))


def drop_genes(expr: DataFrame, pattern: str = "^(HB.-|MT-)") -> DataFrame:
    return expr.where(~F.col("gene").rlike(f"(?i){pattern}"))


def looks_like_counts(expr: DataFrame, n: int = 100) -> bool:
    """Whether the first n values are whole numbers."""
    row = expr.select("value").limit(n).agg(F.bool_and(F.col("value") == F.rint("value"))).head()
    return bool(row[0])


def log_ranks(expr: DataFrame, n_genes: int) -> DataFrame:
    """ln of each non-zero value's average rank among all ``n_genes`` values of its cell, zeros ranked lowest.

    Only non-zero values are ranked: z zeros share rank (z + 1) / 2, and a non-zero value's rank is z plus its average
    rank among the non-zeros.  Columns: cell, gene, lr, zero_lr (the zeros' value in this cell; the row's least)."""
    some = expr.where("value > 0")
    tied = some.groupBy("cell", "value").agg(F.count(F.lit(1)).alias("_ties"))
    w = Window.partitionBy("cell").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = tied.withColumn("_to", F.sum("_ties").over(w)).withColumn("_all", F.sum("_ties").over(Window.partitionBy("cell")))
    zeros = F.lit(n_genes) - F.col("_all")
    ranked = ranked.select("cell", "value", F.log(zeros + F.col("_to") - (F.col("_ties") - 1) / 2).alias("lr"), F.when(zeros > 0, F.log((zeros + 1) / 2)).alias("zero_lr"))
    return some.join(ranked, ["cell", "value"]).select("cell", "gene", "lr", "zero_lr")


def gene_stats(ranks: DataFrame, n_cells: int | None = None) -> DataFrame:
    """(gene, g_mean, frac): mean log-rank over all cells, zeros included, and the share of cells that express it."""
    cells = ranks.groupBy("cell").agg(F.max("zero_lr").alias("z")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("z"), F.lit(0.0)).alias("z")).head()
    n = n_cells or max(1, cells["n"])
    per = ranks.groupBy("gene").agg(F.sum("lr").alias("s"), F.coalesce(F.sum("zero_lr"), F.lit(0.0)).alias("z"), F.count(F.lit(1)).alias("k"))
    return per.select("gene", ((F.col("s") + F.lit(float(cells["z"])) - F.col("z")) / n).alias("g_mean"), (F.col("k") / n).alias("frac"))


def gss(neighbours: DataFrame, ranks: DataFrame, stats: DataFrame, expression_filter: bool = True) -> DataFrame:
    """Gene specificity of each cell from its weighted neighbours (cell, nbr, weight).

    s = exp(sum w lr / sum w - g_mean) over all neighbours, zeros with their cell's value; s < 1 counts as 0, and so does a
    gene that no larger share of neighbours expresses than of all cells; the score is exp(s^1.5) - 1.  Zero scores are left out."""
    lowest = ranks.groupBy("cell").agg(F.max("zero_lr").alias("zl"), F.min("lr").alias("low")).select(F.col("cell").alias("nbr"), "zl", "low")
    near = neighbours.join(lowest, "nbr")
    total = near.groupBy("cell").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.coalesce("zl", F.lit(0.0))).alias("wz"), F.count(F.lit(1)).alias("k"))
    rows = near.join(ranks.select(F.col("cell").alias("nbr"), "gene", "lr"), "nbr")
    # in a cell without zeros the lowest gene counts as not expressed
    expressed = F.col("zl").isNotNull() | (F.col("lr") > F.col("low"))
    sums = rows.groupBy("cell", "gene").agg(F.sum(F.col("weight") * (F.col("lr") - F.coalesce("zl", F.lit(0.0)))).alias("x"), F.count_if(expressed).alias("e"))
    s = F.exp((F.col("x") + F.col("wz")) / F.col("w") - F.col("g_mean"))
    out = sums.join(total, "cell").join(stats, "gene").where("w > 0").withColumn("s", s).where("s >= 1")
    if expression_filter:
        out = out.where(F.col("e") / F.col("k") > F.col("frac"))
    return out.select("cell", "gene", (F.exp(F.pow("s", F.lit(1.5))) - 1).alias("score"))


def gss_hierarchical(neighbours: DataFrame, ranks: DataFrame, stats: DataFrame, slot: str = "slot") -> DataFrame:
    """Scores within each slice of neighbours, then their mean over the cell's slices of positive weight; none gives no row."""
    parts = neighbours.withColumn("cell", F.struct(F.col("cell").alias("c"), F.col(slot).alias("s")))
    scores = gss(parts, ranks, stats)
    slots = neighbours.groupBy("cell", slot).agg(F.sum("weight").alias("w")).where("w > 0").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return scores.groupBy(F.col("cell.c").alias("cell"), "gene").agg(F.sum("score").alias("t")).join(slots, "cell").select("cell", "gene", (F.col("t") / F.col("n")).alias("score"))


def normalise(expr: DataFrame, target: float = 1e4) -> DataFrame:
    """log1p(value * target / the cell's total)."""
    depth = expr.groupBy("cell").agg(F.sum("value").alias("_d"))
    return expr.join(depth, "cell").withColumn("value", F.when(F.col("_d") > 0, F.log1p(F.col("value") * target / F.col("_d"))).otherwise(0.0)).drop("_d")


def gene_variance(counts: DataFrame, n_cells: int, theta: float = 100.0) -> DataFrame:
    """(gene, variance) of clipped analytic Pearson residuals of counts, from non-zero values.

    A zero's residual depends on the cell's total alone, so zeros enter by sums over cells of equal totals."""
    depth = counts.groupBy("cell").agg(F.sum("value").alias("d"))
    total = depth.agg(F.sum("d")).head()[0] or 1.0
    clip = float(n_cells) ** 0.5
    share = counts.groupBy("gene").agg((F.sum("value") / total).alias("g"))
    mu = F.col("d") * F.col("g")
    residual = lambda v: F.greatest(F.lit(-clip), F.least(F.lit(clip), (v - mu) / F.sqrt(mu + mu * mu / theta)))
    depths = depth.groupBy("d").count()
    # totals fold into at most 512 logarithmic steps for the zeros' part, each with its mean: a bounded broadcast
    steps = depths.groupBy(F.floor(F.log2("d") * 32).alias("_s")).agg((F.sum(F.col("d") * F.col("count")) / F.sum("count")).alias("d"), F.sum("count").alias("count")).drop("_s")
    zero = share.withColumn("_k", F.lit(1)).join(F.broadcast(steps.withColumn("_k", F.lit(1))), "_k")
    every = zero.withColumn("r", residual(F.lit(0.0))).groupBy("gene").agg(F.sum(F.col("r") * F.col("count")).alias("s"), F.sum(F.col("r") * F.col("r") * F.col("count")).alias("q"))
    some = counts.join(depth, "cell").join(share, "gene").withColumn("r", residual(F.col("value"))).withColumn("z", residual(F.lit(0.0)))
    delta = some.groupBy("gene").agg(F.sum(F.col("r") - F.col("z")).alias("ds"), F.sum(F.col("r") * F.col("r") - F.col("z") * F.col("z")).alias("dq"))
    s, q = F.col("s") + F.col("ds"), F.col("q") + F.col("dq")
    return every.join(delta, "gene").select("gene", (q / n_cells - (s / n_cells) * (s / n_cells)).alias("variance"))


def gene_dispersion(logged: DataFrame, n_cells: int) -> DataFrame:
    """(gene, mean, dispersion) of normalised values: variance over mean, ddof 1, zeros included."""
    s = logged.groupBy("gene").agg(F.sum(F.expm1("value")).alias("s"), F.sum(F.pow(F.expm1("value"), F.lit(2.0))).alias("q"))
    mean = F.col("s") / n_cells
    return s.select("gene", mean.alias("mean"), ((F.col("q") - F.col("s") * mean) / (n_cells - 1) / mean).alias("dispersion"))


def variable_genes(ranked: DataFrame, n_samples: int, n_top: int) -> DataFrame:
    """From (sample, gene, variance, highly_variable): genes of every sample, by how often they vary highly, then by median variance."""
    per = ranked.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile(variance, 0.5D)").alias("variance"), F.sum(F.col("highly_variable").cast("int")).alias("times"))
    return per.where(F.col("n") == n_samples).orderBy(F.desc_nulls_last("times"), F.desc_nulls_last("variance"), "gene").limit(n_top).select("gene", "times", "variance")


def rank_sum(expr: DataFrame, groups: DataFrame, n_genes_cells: int, top: int = 100) -> DataFrame:
    """Wilcoxon rank-sum of each group against the rest, by gene, with tie correction; zeros are values of equal rank.

    expr: (cell, gene, value > 0), groups: (cell, group).  Returns group, gene, z, p, padj, lfc, the ``top`` of each group by z; padj adjusts over all genes of the group."""
    from tessella.functions import exprs as E

    n, kind = float(n_genes_cells), dict(groups.dtypes)["group"]
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("m")).where("group IS NOT NULL").collect()  # a row a group
    labels, members = ([r[i] for r in sizes] for i in range(2))
    # equal values of a gene in a group cost one row; a range frame ends with the last of the equal values of all groups
    some = expr.where("value > 0").join(groups, "cell").groupBy("gene", "value", "group").agg(F.count(F.lit(1)).cast("double").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("gene").orderBy("value").rangeBetween(Window.unboundedPreceding, 0))
    tied = some.withColumn("to", upto).withColumn("t", F.sum("c").over(Window.partitionBy("gene", "value"))).withColumn("k", F.sum("c").over(Window.partitionBy("gene")))
    c, t = F.col("c"), F.col("t")
    sums = F.struct(F.sum(c * (n - F.col("k") + F.col("to") - (t - 1) / 2)).alias("r"), F.sum(c).alias("e"), F.sum(c * F.expm1("value")).alias("s"), F.sum(c * (t * t - 1)).alias("tt"), F.first("k").alias("k"))
    per = tied.groupBy("gene", "group").agg(sums.alias("x"))
    ties = per.groupBy("gene").agg(F.first("x.k").alias("k"), F.sum("x.tt").alias("tt"), F.sum("x.s").alias("all"), F.map_from_entries(F.collect_list(F.when(F.col("group").isNotNull(), F.struct("group", "x")))).alias("per"))
    zeros = n - F.col("k")
    every = F.arrays_zip(F.array(*map(F.lit, labels)).cast(f"array<{kind}>").alias("group"), F.array(*(F.lit(float(m)) for m in members)).cast("array<double>").alias("m"))
    x = ties.withColumn("tt", F.col("tt") + zeros * zeros * zeros - zeros).withColumn("of", F.explode(every)).withColumn("x", F.col("per")[F.col("of.group")])
    x = x.select("of.group", "gene", "of.m", "k", "tt", "all", *(F.coalesce(f"x.{name}", F.lit(0.0)).alias(name) for name in ("r", "e", "s")))
    m = F.col("m")
    rank = F.col("r") + (m - F.col("e")) * (zeros + 1) / 2
    sd = F.sqrt(m * (n - m) / 12.0 * ((n + 1) - F.col("tt") / (n * (n - 1))))
    x = x.withColumn("z", (rank - m * (n + 1) / 2) / sd).withColumn("p", F.expr(E.two_sided_p("z")))
    x = x.withColumn("lfc", F.log2((F.col("s") / m + 1e-9) / ((F.col("all") - F.col("s")) / (n - m) + 1e-9)))
    best = Window.partitionBy("group").orderBy(F.desc("z"), "gene")
    x = bh_fdr(x, "p", ["group"]).withColumnRenamed("q", "padj")
    return x.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= top).select("group", "gene", "z", "p", "padj", "lfc")


def significant_genes(ranked: DataFrame, alpha: float = 0.05, lfc: float = 0.25) -> DataFrame:
    """Rows of :func:`rank_sum` with padj < alpha and |lfc| > lfc."""
    return ranked.where((F.col("padj") < alpha) & (F.abs("lfc") > lfc))


def high_quality(expr: DataFrame, groups: DataFrame, n_genes: int, k: float = 1.0) -> DataFrame:
    """(cell, high_quality): whether a cell's module score for its own group's significant genes reaches the group's threshold.

    expr: normalised (cell, gene, value), groups: (cell, group).  A group without significant genes has scores 0 and keeps all."""
    chosen = significant_genes(rank_sum(expr, groups, groups.count()))
    sets: dict = {}
    for r in chosen.select("group", "gene").collect():  # a hundred genes a group at most
        sets.setdefault(r["group"], []).append(r["gene"])
    scores = groups.join(expr.select("cell").limit(0), "cell").select("cell", "group", F.lit(0.0).alias("score"))
    for g, genes in sorted(sets.items()):
        own = groups.where(F.col("group") == F.lit(g))
        scores = scores.unionByName(own.join(module_score(expr, genes, n_genes), "cell").select("cell", "group", "score"))
    every = groups.join(scores, ["cell", "group"], "left").fillna(0.0, ["score"])
    return every.join(F.broadcast(quality_threshold(every, "group", k=k)), "group").select("cell", (F.col("score") >= F.col("threshold")).alias("high_quality"))




def module_score(expr: DataFrame, genes: Sequence[str], n_genes: int, bins: int = 25, controls: int = 50, seed: int = 0) -> DataFrame:
    """(cell, score): mean of the set's genes less the mean of control genes drawn from the same bins of mean expression."""
    means = expr.groupBy("gene").agg(F.sum("value").alias("m"))
    binned = means.withColumn("bin", F.ntile(bins).over(Window.orderBy("m", "gene")))
    chosen = binned.where(F.col("gene").isin(list(genes)))
    pool = binned.where(~F.col("gene").isin(list(genes))).join(chosen.select("bin").distinct(), "bin", "left_semi")
    w = Window.partitionBy("bin").orderBy(F.xxhash64("gene", F.lit(seed)))
    control = pool.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= controls).select("gene", F.lit(True).alias("c"))
    kinds = chosen.select("gene", F.lit(False).alias("c")).unionByName(control)
    n = {r["c"]: r["n"] for r in kinds.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = lambda c: F.sum(F.when(F.col("c") == c, F.col("value")).otherwise(0.0)) / max(1, n.get(c, 0))
    return expr.join(F.broadcast(kinds), "gene").groupBy("cell").agg((part(False) - part(True)).alias("score"))


def quality_threshold(scores: DataFrame, label: str, score: str = "score", k: float = 1.0) -> DataFrame:
    """(label, threshold): max(0, median - k * IQR) of each label's scores."""
    q = quantiles(scores, score, [label], (0.25, 0.5, 0.75), "q")
    return q.select(label, F.greatest(F.lit(0.0), F.col("q")[1] - k * (F.col("q")[2] - F.col("q")[0])).alias("threshold"))
