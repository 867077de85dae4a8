"""Linkage disequilibrium: genotype quality, windows, weights of features, cell scores and the regression per cell."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import exprs as E
from tessella.operators.relational import assign_blocks, band_batches, band_join, row_index
from tessella.operators.stats import jackknife_solved


def variant_stats(geno: DataFrame) -> DataFrame:
    """Adds n_seen, mean, std (ddof 0) and maf of dosage arrays, missing ones left out."""
    seen = "filter(dosages, x -> x IS NOT NULL AND NOT isnan(x))"
    out = geno.withColumn("_s", F.expr(seen)).withColumn("n_seen", F.size("_s"))
    out = out.withColumn("mean", F.expr("aggregate(_s, 0D, (s, x) -> s + x) / nullif(n_seen, 0)"))
    out = out.withColumn("std", F.expr("sqrt(aggregate(_s, 0D, (s, x) -> s + (x - mean) * (x - mean)) / nullif(n_seen, 0))"))
    return out.withColumn("maf", F.expr("least(mean / 2, 1 - mean / 2)")).drop("_s")


def variant_filter(geno: DataFrame, maf_min: float = 0.01, keep: DataFrame | None = None, snp: str = "snp") -> DataFrame:
    """Variants that vary, were seen, have maf >= maf_min, and are in ``keep`` if it is given."""
    out = variant_stats(geno).where((F.col("n_seen") > 0) & (F.col("std") > 0) & (F.col("maf") >= maf_min))
    return out if keep is None else out.join(keep.select(snp).distinct(), snp, "left_semi")


def coordinate(variants: DataFrame, unit: str = "CM", pos: str = "pos", cm: str = "cm", index: str = "row_idx") -> tuple[DataFrame, float]:
    """Adds the coordinate ``at`` in the unit SNP, KB or CM, and the factor of a window; centimorgans that are all 0 fall back
    to megabases."""
    if unit == "SNP":
        return variants.withColumn("at", F.col(index).cast("double")), 1.0
    if unit == "KB":
        return variants.withColumn("at", F.col(pos).cast("double")), 1000.0
    if unit != "CM":
        raise ValueError("unit must be SNP, KB or CM")
    if variants.where(F.col(cm) != 0).limit(1).count():
        return variants.withColumn("at", F.col(cm).cast("double")), 1.0
    return variants.withColumn("at", F.col(pos).cast("double")), 1e6


def ld_pairs(targets: DataFrame, variants: DataFrame, wind: float = 1.0, unit: str = "CM", batch: int = 50, bin_size: float | None = None) -> DataFrame:
    """(target, ref): each target with all variants within its batch's window; with ``batch`` 1 the window is its own.

    targets, variants: snp, chrom, pos, cm, row_idx (order within the chromosome for targets)."""
    t, factor = coordinate(targets, unit)
    v, _ = coordinate(variants, unit)
    bands = band_batches(t, batch, wind * factor, pos="at")
    near = band_join(t, v.select("chrom", "at", F.col("snp").alias("ref")), bands, bin_size or 2 * wind * factor, pos="at")
    if unit == "SNP":
        near = near.where("at < hi")
    named = t.withColumn("batch", F.expr(f"cast(row_idx div {batch} as int)")).select("chrom", "batch", F.col("snp").alias("target"))
    return named.join(near.select("chrom", "batch", "ref"), ["chrom", "batch"]).select("target", "ref")


BLOCK = 128  # variants whose dosages travel together


def ld_r2(geno: DataFrame, pairs: DataFrame) -> DataFrame:
    """(target, ref, l2): unbiased squared correlation of standardised dosages.

    With chrom and row_idx, blocks of consecutive variants meet, once for each two blocks that share a pair, and a matrix
    product gives all correlations of the two; without them each pair brings its own dosages."""
    std = geno.select("snp", *(c for c in ("chrom", "row_idx") if c in geno.columns), F.expr(E.standardised("dosages")).alias("g"))
    if not {"chrom", "row_idx"} <= set(geno.columns):
        both = pairs.join(std.select(F.col("snp").alias("target"), F.col("g").alias("_a")), "target").join(std.select(F.col("snp").alias("ref"), F.col("g").alias("_b")), "ref")
        r = F.expr("aggregate(zip_with(_a, _b, (x, y) -> x * y), 0D, (s, x) -> s + x) / size(_a)")
        return both.withColumn("_r", r).select("target", "ref", F.expr(E.unbiased_r2("_r", "size(_a)")).alias("l2"))
    std = std.withColumn("_k", F.concat_ws(":", "chrom", F.expr(f"cast(row_idx div {BLOCK} as long)"))).withColumn("_i", F.expr(f"cast(row_idx % {BLOCK} as int)"))
    packs = std.groupBy("_k").agg(F.collect_list(F.struct("_i", "g")).alias("m"))
    place = lambda side: std.select(F.col("snp").alias(side), F.col("_k").alias(f"_k_{side}"), F.col("_i").alias(f"_i_{side}"))
    met = pairs.join(place("target"), "target").join(place("ref"), "ref")
    asked = met.groupBy("_k_target", "_k_ref").agg(F.collect_list(F.struct("target", "ref", "_i_target", "_i_ref")).alias("asked"))  # BLOCK squared at most
    side = lambda s: packs.select(F.col("_k").alias(f"_k_{s}"), F.col("m").alias(f"m_{s}"))
    rows = asked.join(side("target"), "_k_target").join(side("ref"), "_k_ref").select("asked", "m_target", "m_ref")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                wanted = batch.column(0)[row].values
                matrices = []
                for c in (1, 2):
                    x = batch.column(c)[row].values
                    g = x.field(1)
                    m = np.zeros((BLOCK, len(g[0])))
                    m[x.field(0).to_numpy(zero_copy_only=False)] = g.flatten().to_numpy(zero_copy_only=False).reshape(len(g), -1)
                    matrices.append(m)
                n = matrices[0].shape[1]
                r = matrices[0] @ matrices[1].T / n
                r = r[wanted.field(2).to_numpy(zero_copy_only=False), wanted.field(3).to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([wanted.field(0), wanted.field(1), pa.array(r * r - (1 - r * r) / (n - 2))], names=["target", "ref", "l2"])

    return rows.mapInArrow(run, "target string, ref string, l2 double")


def ld_weights(l2: DataFrame, mapping: DataFrame) -> DataFrame:
    """(snp, feature, w): sum of l2 times the reference variants' feature weights."""
    return l2.join(mapping.select(F.col("snp").alias("ref"), "feature", "weight"), "ref").groupBy(F.col("target").alias("snp"), "feature").agg(F.sum(F.col("l2") * F.col("weight")).alias("w"))


def ld_scores(l2: DataFrame) -> DataFrame:
    return l2.groupBy(F.col("target").alias("snp")).agg(F.sum("l2").alias("l2"))


def regression_weights(geno: DataFrame, variants: DataFrame, hapmap: DataFrame, maf_min: float = 0.01, wind: float = 1.0, unit: str = "CM") -> DataFrame:
    """(chrom, snp, pos, cm, l2): LD scores of the listed variants against one another."""
    good = variant_filter(geno, maf_min, hapmap)
    v = variants.join(good.select("snp"), "snp", "left_semi")
    scores = ld_scores(ld_r2(good, ld_pairs(v, v, wind, unit)))
    return v.join(scores, "snp").select("chrom", "snp", "pos", "cm", "l2")


def baseline(weights: DataFrame, unmapped: str = "Unmapped") -> DataFrame:
    """(snp, all_gene, base): sums over genes, and with the unmapped bin."""
    return weights.groupBy("snp").agg(F.sum(F.when(F.col("feature") != unmapped, F.col("w")).otherwise(0.0)).alias("all_gene"), F.sum("w").alias("base"))


def cell_ld_scores(weights: DataFrame, scores: DataFrame) -> DataFrame:
    """(snp, cell, ld): sum over common genes of weight times specificity."""
    return weights.join(scores.select("cell", F.col("gene").alias("feature"), "score"), "feature").groupBy("snp", "cell").agg(F.sum(F.col("w") * F.col("score")).alias("ld"))


#: (cells x genes scores, gene of each weight, weight, first weight of each SNP) to cells x SNPs
Products = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
ENTRIES = 2_000_000  # weights and variants that one pass over the cells takes along, about 50 MB
CELLS = 128  # cells in one product
CHUNK = 20_000  # weights in one product


def spatial_ldsc(weights: DataFrame, scores: DataFrame, sumstats: DataFrame, w_ld: DataFrame, n_blocks: int = 200, extra: DataFrame | None = None, order: Sequence[str] = ("snp",), position: str = "row_idx", products: Products | None = None) -> DataFrame:
    """LD score regression of each cell: cell, beta, se, z, p, neg_log10_p.

    sumstats: snp, z, n and a numeric ``position`` that orders SNPs for the jackknife's blocks; w_ld: snp, l2.

    No row is made for a cell and a SNP: a cell's sums over a block are matrix products of its scores with the block's
    weights.  Blocks go along in passes of at most ENTRIES weights and variants (or one block); each pass reads the
    cells' score vectors once (``products`` may replace the function that makes a block's LD scores).  The heritability guess is linear in the cell's LD scores, so a sum for each gene gives it."""
    rows = sumstats.join(baseline(weights), "snp").join(w_ld.select("snp", F.col("l2").alias("w_ld")), "snp")
    names = [] if extra is None else [c for c in extra.columns if c != "snp"]
    if extra is not None:
        rows = rows.join(extra, "snp")
    n_bar = rows.agg(F.avg("n")).head()[0] or 1.0
    rows = assign_blocks(row_index(rows.drop("row_idx") if position != "row_idx" else rows.withColumnRenamed("row_idx", "_order"), "_order" if position == "row_idx" else position, list(order)), n_blocks)
    rows = rows.select("snp", "block", "row_idx", (F.col("z") * F.col("z")).alias("chisq"), F.col("n").cast("double").alias("n"), "base", "all_gene", "w_ld", *(F.col(c).cast("double").alias(c) for c in names)).persist()
    mapped = weights.where("feature <> 'Unmapped'").join(rows.select("snp", "block", "row_idx", "n"), "snp").persist()

    by_gene = mapped.groupBy("feature").agg(F.sum(F.col("w") * F.col("n")).alias("_v"))
    genes = sorted(by_gene.toLocalIterator(), key=lambda r: r["feature"])  # a row for each gene
    listed = scores.sparkSession.createDataFrame([(r["feature"], i, r["_v"]) for i, r in enumerate(genes)], "gene string, g int, _v double")
    means = rows.agg(F.avg("chisq").alias("c"), F.avg(F.col("base") * F.col("n")).alias("b"), F.count(F.lit(1)).alias("m")).head()
    held = scores.select("cell", "gene", "score").join(F.broadcast(listed), "gene", "left")
    known = F.col("g").isNotNull()
    cells = held.groupBy("cell").agg(F.coalesce(F.sum(F.col("score") * F.col("_v")), F.lit(0.0)).alias("_s"), F.collect_list(F.when(known, F.struct(F.col("g").cast("int").alias("g"), F.col("score").cast("double").alias("s")))).alias("held"))
    hsq = 10000 * (F.lit(means["c"] or 0.0) - 1) / (F.col("_s") / (means["m"] or 1) + F.lit(means["b"] or 0.0))
    cells = cells.select("cell", F.greatest(F.lit(0.0), F.least(F.lit(1.0), hsq)).alias("hsq"), F.transform("held", lambda x: x["g"]).alias("g"), F.transform("held", lambda x: x["s"]).alias("s"))

    sizes = {r["block"]: r["count"] for r in rows.groupBy("block").count().collect()}
    for r in mapped.groupBy("block").count().collect():
        sizes[r["block"]] += r["count"]
    passes: list[list[int]] = []
    for b in sorted(sizes):
        if passes and sum(sizes[x] for x in passes[-1]) + sizes[b] <= ENTRIES:
            passes[-1].append(b)
        else:
            passes.append([b])
    k = 3 + len(names) + 1
    tri = [(i, j) for i in range(k) for j in range(i, k)]
    schema = f"cell {dict(scores.dtypes)['cell']}, block int, " + ", ".join([*(f"xx_{i}_{j} double" for i, j in tri), *(f"xy_{i} double" for i in range(k))])
    cells = cells.persist()
    parts = [_block_sums(cells, _carried(rows, mapped, [r["feature"] for r in genes], bs, ["base", "all_gene", *names], n_bar), len(genes), schema, products or cell_products) for bs in passes]
    if not parts:
        parts = [cells.sparkSession.createDataFrame([], schema)]
    return jackknife_solved(reduce(DataFrame.unionByName, parts), ["cell"], "block", k, n_bar)


def _carried(rows: DataFrame, mapped: DataFrame, genes: list[str], blocks: list[int], fixed: list[str], n_bar: float) -> list[tuple]:
    """(block, n, base, w_ld, chisq, fixed columns, gene, weight, first weight) arrays of each block of a pass, SNPs in order."""
    lo, hi = blocks[0], blocks[-1]
    snps = rows.where(F.col("block").between(lo, hi)).toPandas().sort_values("row_idx")
    w = mapped.where(F.col("block").between(lo, hi)).select("block", "row_idx", "feature", "w").toPandas().sort_values("row_idx", kind="stable")
    w["g"] = np.searchsorted(genes, w["feature"].to_numpy()) if len(w) else np.zeros(0, int)
    out = []
    for b in blocks:
        s, e = snps[snps["block"] == b], w[w["block"] == b]
        first = np.searchsorted(e["row_idx"].to_numpy(), np.append(s["row_idx"].to_numpy(), s["row_idx"].max() + 1))
        f = np.stack([*(s[c].to_numpy() * s["n"].to_numpy() / n_bar for c in fixed), np.ones(len(s))], 1)
        out.append((b, s["n"].to_numpy(), s["base"].to_numpy(), np.maximum(s["w_ld"].to_numpy(), 1.0), s["chisq"].to_numpy(), f, e["g"].to_numpy(), e["w"].to_numpy(), first))
    return out


def cell_products(score: np.ndarray, gene: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """LD scores (cells x SNPs): for each SNP the weights of its genes times the cells' scores."""
    out = np.zeros((len(score), len(first) - 1))
    lo = 0
    while lo < len(first) - 1:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + CHUNK, side="right")) - 1)
        a, b = first[lo], first[hi]
        if b > a:
            some = np.flatnonzero(np.diff(first[lo : hi + 1]))
            out[:, lo + some] = np.add.reduceat(score[:, gene[a:b]] * weight[a:b], first[lo + some] - a, axis=1)
        lo = hi
    return out


def _block_sums(cells: DataFrame, carried: list[tuple], n_genes: int, schema: str, products: Products) -> DataFrame:
    """X'WX and X'Wy of each cell and block of a pass; the columns are the cell's LD score and the fixed ones."""
    shared = cells.sparkSession.sparkContext.broadcast(carried)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CELLS):
                part = batch.slice(at, CELLS)
                m = part.num_rows
                g, s = (part.column(i) for i in (2, 3))
                score = np.zeros((m, n_genes))
                owner = np.repeat(np.arange(m), np.array([len(x) for x in g], int))
                np.add.at(score, (owner, g.flatten().to_numpy(zero_copy_only=False).astype(int)), s.flatten().to_numpy(zero_copy_only=False))
                hsq = part.column(1).to_numpy(zero_copy_only=False)[:, None]
                for b, n, base, w_ld, y, f, gene, weight, first in shared.value:
                    ld = products(score, gene, weight, first)
                    w = 1 / (2 * (1 + hsq * n / 10000 * np.maximum(ld + base, 1.0)) ** 2 * w_ld)
                    wl, q = w * ld, f.shape[1]
                    xx = {(0, 0): (wl * ld).sum(1)} | {(0, j + 1): c for j, c in enumerate((wl @ f).T)}
                    xx |= {(i + 1, j + 1): w @ (f[:, i] * f[:, j]) for i in range(q) for j in range(i, q)}
                    xy = [wl @ y, *(w @ (f * y[:, None])).T]
                    cols = [xx[i, j] for i in range(q + 1) for j in range(i, q + 1)] + xy
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(m, b, np.int32)), *map(pa.array, cols)], names=names)

    return cells.select("cell", "hsq", "g", "s").mapInArrow(run, schema)
