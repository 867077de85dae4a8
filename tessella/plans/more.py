"""Further queries: linkage windows, genes and neighbourhoods end to end, tests of groups, and files written and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import exprs as E
from tessella.functions.register import register
from tessella.operators import expression as X
from tessella.operators import ldscores as L
from tessella.operators import neighbours as K
from tessella.operators import relational as R
from tessella.operators import stats as S
from tessella.plans.adapters import view
from tessella.plans.queries import BAND, L2, VARIANTS, genotypes, l2_table, query, rounded, variants
from tessella.sources import readers, sinks


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all machines share; a temporary one only where that is unset, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="tessella-")
    return f"{at}/tessella/{name}-{uuid.uuid4().hex}"


@query(f"WITH {VARIANTS}, {BAND} SELECT t.snp AS target, v.snp AS ref FROM v t JOIN w USING (batch) JOIN v ON v.row_idx >= w.lo AND v.row_idx < w.hi")
def ld_window_pairs(spark, d):
    v = variants(spark, d)
    return L.ld_pairs(v, v, 6, "SNP", 5)


FILTERED = "SELECT snp FROM geno GROUP BY snp HAVING stddev_pop(dosage) > 0 AND least(avg(dosage) / 2, 1 - avg(dosage) / 2) >= 0.4"


@query(FILTERED)
def variant_filter(spark, d):
    return L.variant_filter(genotypes(spark, d), 0.4).select("snp")


@query(f"""WITH {VARIANTS}, g AS ({FILTERED}), l AS ({L2}) SELECT '1' AS chrom, target AS snp, round(sum(l2), 4) AS l2 FROM l
    WHERE target IN (FROM g) AND ref IN (FROM g) AND target NOT LIKE '%3' AND ref NOT LIKE '%3' GROUP BY target""")
def ld_regression_weights(spark, d):
    v = variants(spark, d)
    listed = v.where("snp NOT LIKE '%3'").select("snp")
    return rounded(L.regression_weights(genotypes(spark, d), v, listed, 0.4, 100, "SNP").select("chrom", "snp", "l2"), 4)


PER_SAMPLE = "s AS (SELECT cell % 4 AS sample, gene, var_samp(value) AS variance FROM expr GROUP BY 1, 2), h AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY variance DESC NULLS LAST, gene) <= 10 AS hv FROM s)"


@query(f"WITH {PER_SAMPLE} SELECT gene, sum(hv::INT)::BIGINT AS times, round(median(variance), 4) AS variance FROM h GROUP BY gene HAVING count(*) = 4 ORDER BY times DESC, median(variance) DESC NULLS LAST, gene LIMIT 12")
def hvg_consensus(spark, d):
    per = view(spark, d, "expr").groupBy((F.col("cell") % 4).alias("sample"), "gene").agg(F.var_samp("value").alias("variance"))
    best = F.row_number().over(Window.partitionBy("sample").orderBy(F.desc_nulls_last("variance"), "gene")) <= 10
    return rounded(X.variable_genes(per.withColumn("highly_variable", best), 4, 12), 4)


@query("""WITH v AS (SELECT spot % 10 AS g, CASE WHEN spot % 50 = 0 THEN 0.0 WHEN spot % 53 = 0 AND spot % 10 < 5 THEN 1.0 ELSE p END AS p FROM spots WHERE spot % 10 < 8)
    SELECT g, round(CASE WHEN min(p) <= 0 AND max(p) >= 1 THEN NULL WHEN min(p) <= 0 THEN 0 WHEN max(p) >= 1 THEN 1 ELSE atan2(1.0::DOUBLE, avg(tan((0.5::DOUBLE - p) * pi()))) / pi() END, 6) AS p FROM v GROUP BY g""")
def acat_strict(spark, d):
    v = view(spark, d, "spots").where("spot % 10 < 8").selectExpr("spot % 10 AS g", "CASE WHEN spot % 50 = 0 THEN 0D WHEN spot % 53 = 0 AND spot % 10 < 5 THEN 1D ELSE p END AS p")
    return rounded(v.groupBy("g").agg(S.acat("p", strict=True).alias("p")))


@query("""WITH v AS (SELECT spot % 6 AS g, CASE spot % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN p / 1e18 WHEN 3 THEN CASE WHEN spot % 7 = 0 THEN 0 ELSE p END ELSE p END AS p FROM spots),
    t AS (SELECT g, min(p) AS lo, avg(CASE WHEN p < 1e-16 THEN 1 / (nullif(p, 0) * pi()) ELSE tan((0.5::DOUBLE - p) * pi()) END) AS t FROM v GROUP BY g)
    SELECT g, round(-log10(greatest(CASE WHEN lo <= 0 THEN 0 WHEN lo >= 1 THEN 1 WHEN t > 1e15 THEN 1 / (t * pi()) ELSE atan2(1.0::DOUBLE, t) / pi() END, 1e-300)), 5) AS neg_log10_p FROM t""")
def acat_branches(spark, d):
    """All ones, all halves, p under 1e-16, a zero among others, plain ones."""
    v = view(spark, d, "spots").selectExpr("spot % 6 AS g", "CASE spot % 6 WHEN 0 THEN 1D WHEN 1 THEN 0.5D WHEN 2 THEN p / 1e18D WHEN 3 THEN CASE WHEN spot % 7 = 0 THEN 0D ELSE p END ELSE p END AS p")
    return rounded(v.groupBy("g").agg(S.acat("p").alias("p")).selectExpr("g", f"{E.neg_log10('p')} AS neg_log10_p"), 5)


@query("""WITH q AS (SELECT annotation, sample, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) AS q3 FROM spots GROUP BY 1, 2)
    SELECT annotation, sample, count(*) AS n FROM spots JOIN q USING (annotation, sample) WHERE x < m + 1.5 * (q3 - q1) GROUP BY 1, 2""")
def iqr_trim(spark, d):
    return S.iqr_trim(view(spark, d, "spots"), "x", ["annotation", "sample"], 1.5).groupBy("annotation", "sample").agg(F.count(F.lit(1)).alias("n"))


PLACES = "e AS (SELECT vec_id AS cell, label, embedding, (vec_id % 97)::DOUBLE AS x, (vec_id % 89)::DOUBLE AS y FROM embeddings)"
SIMILAR = f"""{PLACES}, r AS (SELECT a.cell, b.cell AS nbr, row_number() OVER (PARTITION BY a.cell ORDER BY sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), b.cell) AS pos, b.cell % 2 AS slot,
    greatest(0.0::DOUBLE, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS sim FROM e a JOIN e b ON a.label = b.label),
    n AS (SELECT *, sim + CASE WHEN sim >= 0.6 THEN 2 ELSE 0 END AS score FROM r WHERE pos <= 12)"""


def embedded(spark, d) -> DataFrame:
    return view(spark, d, "embeddings").select(F.col("vec_id").alias("cell"), F.col("embedding").alias("emb_cell"), F.col("embedding").alias("emb_niche"), F.col("label").cast("string").alias("annotation"), (F.col("vec_id") % 97).cast("double").alias("x"), (F.col("vec_id") % 89).cast("double").alias("y"))


def near_places(spark, d) -> DataFrame:
    e = embedded(spark, d)
    return K.knn(e, e, 12, ["annotation"]).withColumn("slot", F.expr("cast(nbr % 2 as int)"))


@query(f"""WITH {SIMILAR}, k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY score DESC, pos, nbr) AS rank FROM n), t AS (SELECT * FROM k WHERE rank <= 5)
    SELECT cell, nbr, round(sim, 5) AS sim, round(score, 5) AS score, rank::INT AS rank, round(sim / sum(sim) OVER (PARTITION BY cell), 5) AS weight FROM t""")
def homogeneous_topk(spark, d):
    return rounded(K.homogeneous(near_places(spark, d), embedded(spark, d), 5), 5)


@query(f"""WITH {SIMILAR}, k AS (SELECT *, row_number() OVER (PARTITION BY cell, slot ORDER BY score DESC, pos, nbr) AS rank FROM n)
    SELECT cell, slot::INT AS slot, nbr, rank::INT AS rank FROM k WHERE rank <= 3""")
def homogeneous_topk_per_slice(spark, d):
    return K.homogeneous(near_places(spark, d), embedded(spark, d), 3, per_slot=True).select("cell", "slot", "nbr", "rank")


@query(f"""WITH {SIMILAR}, k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY score DESC, pos, nbr) AS rank FROM n)
    SELECT cell, count(*) FILTER (WHERE sim > 0) AS n_valid, round(median(sim) FILTER (WHERE sim > 0), 5) AS median_sim FROM k WHERE rank <= 8 GROUP BY cell""")
def neighbour_qc(spark, d):
    return rounded(K.neighbour_qc(K.homogeneous(near_places(spark, d), embedded(spark, d), 8)), 5)


@query("WITH f AS (SELECT substr(gene, 1, 7) AS human, min(gene) AS gene FROM expr GROUP BY 1) SELECT cell, human AS gene, value FROM expr JOIN f USING (gene)")
def rename_homologs(spark, d):
    """Brands share the symbol of their first seven characters, of which the first by name stays."""
    e = view(spark, d, "expr")
    return readers.rename_homologs(e, e.select("gene").distinct().withColumn("human", F.substring("gene", 1, 7))).select("cell", "gene", "value")


@query("""WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE p < 0.05) AS s FROM spots), e AS (SELECT annotation, count(*) FILTER (WHERE p < 0.05) AS a, count(*) AS r1 FROM spots GROUP BY 1),
    f AS (SELECT annotation, a, r1, n - r1 AS r2, s AS c1, n FROM e, t), u AS (SELECT *, unnest(range(greatest(0, c1 - r2), least(r1, c1) + 1)) AS x FROM f),
    c AS (SELECT *, lgamma(r1 + 1) - lgamma(x + 1) - lgamma(r1 - x + 1) + lgamma(r2 + 1) - lgamma(c1 - x + 1) - lgamma(r2 - c1 + x + 1) AS l, lgamma(r1 + 1) - lgamma(a + 1) - lgamma(r1 - a + 1) + lgamma(r2 + 1) - lgamma(c1 - a + 1) - lgamma(r2 - c1 + a + 1) AS here, lgamma(n + 1) - lgamma(c1 + 1) - lgamma(n - c1 + 1) AS every FROM u)
    SELECT annotation, round(least(1, sum(exp(l - every)) FILTER (WHERE l <= here + 1e-7)), 6) AS p_fisher FROM c GROUP BY annotation""")
def enrichment_fisher(spark, d):
    return rounded(S.with_fisher(S.enrichment(view(spark, d, "spots").withColumn("sig", F.col("p") < 0.05), "annotation", "sig")).select("annotation", "p_fisher"))


RESIDUAL = "greatest(-sqrt(n), least(sqrt(n), ({v} - d * g) / sqrt(d * g + d * g * d * g / 100)))"


@query(f"""WITH dep AS (SELECT cell, sum(value) AS d FROM expr GROUP BY 1), k AS (SELECT count(*)::DOUBLE AS n, sum(d) AS total FROM dep), sh AS (SELECT gene, sum(value) / max(total) AS g, max(n) AS n FROM expr, k GROUP BY gene),
    st AS (SELECT sum(d) / count(*) AS d, count(*) AS c FROM dep GROUP BY floor(log2(d) * 32)), z AS (SELECT gene, sum({RESIDUAL.format(v="0")} * c) AS s, sum(power({RESIDUAL.format(v="0")}, 2) * c) AS q FROM sh, st GROUP BY gene),
    o AS (SELECT gene, {RESIDUAL.format(v="value")} AS r, {RESIDUAL.format(v="0")} AS z FROM expr JOIN dep USING (cell) JOIN sh USING (gene)), e AS (SELECT gene, sum(r - z) AS s, sum(r * r - z * z) AS q FROM o GROUP BY gene)
    SELECT gene, round((z.q + e.q) / n - power((z.s + e.s) / n, 2), 4) AS variance FROM z JOIN e USING (gene), k""")
def gene_variance(spark, d):
    e = view(spark, d, "expr")
    return rounded(X.gene_variance(e, e.select("cell").distinct().count()), 4)


@query("""WITH m AS (SELECT gene, sum(value) AS m FROM expr GROUP BY gene), b AS (SELECT gene, ntile(5) OVER (ORDER BY m, gene) AS bin, row_number() OVER (ORDER BY gene) <= 5 AS mine FROM m),
    c AS (SELECT gene, mine FROM b WHERE mine OR bin IN (SELECT bin FROM b WHERE mine)), n AS (SELECT count(*) FILTER (WHERE mine) AS a, greatest(1, count(*) FILTER (WHERE NOT mine)) AS o FROM c)
    SELECT cell, round(coalesce(sum(value) FILTER (WHERE mine), 0) / max(a) - coalesce(sum(value) FILTER (WHERE NOT mine), 0) / max(o), 5) AS score FROM expr JOIN c USING (gene), n GROUP BY cell""")
def module_score(spark, d):
    """With more controls asked for than the bins hold, all of them are drawn."""
    e = view(spark, d, "expr")
    return rounded(X.module_score(e, [r[0] for r in e.select("gene").distinct().orderBy("gene").limit(5).collect()], 25, bins=5), 5)


@query("WITH t AS (SELECT count(*) AS n FROM spots) SELECT annotation, greatest(1, floor(150 * count(*) / max(t.n)::DOUBLE))::BIGINT AS n FROM spots, t GROUP BY 1")
def proportional_sample_counts(spark, d):
    return R.stratified_sample(view(spark, d, "spots"), "annotation", "spot", 150, ceil=False).groupBy("annotation").agg(F.count(F.lit(1)).alias("n"))


@query("WITH l AS (SELECT CHR, arg_max(BP, POS) AS m FROM (SELECT CHR, POS, (POS * 7) % 1009 AS BP FROM sumstats) GROUP BY 1), o AS (SELECT a.CHR, coalesce(sum(b.m), 0)::BIGINT AS o FROM l a LEFT JOIN l b ON b.CHR < a.CHR GROUP BY 1) SELECT SNP AS snp, (POS * 7) % 1009 + o AS cum_pos FROM sumstats JOIN o USING (CHR)")
def manhattan_unsorted(spark, d):
    """Positions out of order: a chromosome's last row counts, not its greatest position."""
    s = view(spark, d, "sumstats").withColumn("BP", F.expr("(POS * 7) % 1009"))
    return R.cumulative_position(s, "CHR", "BP", order=["POS"]).select(F.col("SNP").alias("snp"), "cum_pos")


@query("SELECT 120::BIGINT AS n, 5::BIGINT AS strata")
def stratified_sample_trim(spark, d):
    """The quotas, rounded up, exceed n; the sample doesn't."""
    s = R.stratified_sample(view(spark, d, "spots"), "annotation", "spot", 120)
    return s.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("annotation").alias("strata"))


@query("SELECT cell, annotation, dense_rank() OVER (ORDER BY annotation) - 1 AS code FROM cells")
def category_codes(spark, d):
    return K.category_codes(view(spark, d, "cells").select("cell", "annotation"), "annotation", "code").select("cell", "annotation", F.col("code").cast("long").alias("code"))


@query("SELECT c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier")
def common_columns(spark, d):
    a = view(spark, d, "customer").selectExpr("c_custkey AS id", "c_nationkey AS nation", "c_mktsegment AS own")
    return R.common_columns([a, view(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_acctbal AS other", "s_nationkey AS nation")])


@query("SELECT cell, round(y, 4) AS a, round(z, 4) AS b, round(x, 4) AS last, c AS number FROM (SELECT cell, x, y, n_genes::DOUBLE AS z, slice::INT AS c FROM cells)")
def axis_and_number(spark, d):
    c = view(spark, d, "cells").withColumn("at", F.array("x", "y", F.col("n_genes").cast("double"))).withColumn("name", F.concat(F.lit("chr"), "slice"))
    c = c.select("cell", F.expr(E.z_last("at", "0")).alias("at"), F.expr(E.chrom_number("name")).alias("number"))
    return rounded(c.select("cell", F.col("at")[0].alias("a"), F.col("at")[1].alias("b"), F.col("at")[2].alias("last"), "number"), 4)


@query("SELECT SNP AS snp, round(BETA / SE, 4) AS z, round(N, 4) AS n FROM sumstats")
def sumstats_file(spark, d):
    """Compressed text as written by the sink, and by the reader of summary statistics."""
    at = folder(spark, "sumstats")
    sinks.write_text(view(spark, d, "sumstats").selectExpr("SNP", "A1", "A2", "round(BETA / SE, 4) AS Z", "round(N, 4) AS N"), at)
    return rounded(readers.read_sumstats(spark, at), 4)


@query("SELECT f_chrom, start, stop, feature, round(score, 3) AS score, strand FROM features")
def bed_file(spark, d):
    at = folder(spark, "bed")
    view(spark, d, "features").select(F.concat(F.lit("chr"), "f_chrom"), "start", "stop", "feature", F.round("score", 3), "strand").write.option("sep", "\t").csv(at)
    return rounded(readers.read_bed(spark, at), 3)


@query("SELECT snp, max(feature) AS feature FROM weights GROUP BY snp")
def mapping_file(spark, d):
    at = folder(spark, "mapping")
    w = view(spark, d, "weights").groupBy("snp").agg(F.max("feature").alias("Feature"))
    w.select(F.col("snp").alias("SNP"), "Feature").write.option("sep", "\t").option("header", True).csv(at)
    return readers.read_mapping(spark, at, "\t")


@query("SELECT snp, coalesce(CASE WHEN pos % 2 = 0 THEN (pos % 7)::DOUBLE END, 0.0) AS annot FROM points")
def annotation_file(spark, d):
    at = folder(spark, "annotations")
    p = view(spark, d, "points")
    sinks.write_text(p.where("pos % 2 = 0").selectExpr("chrom AS CHR", "pos AS BP", "snp AS SNP", "0.0 AS CM", "pos % 7 AS annot"), at)
    return readers.read_annotations(spark, at, p)


@query("SELECT chrom, pos, snp AS dbsnp FROM points")
def variant_names_file(spark, d):
    at = folder(spark, "names")
    view(spark, d, "points").select(F.concat(F.lit("chr"), "chrom").alias("chr"), "pos", "snp").write.option("sep", "\t").option("header", True).csv(at)
    return readers.read_variant_names(spark, at)


@query("SELECT p_brand AS gene, min('H' || (p_size % 3)) AS human FROM part GROUP BY p_brand")
def homolog_file(spark, d):
    at = folder(spark, "homologs")
    view(spark, d, "part").selectExpr("p_brand AS mouse", "concat('H', p_size % 3) AS human").distinct().write.option("sep", "\t").option("header", True).csv(at)
    return readers.read_homologs(spark, at)[0]


@query("""WITH e AS (SELECT cell, gene, value AS x, 0.5 + cell % 20 AS mu, 0.1::DOUBLE + cell % 7 AS theta, (cell % 9 - 4) / 2.0::DOUBLE AS pi FROM expr UNION ALL SELECT cell, 'none', 0, 0.5 + cell % 20, 0.1::DOUBLE + cell % 7, (cell % 9 - 4) / 2.0::DOUBLE FROM (SELECT DISTINCT cell FROM expr)),
    n AS (SELECT *, theta * (ln(theta + 1e-8) - ln(theta + mu + 1e-8)) AS z, x * (ln(mu + 1e-8) - ln(theta + mu + 1e-8)) + lgamma(x + theta) - lgamma(theta) - lgamma(x + 1) AS r, greatest(-pi, 0) + ln(1 + exp(-abs(pi))) AS d FROM e)
    SELECT cell, gene, round(z + r, 6) AS nb, round(CASE WHEN x < 1e-8 THEN greatest(z - pi, 0) + ln(1 + exp(-abs(z - pi))) - d ELSE z + r - pi - d END, 6) AS zinb FROM n""")
def count_likelihoods(spark, d):
    e = view(spark, d, "expr")
    e = e.unionByName(e.select("cell", F.lit("none").alias("gene"), F.lit(0.0).alias("value")).distinct())
    e = e.selectExpr("cell", "gene", "value AS x", "CAST(0.5 + cell % 20 AS DOUBLE) AS mu", "0.1D + cell % 7 AS theta", "(cell % 9 - 4) / 2D AS pi")
    return rounded(e.selectExpr("cell", "gene", f"{E.nb_log_likelihood('x', 'mu', 'theta')} AS nb", f"{E.zinb_log_likelihood('x', 'mu', 'theta', 'pi')} AS zinb"))


@query("""SELECT annotation, round(atan2(1.0::DOUBLE, avg(tan((0.5::DOUBLE - p) * pi()))) / pi(), 6) AS p, round(lgamma(count(*) + 0.5), 5) AS g FROM spots GROUP BY annotation""")
def registered_functions(spark, d):
    """SQL functions of the session, called by name."""
    register(spark)
    g = view(spark, d, "spots").groupBy("annotation").agg(F.collect_list("p").alias("ps"), F.count(F.lit(1)).alias("n"))
    return g.selectExpr("annotation", "round(cauchy_combination(ps), 6) AS p", "round(log_gamma(n + 0.5D), 5) AS g")
