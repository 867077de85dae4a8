"""One query for each operator over the whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import exprs as E
from tessella.operators import expression as X
from tessella.operators import ldscores as L
from tessella.operators import neighbours as K
from tessella.operators import relational as R
from tessella.operators import stats as S
from tessella.operators import sumstats as Q
from tessella.plans.adapters import sql, view, with_views
from tessella.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = with_views(oracle)
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def acat_sql(p: str) -> str:
    t = f"avg(tan((0.5::DOUBLE - {p}) * pi()))"
    return f"CASE WHEN count({p}) = 0 THEN 1.0::DOUBLE ELSE atan2(1.0::DOUBLE, {t}) / pi() END"


def cauchy_sql(by: str, background: str) -> str:
    on = " AND ".join(f"s.{c} = q.{c}" for c in by.split(", "))
    n = "(SELECT count(*) FROM spots)" if not background else f"(SELECT count(*) FROM spots b WHERE b.{background} = t.{background})"
    return f"""WITH q AS (SELECT {by}, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) AS q3 FROM spots GROUP BY {by}),
        t AS (SELECT {", ".join("s." + c for c in by.split(", "))}, s.x, power(10.0::DOUBLE, -s.x) AS p FROM spots s JOIN q ON {on} WHERE s.x < q.m + 3 * (q.q3 - q.q1))
        SELECT {by}, round({acat_sql("p")}, 6) AS p_cauchy, round(quantile_cont(p, 0.5), 6) AS p_median, round(quantile_cont(x, 0.95), 6) AS top_95_quantile,
        count(*) FILTER (WHERE p < 0.05::DOUBLE / {n}) AS sig_spots, count(*) AS total_spots FROM t GROUP BY {by}"""


@query(cauchy_sql("annotation", ""))
def cauchy_by_annotation(spark, d):
    return rounded(S.region_summary(view(spark, d, "spots"), "x", ["annotation"])).orderBy("p_median", "annotation")


@query(cauchy_sql("annotation, sample", "sample"))
def cauchy_by_sample(spark, d):
    return rounded(S.region_summary(view(spark, d, "spots"), "x", ["annotation", "sample"], ["sample"])).orderBy("sample", "p_median", "annotation")


@query("""WITH m AS (SELECT annotation, median(value) AS m FROM spots GROUP BY 1), e AS (SELECT s.*, m.m, abs(s.value - m.m) AS dev FROM spots s JOIN m USING (annotation)),
    g AS (SELECT annotation, median(dev) AS mad FROM e GROUP BY 1)
    SELECT annotation, count(*) AS n, round(sum(value), 4) AS total FROM e JOIN g USING (annotation) WHERE mad = 0 OR 0.6745 * dev / mad <= 3.5 GROUP BY 1""")
def mad_trim(spark, d):
    return S.mad_trim(view(spark, d, "spots"), "value", ["annotation"]).groupBy("annotation").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE p < 0.05) AS s FROM spots), e AS (SELECT annotation, count(*) FILTER (WHERE p < 0.05) AS a, count(*) FILTER (WHERE NOT p < 0.05) AS b FROM spots GROUP BY 1),
    f AS (SELECT e.*, t.s - a AS c, t.n - t.s - b AS d FROM e, t)
    SELECT annotation, a, b, c, d, round(a * d / (b * c)::DOUBLE, 6) AS odds_ratio, round(exp(ln(a * d / (b * c)::DOUBLE) - 1.96 * sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d)), 6) AS ci_low,
    round(exp(ln(a * d / (b * c)::DOUBLE) + 1.96 * sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d)), 6) AS ci_high FROM f""")
def enrichment_2x2(spark, d):
    return rounded(S.enrichment(view(spark, d, "spots").withColumn("sig", F.col("p") < 0.05), "annotation", "sig"))


GOOD = "INFO >= 0.9 AND FRQ BETWEEN 0 AND 1 AND least(FRQ, 1 - FRQ) > 0.01 AND P > 0 AND P <= 1 AND upper(A1) || upper(A2) IN ('AC','AG','CA','CT','GA','GT','TC','TG')"


@query(f"""WITH k AS (SELECT * FROM sumstats WHERE {GOOD}), n AS (SELECT quantile_cont(N, 0.9) / 1.5 AS bar FROM k)
    SELECT SNP AS snp, round(sqrt({E.chi2_1_isf("P")}) * CASE WHEN BETA < 0 THEN -1 ELSE 1 END, 6) AS z FROM k, n WHERE N >= bar""")
def sumstats_qc(spark, d):
    out = Q.clean(view(spark, d, "sumstats"), order=["POS"])
    return out.select(F.col("SNP").alias("snp"), F.round("Z", 6).alias("z"))


@query("SELECT SNP AS snp FROM sumstats WHERE upper(A1) || upper(A2) IN ('AC','AG','CA','CT','GA','GT','TC','TG')")
def sumstats_allele_filter(spark, d):
    return Q.allele_filter(view(spark, d, "sumstats")).select(F.col("SNP").alias("snp"))


@query("SELECT SNP AS snp, N AS n FROM sumstats WHERE N >= (SELECT quantile_cont(N, 0.9) / 1.5 FROM sumstats)")
def n_quantile_filter(spark, d):
    return Q.n_filter(view(spark, d, "sumstats")).select(F.col("SNP").alias("snp"), F.col("N").alias("n"))


@query("SELECT SNP AS snp FROM sumstats WHERE (INFO + FRQ) >= 0.9 * 2")
def info_filter_columns(spark, d):
    return Q.info_filter(view(spark, d, "sumstats"), ["INFO", "FRQ"]).select(F.col("SNP").alias("snp"))


@query("SELECT SNP AS snp FROM sumstats WHERE FRQ BETWEEN 0 AND 1 AND least(FRQ, 1 - FRQ) > 0.01")
def maf_filter(spark, d):
    return Q.maf_filter(view(spark, d, "sumstats")).select(F.col("SNP").alias("snp"))


@query("SELECT SNP AS snp FROM sumstats WHERE P > 0 AND P <= 1")
def p_filter(spark, d):
    return Q.p_filter(view(spark, d, "sumstats")).select(F.col("SNP").alias("snp"))


@query("""SELECT l_orderkey, min(l_linenumber)::BIGINT AS l_linenumber, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS l_partkey FROM lineitem GROUP BY 1""")
def dedup_first(spark, d):
    df = view(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey", "l_extendedprice")
    return R.dedup_first(df, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey")


Z = "(BETA / SE)"


@query(f"SELECT round(median({Z} * {Z}) / 0.4559364, 6) AS lambda_gc, round(avg({Z} * {Z}), 6) AS mean_chi2, round(median({Z} * {Z}), 6) AS median_chi2, round(max({Z} * {Z}), 6) AS max_chi2, count(*) FILTER (WHERE {Z} * {Z} > 29) AS n_over_29 FROM sumstats")
def lambda_gc(spark, d):
    return rounded(S.lambda_gc(Q.with_z(view(spark, d, "sumstats").drop("P")), "Z"))


@query(f"SELECT SNP AS snp, round({Z}, 6) AS z FROM sumstats WHERE {Z} * {Z} < 9")
def chisq_cap(spark, d):
    return Q.chisq_cap(Q.with_z(view(spark, d, "sumstats").drop("P")), most=9).select(F.col("SNP").alias("snp"), F.round("Z", 6).alias("z"))


@query(f"SELECT SNP AS snp, round({Z}, 6) AS z FROM sumstats WHERE {Z} * {Z} < (SELECT greatest(0.001 * max(N), 80) FROM sumstats)")
def chisq_cap_by_n(spark, d):
    return Q.chisq_cap(Q.with_z(view(spark, d, "sumstats").drop("P"))).select(F.col("SNP").alias("snp"), F.round("Z", 6).alias("z"))


@query(f"SELECT SNP AS snp, round({Z}, 6) AS z, round({E.norm_sf(Z)}, 8) AS p_upper, round({E.two_sided_p(Z)}, 8) AS p_two, round({E.neg_log10(E.two_sided_p(Z))}, 6) AS neg_log10_p FROM sumstats")
def normal_tails(spark, d):
    z = Q.with_z(view(spark, d, "sumstats").drop("P"))
    return z.select(F.col("SNP").alias("snp"), F.round("Z", 6).alias("z"), F.round(F.expr(E.norm_sf("Z")), 8).alias("p_upper"), F.round(F.expr(E.two_sided_p("Z")), 8).alias("p_two"), F.round(F.expr(E.neg_log10(E.two_sided_p("Z"))), 6).alias("neg_log10_p"))


@query("SELECT SNP AS snp, CASE WHEN SE > 0 THEN round(ln(SE), 6) END AS beta FROM sumstats")
def log_odds(spark, d):
    df = view(spark, d, "sumstats").select("SNP", F.col("SE").alias("OR"), F.col("SE").alias("SE_OR"))
    return Q.log_odds(df).select(F.col("SNP").alias("snp"), F.round("BETA", 6).alias("beta"))


@query("""WITH k AS (SELECT CAST(CHR AS STRING) || '_' || POS AS id, SNP || 'x' AS dbsnp FROM sumstats) SELECT SNP AS old, k.dbsnp AS snp FROM sumstats s JOIN k ON k.id = CAST(s.CHR AS STRING) || '_' || s.POS""")
def variant_to_rsid(spark, d):
    df = view(spark, d, "sumstats")
    known = df.select(F.concat(F.lit("chr"), F.col("CHR").cast("string")).alias("chrom"), F.col("POS").alias("pos"), F.concat("SNP", F.lit("x")).alias("dbsnp"))
    return Q.to_rsid(df.withColumnRenamed("SNP", "old"), known).select("old", F.col("SNP").alias("snp"))


OVER = "FROM points JOIN features ON chrom = f_chrom AND pos >= greatest(0, start - 5) AND pos < stop + 5"


@query(f"SELECT snp, feature {OVER}")
def overlap_join(spark, d):
    return R.overlap_join(view(spark, d, "points"), view(spark, d, "features"), 5, 64).select("snp", "feature")


def best_sql(order: str) -> str:
    return f"""WITH b AS (SELECT snp, arg_min(feature, ({order}, feature)) AS feature {OVER} GROUP BY snp)
        SELECT snp, feature, 1.0::DOUBLE AS weight FROM b UNION ALL SELECT snp, 'Unmapped', 1.0::DOUBLE FROM points WHERE snp NOT IN (SELECT snp FROM b)"""


def mapped(strategy: str) -> Query:
    return lambda spark, d: R.map_features(view(spark, d, "points"), view(spark, d, "features"), strategy, 5, 64)


for _name, _strategy, _order in (("best_by_score", "score", "-score"), ("nearest_tss", "tss", "abs(pos - CASE WHEN strand = '-' THEN stop ELSE start END)"), ("nearest_center", "center", "abs(pos - (start + stop) / 2.0::DOUBLE)")):
    QUERIES[_name], ORACLES[_name] = mapped(_strategy), with_views(best_sql(_order))
QUERIES["allow_repeat"] = mapped("allow_repeat")
ORACLES["allow_repeat"] = with_views(f"""WITH b AS (SELECT snp, feature {OVER}) SELECT snp, feature, 1.0::DOUBLE AS weight FROM b
    UNION ALL SELECT snp, 'Unmapped', 1.0::DOUBLE FROM points WHERE snp NOT IN (SELECT snp FROM b)""")


@query(f"SELECT snp FROM points WHERE snp NOT IN (SELECT snp {OVER})")
def except_unmapped(spark, d):
    p = view(spark, d, "points")
    return p.select("snp").exceptAll(R.overlap_join(p, view(spark, d, "features"), 5, 64).select("snp").distinct())


def indexed_points(spark, d) -> DataFrame:
    from pyspark.sql import Window

    return view(spark, d, "points").withColumn("row_idx", F.row_number().over(Window.partitionBy("chrom").orderBy("pos")) - 1)


@query("""WITH i AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS r FROM points), b AS (SELECT chrom, (r // 50)::INT AS batch, min(pos) - 100.0 AS lo, max(pos) + 100.0 AS hi FROM i GROUP BY 1, 2)
    SELECT b.chrom, batch, count(*) AS n_refs, min(pos) AS first_pos, max(pos) AS last_pos FROM b JOIN points p ON p.chrom = b.chrom AND pos >= lo AND pos <= hi GROUP BY 1, 2""")
def ld_band_batches(spark, d):
    t = indexed_points(spark, d)
    near = R.band_join(t, view(spark, d, "points"), R.band_batches(t, 50, 100.0), 200.0)
    return near.groupBy("chrom", "batch").agg(F.count(F.lit(1)).alias("n_refs"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


RANKED = """g AS (SELECT count(DISTINCT gene) AS n FROM expr), r AS (SELECT cell, gene, value, n - count(*) OVER (PARTITION BY cell) AS z,
    rank() OVER (PARTITION BY cell ORDER BY value) + (count(*) OVER (PARTITION BY cell, value) - 1) / 2.0::DOUBLE AS k FROM expr, g),
    ranks AS (SELECT cell, gene, ln(z + k) AS lr, CASE WHEN z > 0 THEN ln((z + 1) / 2.0::DOUBLE) END AS zero_lr FROM r)"""


@query(f"WITH {RANKED} SELECT cell, gene, round(lr, 6) AS lr, round(zero_lr, 6) AS zero_lr FROM ranks")
def log_ranks(spark, d):
    e = view(spark, d, "expr")
    return rounded(X.log_ranks(e, e.select("gene").distinct().count()))


STATS = """c AS (SELECT count(*) AS n, sum(coalesce(z, 0)) AS z FROM (SELECT cell, max(zero_lr) AS z FROM ranks GROUP BY cell)),
    stats AS (SELECT gene, (sum(lr) + max(c.z) - sum(coalesce(zero_lr, 0))) / max(c.n) AS g_mean, count(*)::DOUBLE / max(c.n) AS frac FROM ranks, c GROUP BY gene)"""


@query(f"WITH {RANKED}, {STATS} SELECT gene, round(g_mean, 6) AS g_mean, round(frac, 6) AS frac FROM stats")
def gene_rank_stats(spark, d):
    e = view(spark, d, "expr")
    return rounded(X.gene_stats(X.log_ranks(e, e.select("gene").distinct().count())))


@query("""WITH g AS (SELECT annotation FROM cells WHERE annotation IS NOT NULL GROUP BY 1 HAVING count(*) >= 20) SELECT cell, annotation, n_genes FROM cells WHERE annotation IN (SELECT annotation FROM g) AND n_genes >= 20""")
def cell_filter_chain(spark, d):
    return X.filter_cells(view(spark, d, "cells"), min_cells=20).select("cell", "annotation", "n_genes")


@query("SELECT count(*) AS n_start, count(annotation) AS n_annotated, count(annotation) AS n_large_group, count(*) FILTER (WHERE n_genes >= 20) AS n_kept FROM cells")
def cell_filter_counts(spark, d):
    return X.filter_stats(view(spark, d, "cells"), min_cells=20)


@query("SELECT cell, count(*) FILTER (WHERE value <> 0) AS n_genes FROM expr GROUP BY cell")
def genes_per_cell(spark, d):
    return X.genes_per_cell(view(spark, d, "expr"))


@query("SELECT DISTINCT gene FROM expr WHERE NOT regexp_matches(gene, '(?i)^(brand#1|MT-)')")
def gene_regex_filter(spark, d):
    return X.drop_genes(view(spark, d, "expr"), "^(BRAND#1|MT-)").select("gene").distinct()


DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@query(f"""WITH r AS (SELECT a.annotation, a.cell, b.cell AS nbr, {DIST} AS dist, row_number() OVER (PARTITION BY a.cell ORDER BY {DIST}, b.cell) AS pos FROM cells a JOIN cells b ON a.annotation = b.annotation)
    SELECT annotation, cell, nbr, round(dist, 6) AS dist, pos FROM r WHERE pos <= 5""")
def knn_2d(spark, d):
    c = view(spark, d, "cells")
    return rounded(K.knn(c, c, 5, ["annotation"])).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH s AS (SELECT a.slice AS own, b.slice, b.i - a.i AS off, row_number() OVER (PARTITION BY a.slice ORDER BY abs(b.i - a.i), b.i - a.i DESC) AS slot
        FROM (SELECT slice, dense_rank() OVER (ORDER BY slice) AS i FROM (SELECT DISTINCT slice FROM cells)) a JOIN (SELECT slice, dense_rank() OVER (ORDER BY slice) AS i FROM (SELECT DISTINCT slice FROM cells)) b ON abs(a.i - b.i) BETWEEN 1 AND 2),
    p AS (SELECT slice AS own, slice, 0 AS slot, 4 AS k FROM (SELECT DISTINCT slice FROM cells) UNION ALL SELECT own, slice, slot, 3 FROM s WHERE slot <= 2),
    r AS (SELECT a.cell, b.cell AS nbr, p.slot, p.k, row_number() OVER (PARTITION BY a.cell, p.slot ORDER BY {DIST}, b.cell) AS pos FROM cells a JOIN p ON a.slice = p.own JOIN cells b ON b.slice = p.slice AND b.annotation = a.annotation)
    SELECT cell, nbr, slot::BIGINT AS slot, pos FROM r WHERE pos <= k""")
def knn_adjacent_slice(spark, d):
    out = K.cross_slice_knn(view(spark, d, "cells"), 4, 3, 1)
    return out.select("cell", "nbr", F.col("slot").cast("long").alias("slot"), F.col("pos").cast("long").alias("pos"))


COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"""WITH r AS (SELECT a.vec_id, b.vec_id AS nbr, {COS} AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 12) DESC, b.vec_id) AS pos
    FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0) SELECT vec_id, nbr, round(sim, 6) AS sim, pos FROM r WHERE pos <= 10""")
def embedding_cosine_topk(spark, d):
    e = view(spark, d, "embeddings")
    return rounded(K.embedding_knn(e.where("vec_id % 20 = 0"), e, 10)).withColumn("pos", F.col("pos").cast("long"))


@query()
def embedding_fuzzy_weights(spark, d):
    e = view(spark, d, "embeddings")
    near = K.embedding_knn(e.where("vec_id % 20 = 0"), e, 21, metric="euclidean").withColumn("dist", -F.col("sim"))
    return rounded(K.fuzzy_weights(near, "vec_id", 21))


@query(f"""WITH r AS (SELECT a.annotation, a.cell, b.cell AS nbr, row_number() OVER (PARTITION BY a.cell ORDER BY {DIST}, b.cell) AS pos FROM cells a JOIN cells b ON a.annotation = b.annotation),
    e AS (SELECT DISTINCT least(cell, nbr) AS src, greatest(cell, nbr) AS dst FROM r WHERE pos <= 5 AND cell <> nbr) SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e""")
def knn_graph(spark, d):
    c = view(spark, d, "cells")
    return K.graph_edges(K.knn(c, c, 5, ["annotation"]))


EDGES = f"""r AS (SELECT a.cell, b.cell AS nbr, row_number() OVER (PARTITION BY a.cell ORDER BY {DIST}, b.cell) AS pos FROM cells a JOIN cells b ON a.annotation = b.annotation),
    u AS (SELECT DISTINCT least(cell, nbr) AS src, greatest(cell, nbr) AS dst FROM r WHERE pos <= 5 AND cell <> nbr), f AS (SELECT src, dst FROM u UNION ALL SELECT dst, src FROM u UNION ALL SELECT cell, cell FROM cells),
    g AS (SELECT dst, count(*) AS n FROM f GROUP BY 1)"""


@query(f"""WITH {EDGES}, h1 AS (SELECT f.dst AS cell, sum(c.x / sqrt(gs.n * gt.n)) AS v FROM f JOIN cells c ON c.cell = f.src JOIN g gs ON gs.dst = f.src JOIN g gt ON gt.dst = f.dst GROUP BY 1),
    h2 AS (SELECT f.dst AS cell, sum(h1.v / sqrt(gs.n * gt.n)) AS v FROM f JOIN h1 ON h1.cell = f.src JOIN g gs ON gs.dst = f.src JOIN g gt ON gt.dst = f.dst GROUP BY 1)
    SELECT cell, 1 AS hop, round(v, 5) AS value FROM h1 UNION ALL SELECT cell, 2, round(v, 5) FROM h2""")
def gcn_hop(spark, d):
    c = view(spark, d, "cells")
    out = K.propagate(K.graph_edges(K.knn(c, c, 5, ["annotation"])), c.select("cell", F.lit("x").alias("feature"), F.col("x").alias("value")), 2)
    return rounded(out.select("cell", "hop", "value"), 5)


NEAR = "SELECT a.cell, b.cell AS nbr, 1.0::DOUBLE / (1 + abs(a.cell - b.cell)) AS weight, (b.cell % 2)::INT AS slot FROM (SELECT DISTINCT cell FROM expr) a JOIN (SELECT DISTINCT cell FROM expr) b ON b.cell BETWEEN a.cell - 2 AND a.cell + 2"


def line_neighbours(spark, d) -> DataFrame:
    c = view(spark, d, "expr").select("cell").distinct()
    near = c.withColumn("nbr", F.explode(F.sequence(F.col("cell") - 2, F.col("cell") + 2))).join(c.select(F.col("cell").alias("nbr")), "nbr", "left_semi")
    return near.select("cell", "nbr", (F.lit(1.0) / (1 + F.abs(F.col("cell") - F.col("nbr")))).alias("weight"), F.expr("cast(nbr % 2 as int)").alias("slot"))


def gss_sql(slot: bool) -> str:
    key = "cell, slot" if slot else "cell"
    on = "a.cell = t.cell AND a.slot = t.slot" if slot else "a.cell = t.cell"
    body = f"""WITH {RANKED}, {STATS}, near AS ({NEAR}), low AS (SELECT cell, max(zero_lr) AS zl, min(lr) AS lo FROM ranks GROUP BY cell),
        n AS (SELECT near.*, zl, lo FROM near JOIN low ON low.cell = near.nbr), t AS (SELECT {key}, sum(weight) AS w, sum(weight * coalesce(zl, 0)) AS wz, count(*) AS k FROM n GROUP BY {key}),
        a AS (SELECT {", ".join("n." + c for c in key.split(", "))}, gene, sum(weight * (lr - coalesce(zl, 0))) AS x, count(*) FILTER (WHERE zl IS NOT NULL OR lr > lo) AS e FROM n JOIN ranks r ON r.cell = n.nbr GROUP BY ALL),
        s AS (SELECT a.*, exp((x + wz) / w - g_mean) AS s, e / k::DOUBLE AS share, frac FROM a JOIN t ON {on} JOIN stats USING (gene) WHERE w > 0),
        o AS (SELECT {key}, gene, exp(power(s, 1.5)) - 1 AS score FROM s WHERE s >= 1 AND share > frac)"""
    if not slot:
        return body + " SELECT cell, gene, round(score, 5) AS score FROM o"
    return body + ", m AS (SELECT cell, count(*) AS n FROM t WHERE w > 0 GROUP BY 1) SELECT o.cell, gene, round(sum(score) / max(n), 5) AS score FROM o JOIN m ON m.cell = o.cell GROUP BY o.cell, gene"


def ranked(spark, d) -> tuple[DataFrame, DataFrame]:
    e = view(spark, d, "expr")
    r = X.log_ranks(e, e.select("gene").distinct().count())
    return r, X.gene_stats(r)


@query(gss_sql(False))
def gss_weighted_geomean(spark, d):
    return rounded(X.gss(line_neighbours(spark, d), *ranked(spark, d)), 5)


@query(gss_sql(True))
def gss_hierarchical(spark, d):
    return rounded(X.gss_hierarchical(line_neighbours(spark, d), *ranked(spark, d)), 5)


@query("SELECT snp, cell, round(sum(w * score), 6) AS ld FROM weights JOIN scores ON feature = gene GROUP BY 1, 2")
def sparse_matmul(spark, d):
    return rounded(L.cell_ld_scores(view(spark, d, "weights"), view(spark, d, "scores")))


@query("SELECT snp, round(coalesce(sum(w) FILTER (WHERE feature <> 'Unmapped'), 0), 6) AS all_gene, round(sum(w), 6) AS base FROM weights GROUP BY snp")
def baseline_ld(spark, d):
    return rounded(L.baseline(view(spark, d, "weights")))


def genotypes(spark, d) -> DataFrame:
    g = view(spark, d, "geno")
    return g.groupBy("snp").agg(F.array_sort(F.collect_list(F.struct("sample", "dosage"))).alias("r")).select("snp", F.expr("transform(r, x -> CAST(x.dosage AS FLOAT))").alias("dosages"))


@query("SELECT snp, count(dosage) AS n_seen, round(avg(dosage), 6) AS mean, round(stddev_pop(dosage), 6) AS std, round(least(avg(dosage) / 2, 1 - avg(dosage) / 2), 6) AS maf FROM geno GROUP BY snp")
def variant_stats(spark, d):
    return rounded(L.variant_stats(genotypes(spark, d)).select("snp", F.col("n_seen").cast("long").alias("n_seen"), "mean", "std", "maf"))


VARIANTS = "v AS (SELECT snp, row_number() OVER (ORDER BY snp) - 1 AS row_idx, (row_number() OVER (ORDER BY snp) - 1) // 5 AS batch FROM (SELECT DISTINCT snp FROM geno))"
BAND = "w AS (SELECT batch, min(row_idx) - 6 AS lo, max(row_idx) + 6 AS hi FROM v GROUP BY batch)"  # of batches of five, six variants on either side
L2 = "SELECT a.snp AS target, b.snp AS ref, power(corr(a.dosage, b.dosage), 2) - (1 - power(corr(a.dosage, b.dosage), 2)) / (count(*) - 2) AS l2 FROM geno a JOIN geno b USING (sample) GROUP BY 1, 2"
L2_BAND = f"SELECT l.* FROM ({L2}) l JOIN v t ON t.snp = l.target JOIN v r ON r.snp = l.ref JOIN w ON w.batch = t.batch WHERE r.row_idx >= w.lo AND r.row_idx < w.hi"


def variants(spark, d) -> DataFrame:
    """The brands as variants of one chromosome, in order of name."""
    snps = view(spark, d, "geno").select("snp").distinct()
    return snps.select("snp", F.lit("1").alias("chrom"), (F.row_number().over(Window.orderBy("snp")) - 1).cast("long").alias("row_idx")).withColumn("pos", F.col("row_idx") * 1000).withColumn("cm", F.lit(0.0))


def l2_table(spark, d) -> DataFrame:
    v = variants(spark, d)
    return L.ld_r2(genotypes(spark, d).join(v.select("snp", "chrom", "row_idx"), "snp"), L.ld_pairs(v, v, 6, "SNP", 5))


@query(f"WITH {VARIANTS}, {BAND} SELECT target, ref, round(l2, 5) AS l2 FROM ({L2_BAND})")
def ld_r2(spark, d):
    return rounded(l2_table(spark, d), 5)


@query(f"WITH {VARIANTS}, {BAND} SELECT target AS snp, round(sum(l2), 4) AS l2 FROM ({L2_BAND}) GROUP BY 1")
def ld_score(spark, d):
    return rounded(L.ld_scores(l2_table(spark, d)), 4)


@query(f"WITH {VARIANTS}, {BAND} SELECT target AS snp, substr(ref, 1, 7) AS feature, round(sum(l2), 4) AS w FROM ({L2_BAND}) GROUP BY 1, 2")
def ld_weight_matmul(spark, d):
    m = view(spark, d, "geno").select("snp").distinct().select("snp", F.substring("snp", 1, 7).alias("feature"), F.lit(1.0).alias("weight"))
    return rounded(L.ld_weights(l2_table(spark, d), m), 4)


DESIGN = """i AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders), d AS (SELECT (r // (n // 50))::INT AS block, o_orderkey % 4 AS cell,
    o_totalprice / 100000 AS x, CAST(o_custkey % 100 AS DOUBLE) / 10 + o_totalprice / 300000 AS y FROM i WHERE r < (n // 50) * 50)"""


def design(spark, d) -> DataFrame:
    o = R.assign_blocks(R.row_index(view(spark, d, "orders"), "o_orderkey"), 50)
    return o.selectExpr("block", "o_orderkey % 4 AS cell", "o_totalprice / 100000 AS x", "CAST(o_custkey % 100 AS DOUBLE) / 10 + o_totalprice / 300000 AS y", "1.0D AS one", "1.0D AS w")


@query(f"WITH {DESIGN} SELECT cell, block, round(sum(x * x), 4) AS xx_0_0, round(sum(x), 4) AS xx_0_1, round(sum(1.0::DOUBLE), 4) AS xx_1_1, round(sum(x * y), 4) AS xy_0, round(sum(y), 4) AS xy_1 FROM d GROUP BY 1, 2")
def block_xtx(spark, d):
    return rounded(S.jackknife_sums(design(spark, d), ["cell"], "block", ["x", "one"], "y", "w"), 4)


@query(f"""WITH {DESIGN}, b AS (SELECT cell, block, sum(x * x) AS xx, sum(x) AS x, count(*)::DOUBLE AS n, sum(x * y) AS xy, sum(y) AS y FROM d GROUP BY 1, 2),
    t AS (SELECT cell, sum(xx) AS xx, sum(x) AS x, sum(n) AS n, sum(xy) AS xy, sum(y) AS y, count(*) AS k FROM b GROUP BY 1),
    v AS (SELECT t.cell, k, k * (t.n * t.xy - t.x * t.y) / (t.n * t.xx - t.x * t.x) - (k - 1) * ((t.n - b.n) * (t.xy - b.xy) - (t.x - b.x) * (t.y - b.y)) / ((t.n - b.n) * (t.xx - b.xx) - power(t.x - b.x, 2)) AS pv FROM t JOIN b USING (cell))
    SELECT cell, round(avg(pv), 6) AS beta, round(sqrt(var_samp(pv) / count(*)), 6) AS se FROM v GROUP BY cell""")
def jackknife_slope(spark, d):
    return rounded(S.jackknife_wls(design(spark, d), ["cell"], "block", ["x", "one"], "y", "w").select("cell", "beta", "se"))


@query()
def spatial_ldsc(spark, d):
    s = view(spark, d, "sumstats").select(F.col("SNP").alias("snp"), (F.col("BETA") / F.col("SE")).alias("z"), F.col("N").alias("n"), F.col("POS").alias("row_idx"))
    w = view(spark, d, "weights")
    w_ld = w.groupBy("snp").agg((1 + F.sum("w")).alias("l2"))
    return L.spatial_ldsc(w, view(spark, d, "scores"), s, w_ld, 50)


@query("""WITH r AS (SELECT *, rank() OVER (PARTITION BY annotation ORDER BY p) + count(*) OVER (PARTITION BY annotation, p) - 1 AS k, count(*) OVER (PARTITION BY annotation) AS n FROM spots),
    q AS (SELECT spot, annotation, p, least(1.0, min(p * n / k) OVER (PARTITION BY annotation ORDER BY p DESC, spot ROWS UNBOUNDED PRECEDING)) AS q0 FROM r), m AS (SELECT spot, annotation, min(q0) OVER (PARTITION BY annotation, p) AS q FROM q)
    SELECT spot, round(q, 8) AS q, q <= 0.9 AS rejected FROM m""")
def bh_fdr(spark, d):
    return R.bh_fdr(view(spark, d, "spots"), "p", ["annotation"], 0.9).select("spot", F.round("q", 8).alias("q"), "rejected")


@query("WITH n AS (SELECT annotation, count(*) AS n FROM spots GROUP BY 1) SELECT annotation, max(n) AS n, round(0.05 / max(n), 10) AS threshold, count(*) FILTER (WHERE p < 0.05 / n) AS n_significant FROM spots JOIN n USING (annotation) GROUP BY 1")
def bonferroni(spark, d):
    return rounded(R.bonferroni(view(spark, d, "spots"), "p", ["annotation"]), 10)


@query("SELECT annotation, least(count(*), 40) AS n FROM (SELECT annotation, row_number() OVER (PARTITION BY annotation) AS k FROM spots) WHERE k <= 40 GROUP BY 1")
def stratified_sample_counts(spark, d):
    """Strata of equal size, forty rows each of two hundred."""
    s = view(spark, d, "spots").withColumn("_k", F.row_number().over(Window.partitionBy("annotation").orderBy("spot"))).where("_k <= 40")
    return R.stratified_sample(s, "annotation", "spot", 200).groupBy("annotation").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT gene, round(corr(value, cell::DOUBLE), 6) AS pcc FROM expr GROUP BY gene")
def pcc_gene_trait(spark, d):
    return rounded(S.correlation(view(spark, d, "expr").withColumn("t", F.col("cell").cast("double")), ["gene"], "value", "t"))


@query("WITH m AS (SELECT cell AS annotation, gene, median(score) AS m FROM scores GROUP BY 1, 2) SELECT gene, arg_max(annotation, (m, annotation)) AS annotation, round(max(m), 6) AS median FROM m GROUP BY gene")
def median_gss_argmax(spark, d):
    return rounded(S.best_annotation(view(spark, d, "scores").withColumnRenamed("cell", "annotation"), "annotation", "gene", "score"))


@query("""SELECT annotation, round(-log10(min(p) FILTER (WHERE sample = '0')), 6) AS "0", round(-log10(min(p) FILTER (WHERE sample = '1')), 6) AS "1" FROM spots GROUP BY 1""")
def trait_pivot(spark, d):
    m = view(spark, d, "spots").groupBy("annotation", "sample").agg(F.min("p").alias("p"))
    return rounded(S.pivot_traits(m, "annotation", "sample", "p", ["0", "1"]))


@query("WITH l AS (SELECT CHR, max(POS) AS m FROM sumstats GROUP BY 1), o AS (SELECT a.CHR, coalesce(sum(b.m), 0)::BIGINT AS o FROM l a LEFT JOIN l b ON b.CHR < a.CHR GROUP BY 1) SELECT SNP AS snp, POS + o AS cum_pos FROM sumstats JOIN o USING (CHR)")
def manhattan_cumpos(spark, d):
    return R.cumulative_position(view(spark, d, "sumstats"), "CHR", "POS").select(F.col("SNP").alias("snp"), "cum_pos")


@query("SELECT SNP AS snp, P AS p FROM sumstats ORDER BY P, SNP LIMIT 500")
def manhattan_subset(spark, d):
    return S.smallest_or_under(view(spark, d, "sumstats"), "P", "SNP", 1e-5, 500).select(F.col("SNP").alias("snp"), F.col("P").alias("p"))


@query("""WITH v AS (SELECT avg(vx) AS x, avg(vy) AS y, avg(vz) AS z FROM (SELECT slice, var_pop(x) AS vx, var_pop(y) AS vy, var_pop(n_genes) AS vz FROM cells GROUP BY slice HAVING count(*) > 1))
    SELECT CASE WHEN z <= x AND z <= y THEN 'z' WHEN x <= y THEN 'x' ELSE 'y' END AS axis, round(least(x, y, z), 4) AS mean_var FROM v""")
def z_axis(spark, d):
    return rounded(S.detect_z_axis(view(spark, d, "cells").withColumn("z", F.col("n_genes").cast("double")), "slice", ["x", "y", "z"]), 4)


@query("""WITH r AS (SELECT annotation, value, row_number() OVER (PARTITION BY annotation ORDER BY value DESC) AS k FROM spots)
    SELECT annotation, round(quantile_cont(value, 0.999), 6) AS q999, round(quantile_cont(value, 0.995), 6) AS q995, round(median(value) FILTER (WHERE k <= 20), 6) AS median_top FROM r GROUP BY 1""")
def colour_limits(spark, d):
    return rounded(S.colour_limits(view(spark, d, "spots"), ["annotation"], "value"))


@query("SELECT snp, CASE WHEN max(w) > 0.5 THEN arg_max(feature, (w, feature)) ELSE 'None' END AS feature, round(max(w), 6) AS w FROM weights GROUP BY snp")
def best_gene_per_snp(spark, d):
    return rounded(S.best_gene(view(spark, d, "weights"), "snp", "feature", "w", 0.5))


@query("WITH s AS (SELECT annotation, avg(value) AS m, stddev_pop(value) AS s FROM spots GROUP BY 1) SELECT spot, round((value - m) / s, 6) AS zscore FROM spots JOIN s USING (annotation)")
def zscore_by_group(spark, d):
    return S.zscore(view(spark, d, "spots"), "value", ["annotation"]).select("spot", F.round("zscore", 6).alias("zscore"))


@query("SELECT c_custkey AS id, c_nationkey AS nation, 0.0::DOUBLE AS extra FROM customer UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def union_samples(spark, d):
    a = view(spark, d, "customer").selectExpr("c_custkey AS id", "c_nationkey AS nation")
    return R.union_all([a, view(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_nationkey AS nation", "s_acctbal AS extra")], fill=0.0)


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_genes(spark, d):
    return view(spark, d, "customer").selectExpr("c_nationkey AS nation").intersect(view(spark, d, "supplier").selectExpr("s_nationkey"))


@query("SELECT o_orderkey AS spot, o_totalprice AS price, c.m AS most, e.value AS value FROM orders JOIN (SELECT l_orderkey, max(l_quantity) AS m FROM lineitem GROUP BY 1) c ON c.l_orderkey = o_orderkey JOIN events e ON e.event_id = o_orderkey")
def join_traits_nway(spark, d):
    tables = {"price": view(spark, d, "orders").selectExpr("o_orderkey AS spot", "o_totalprice AS v"), "most": view(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("spot")).agg(F.max("l_quantity").alias("v")), "value": view(spark, d, "events").selectExpr("event_id AS spot", "value AS v")}
    return R.nway_join(tables, "spot", "v")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem) AND s_nationkey IN (SELECT c_nationkey FROM customer)")
def ordered_intersection(spark, d):
    s = view(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_nationkey AS nation")
    both = R.ordered_intersection(s, [view(spark, d, "lineitem").selectExpr("l_suppkey AS id")], "id")
    return R.ordered_intersection(both, [view(spark, d, "customer").selectExpr("c_nationkey AS nation")], "nation").select("id")


@query("SELECT snp, coalesce(w, 0.0)::DOUBLE AS w FROM points LEFT JOIN (SELECT snp, round(sum(w), 6) AS w FROM weights GROUP BY 1) USING (snp)")
def align_fill(spark, d):
    w = view(spark, d, "weights").groupBy("snp").agg(F.round(F.sum("w"), 6).alias("w"))
    return R.align_fill(view(spark, d, "points"), w, "snp")


@query("WITH t AS (SELECT cell, sum(value) AS t FROM expr GROUP BY 1) SELECT cell, gene, round(ln(1 + value * 10000 / t), 6) AS value FROM expr JOIN t USING (cell)")
def lognorm(spark, d):
    return rounded(X.normalise(view(spark, d, "expr")))


@query("""WITH k AS (SELECT count(DISTINCT cell) AS n FROM expr), t AS (SELECT cell, sum(value) AS t FROM expr GROUP BY 1), v AS (SELECT gene, value * 10000 / t AS v FROM expr JOIN t USING (cell)), s AS (SELECT gene, sum(v) AS s, sum(v * v) AS q FROM v GROUP BY 1)
    SELECT gene, round(s / n, 4) AS mean, round((q - s * s / n) / (n - 1) / (s / n), 3) AS dispersion FROM s, k""")
def gene_dispersion(spark, d):
    e = view(spark, d, "expr")
    out = X.gene_dispersion(X.normalise(e), e.select("cell").distinct().count())
    return out.select("gene", F.round("mean", 4).alias("mean"), F.round("dispersion", 3).alias("dispersion"))


@query(f"""WITH n AS (SELECT count(DISTINCT cell) AS n FROM expr), x AS (SELECT gene, cell % 3 AS grp, value, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0::DOUBLE AS k, count(*) OVER (PARTITION BY gene) AS e FROM expr),
    m AS (SELECT cell % 3 AS grp, count(DISTINCT cell) AS m FROM expr GROUP BY 1), tie AS (SELECT gene, sum(power(t, 3) - t) AS tt FROM (SELECT gene, value, count(*)::DOUBLE AS t FROM expr GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT x.gene, x.grp, sum(n - e + k) + (max(m) - count(*)) * (max(n) - max(e) + 1) / 2.0::DOUBLE AS r, max(m) AS m, max(n)::DOUBLE AS n, max(tt) + power((max(n) - max(e))::DOUBLE, 3) - (max(n) - max(e)) AS tt FROM x JOIN m ON m.grp = x.grp JOIN tie ON tie.gene = x.gene, n GROUP BY 1, 2)
    SELECT grp AS "group", gene, round((r - m * (n + 1) / 2) / sqrt(m * (n - m) / 12 * ((n + 1) - tt / (n * (n - 1)))), 5) AS z FROM s""")
def rank_sum(spark, d):
    e = view(spark, d, "expr")
    g = e.select("cell", (F.col("cell") % 3).alias("group")).distinct()
    return rounded(X.rank_sum(e, g, g.count()).select("group", "gene", "z"), 5)


@query("SELECT annotation, round(greatest(0, quantile_cont(value, 0.5) - (quantile_cont(value, 0.75) - quantile_cont(value, 0.25))), 6) AS threshold FROM spots GROUP BY 1")
def quality_threshold(spark, d):
    return rounded(X.quality_threshold(view(spark, d, "spots"), "annotation", "value"))


@query("WITH b AS (SELECT annotation, min(value) AS lo, max(value) AS hi FROM spots GROUP BY 1) SELECT spot, CASE WHEN hi <= lo THEN 0 ELSE least(3, floor((value - lo) / (hi - lo) * 4))::INT END AS bin FROM spots JOIN b USING (annotation)")
def equal_width_bins(spark, d):
    s = view(spark, d, "spots")
    b = s.groupBy("annotation").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return s.join(b, "annotation").select("spot", F.expr(E.equal_width("value", "lo", "hi")).alias("bin"))


@query("WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part) SELECT p_partkey, CASE WHEN i > 0 THEN p_brand || '-' || i ELSE p_brand END AS p_brand FROM r")
def make_unique(spark, d):
    return R.make_unique(view(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", ["p_partkey"])


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_idx FROM orders) SELECT o_orderkey, row_idx FROM r WHERE row_idx >= 100 AND row_idx < 5000")
def row_range_slice(spark, d):
    o = R.row_index(view(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"])
    return R.row_slice(o, 100, 5000).select("o_orderkey", "row_idx")


@query("SELECT cell, annotation, 10.0::DOUBLE * (list_position(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'], annotation) - 1) / 4 AS z FROM cells")
def pseudo_z(spark, d):
    return R.pseudo_z(view(spark, d, "cells"), "annotation", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], 10.0).select("cell", "annotation", "z")


@query("SELECT CAST(slice AS STRING) AS slice, regexp_replace(annotation, '[^0-9A-Za-z]', '_', 'g') AS name, count(*) AS n FROM cells GROUP BY 1, 2")
def labels_and_names(spark, d):
    return R.null_label(view(spark, d, "cells"), "slice").groupBy("slice", F.expr(E.safe_name("annotation")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT annotation, count(*) AS n, count(DISTINCT sample) AS n_samples FROM spots GROUP BY 1")
def value_counts(spark, d):
    return view(spark, d, "spots").groupBy("annotation").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sample").alias("n_samples"))


@query("SELECT snp, coalesce(n, 0) AS n FROM points LEFT JOIN (SELECT snp, count(*) AS n FROM weights GROUP BY 1) USING (snp)")
def left_enrich(spark, d):
    n = view(spark, d, "weights").groupBy("snp").agg(F.count(F.lit(1)).alias("n"))
    return view(spark, d, "points").select("snp").join(n, "snp", "left").fillna(0, ["n"])


@query("""WITH r AS (SELECT annotation, median(sqrt(power(x - nx, 2) + power(y - ny, 2))) AS m FROM (SELECT a.annotation, a.x, a.y, arg_min(b.x, (sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), b.cell)) AS nx, arg_min(b.y, (sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), b.cell)) AS ny FROM cells a JOIN cells b ON a.annotation = b.annotation AND a.cell <> b.cell GROUP BY a.annotation, a.cell, a.x, a.y) GROUP BY 1)
    SELECT annotation, round(m, 5) AS median_distance FROM r""")
def median_nearest_distance(spark, d):
    c = view(spark, d, "cells")
    return K.knn(c, c, 2, ["annotation"]).where(F.col("cell") != F.col("nbr")).groupBy("annotation").agg(F.round(F.expr("percentile(dist, 0.5D)"), 5).alias("median_distance"))


@query()
def embedding_pca(spark, d):
    return K.principal_components(view(spark, d, "embeddings"), "embedding", 2).select("vec_id", F.expr("transform(pca, x -> round(abs(x), 5))").alias("pca"))


@query()
def columnar_json(spark, d):
    return sinks.columnar_json(S.region_summary(view(spark, d, "spots"), "x", ["annotation"]), digits=6)
