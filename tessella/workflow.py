"""The whole analysis as steps over Parquet tables in one project folder; finished steps are skipped.

Tables read: expr (cell, gene, value), cells (cell, annotation, and x, y unless the data are of
single cells without places, optionally slice, sample, embeddings), weights (snp,
feature, w), sumstats by trait (snp, z, n, row_idx), w_ld (snp, l2).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import exprs as E
from tessella.operators import expression as X
from tessella.operators import ldscores as L
from tessella.operators import neighbours as K
from tessella.operators import relational as R
from tessella.operators import stats as S
from tessella.sources import readers, sinks

STEPS = ("find_latent", "latent_to_gene", "spatial_ldsc", "cauchy", "report")


@dataclass(frozen=True)
class Config:
    project: str
    expr: str = ""
    cells: str = ""
    weights: str = ""
    w_ld: str = ""
    sumstats: Mapping[str, str] = field(default_factory=dict)
    extra: str = ""
    homologs: str = ""
    dataset: str = "spatial"
    emb_cell: str = "emb_cell"
    emb_niche: str = "emb_niche"
    own_embeddings: bool = False
    own_scores: str = ""
    sample: str = ""
    cells_from: int = 0
    cells_to: int = 0
    high_quality: bool = False
    by_sample: bool = False
    n_variable_genes: int = 2000
    n_components: int = 32
    graph_neighbours: int = 10
    hops: int = 3
    spatial_neighbours: int = 301
    homogeneous_neighbours: int = 21
    adjacent_neighbours: int = 200
    n_adjacent_slices: int = 0
    cell_threshold: float = 0.0
    niche_threshold: float = 0.6
    min_cells: int = 21
    min_genes: int = 20
    expression_filter: bool = True
    n_blocks: int = 200
    start: str = STEPS[0]
    stop: str = STEPS[-1]

    def __post_init__(self):
        if self.start not in STEPS or self.stop not in STEPS or STEPS.index(self.start) > STEPS.index(self.stop):
            raise ValueError(f"start and stop must be steps in order: {', '.join(STEPS)}")
        if self.dataset not in ("spatial", "scrna"):
            raise ValueError("dataset must be spatial or scrna")
        if self.cells_from < 0 or (self.cells_to and self.cells_to < self.cells_from):
            raise ValueError("0 <= cells_from <= cells_to is needed")
        if self.homogeneous_neighbours > self.spatial_neighbours:
            raise ValueError("homogeneous_neighbours must not exceed spatial_neighbours")

    def at(self, name: str) -> str:
        return f"{self.project}/{name}"


def dense(expr: DataFrame, genes: Sequence[str], name: str) -> DataFrame:
    """(cell, array of the genes' values)."""
    place = F.create_map(*(x for i, g in enumerate(genes) for x in (F.lit(g), F.lit(i))))
    some = expr.where(F.col("gene").isin(list(genes))).groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct(place[F.col("gene")].alias("i"), F.col("value")))).alias("m"))
    return some.select("cell", F.transform(F.sequence(F.lit(0), F.lit(len(genes) - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias(name))


def variable(expr: DataFrame, cells: DataFrame, n: int) -> list[str]:
    """The n genes of most variance; of several samples those that vary highly in most of them, by median variance."""

    def of(some: DataFrame, among: DataFrame) -> DataFrame:
        m = among.count()
        out = X.gene_variance(some, m) if X.looks_like_counts(some) else X.gene_dispersion(some, m).withColumnRenamed("dispersion", "variance")
        return out.select("gene", "variance")

    samples = [r[0] for r in cells.select("sample").distinct().orderBy("sample").collect()] if "sample" in cells.columns else []
    if len(samples) < 2:
        return [r[0] for r in of(expr, cells).orderBy(F.desc_nulls_last("variance"), "gene").limit(n).collect()]
    every = None
    for s in samples:
        among = cells.where(F.col("sample").eqNullSafe(F.lit(s)))
        one = of(expr.join(among.select("cell"), "cell", "left_semi"), among)
        top = one.orderBy(F.desc_nulls_last("variance"), "gene").limit(n).select("gene", F.lit(True).alias("highly_variable"))
        one = one.join(F.broadcast(top), "gene", "left").fillna(False, ["highly_variable"])
        every = one if every is None else every.unionByName(one)
    return [r[0] for r in X.variable_genes(every, len(samples), n).collect()]


def expression(spark: SparkSession, c: Config) -> DataFrame:
    """(cell, gene, value), by human symbols if a list of homologs is given."""
    expr = spark.read.parquet(c.expr)
    return readers.rename_homologs(expr, readers.read_homologs(spark, c.homologs)[0]).select("cell", "gene", "value") if c.homologs else expr


def find_latent(spark: SparkSession, c: Config) -> DataFrame:
    """Cell and niche embeddings: principal components of normalised expression, and of its propagation over the k-NN graph;
    the table's own ones if asked for.  Single cells without places have no niche."""

    def make() -> DataFrame:
        expr = expression(spark, c)
        cells = X.filter_cells(spark.read.parquet(c.cells).drop("n_genes").join(X.genes_per_cell(expr), "cell"), min_cells=c.min_cells, min_genes=c.min_genes)
        kept = X.drop_genes(expr.join(cells.select("cell"), "cell", "left_semi"))
        if c.high_quality:
            quality = lambda: X.high_quality(X.normalise(kept), cells.select("cell", F.col("annotation").alias("group")), kept.select("gene").distinct().count())
            kept_cells = sinks.once(spark, c.at("quality"), quality)
            cells = sinks.once(spark, c.at("cells"), lambda own=cells: own.join(kept_cells, "cell"))
        if c.own_embeddings:
            own = {"emb_cell": F.col(c.emb_cell)} | ({"emb_niche": F.col(c.emb_niche)} if c.emb_niche in cells.columns else {})
            return cells.withColumns(own)
        genes = variable(kept, cells, c.n_variable_genes)
        value = dense(X.normalise(kept), genes, "v")
        k = min(c.n_components, len(genes))
        own = K.principal_components(value, "v", k, "emb_cell").select("cell", "emb_cell")
        if c.dataset == "scrna":
            return cells.join(own, "cell")
        by = [b for b in ("slice",) if b in cells.columns]
        edges = K.graph_edges(K.knn(cells, cells, c.graph_neighbours, by))
        long = own.select("cell", F.posexplode("emb_cell").alias("feature", "value"))
        spread = K.propagate(edges, long, c.hops).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("hop", "feature", "value"))).alias("r")).select("cell", F.transform("r", lambda x: x["value"]).alias("p"))
        niche = K.principal_components(spread, "p", k, "emb_niche").select("cell", "emb_niche")
        return cells.join(own, "cell").join(niche, "cell")

    return sinks.once(spark, c.at("latent"), make)


def latent_to_gene(spark: SparkSession, c: Config) -> DataFrame:
    """Specificity scores (cell, gene, score) from homogeneous neighbours of the same annotation."""

    def make() -> DataFrame:
        cells = spark.read.parquet(c.at("latent"))
        expr = expression(spark, c).join(cells.select("cell"), "cell", "left_semi")
        ranks = sinks.once(spark, c.at("ranks"), lambda: X.log_ranks(expr, expr.select("gene").distinct().count()))
        stats = sinks.once(spark, c.at("gene_stats"), lambda: X.gene_stats(ranks))
        niche = "emb_niche" if "emb_niche" in cells.columns else None
        if c.dataset == "scrna":
            return X.gss(K.embedding_graph(cells, c.homogeneous_neighbours), ranks, stats, c.expression_filter)
        pool = cells.where("high_quality") if c.high_quality else cells
        if "slice" in cells.columns and c.n_adjacent_slices:
            near = K.cross_slice_knn(cells, c.spatial_neighbours, c.adjacent_neighbours, c.n_adjacent_slices)
            homog = K.homogeneous(near, cells, c.homogeneous_neighbours, c.cell_threshold, c.niche_threshold, niche_vec=niche, per_slot=True)
            return X.gss_hierarchical(homog, ranks, stats)
        by = ["annotation", *(["slice"] if "slice" in cells.columns else [])]
        near = K.knn(cells, pool, c.spatial_neighbours, by)
        homog = K.homogeneous(near, cells, c.homogeneous_neighbours, c.cell_threshold, c.niche_threshold, niche_vec=niche)
        return X.gss(homog, ranks, stats, c.expression_filter)

    return sinks.once(spark, c.at("gss"), make)


def chosen_scores(spark: SparkSession, c: Config) -> DataFrame:
    """Specificity scores of the cells asked for: the project's or a table of one's own, of one sample, or of a range of cells in order."""
    scores = spark.read.parquet(c.own_scores or c.at("gss"))
    if c.sample:
        cells = spark.read.parquet(c.cells).where(F.col("sample").cast("string") == c.sample)
        scores = scores.join(cells.select("cell"), "cell", "left_semi")
    if c.cells_from or c.cells_to:
        cells = scores.select("cell").distinct()
        order = F.xxhash64("cell") if dict(cells.dtypes)["cell"] == "string" else F.col("cell")
        if "row" in (known := spark.read.parquet(c.cells) if c.cells else cells).columns:
            cells, order = cells.join(known.select("cell", "row"), "cell"), F.col("row")
        numbered = R.row_index(cells.withColumn("_order", order.cast("long")), "_order", ["cell"])
        scores = scores.join(R.row_slice(numbered, c.cells_from, c.cells_to or None).select("cell"), "cell", "left_semi")
    return scores


def spatial_ldsc(spark: SparkSession, c: Config) -> dict[str, DataFrame]:
    """Each trait's regression by cell."""
    out = {}
    for trait, path in c.sumstats.items():
        extra = spark.read.parquet(c.extra) if c.extra else None
        make = lambda path=path, extra=extra: L.spatial_ldsc(spark.read.parquet(c.weights), chosen_scores(spark, c), spark.read.parquet(path), spark.read.parquet(c.w_ld), c.n_blocks, extra)
        out[trait] = sinks.once(spark, c.at(f"ldsc/trait={trait}"), make)
    return out


def cauchy(spark: SparkSession, c: Config) -> DataFrame:
    """Each trait's p-values combined by annotation, and by sample if asked for."""

    def make(by: list[str], background: list[str]) -> DataFrame:
        path = c.at("latent") if sinks.exists(spark, c.at("latent")) else c.cells
        cells = spark.read.parquet(path).select("cell", *by)
        out = None
        for trait in c.sumstats:
            p = spark.read.parquet(c.at(f"ldsc/trait={trait}")).where("p IS NOT NULL").join(cells, "cell")
            one = S.region_summary(p.withColumn("x", F.expr(E.neg_log10("p"))), "x", by, background).withColumn("trait", F.lit(trait))
            out = one if out is None else out.unionByName(one)
        return out.orderBy("trait", *background, "p_median")

    if c.by_sample:
        sinks.once(spark, c.at("cauchy_by_sample"), lambda: make(["annotation", "sample"], ["sample"]))
    return sinks.once(spark, c.at("cauchy"), lambda: make(["annotation"], []))


def report(spark: SparkSession, c: Config) -> None:
    """The tables of a report as scripts for a web page: regions, and each trait's most correlated genes."""
    sinks.write_script(spark.read.parquet(c.at("cauchy")), c.at("report/regions"), "REGIONS", digits=6)
    gss = spark.read.parquet(c.at("gss"))
    for trait in c.sumstats:
        z = spark.read.parquet(c.at(f"ldsc/trait={trait}")).select("cell", F.col("neg_log10_p").alias("y")).dropna()
        top = S.correlation(gss.join(z, "cell"), ["gene"], "score", "y").orderBy(F.desc_nulls_last("pcc"), "gene").limit(50)
        sinks.write_script(top, c.at(f"report/genes_{trait}"), "GENES", digits=6)


def run(spark: SparkSession, c: Config) -> None:
    steps = {"find_latent": find_latent, "latent_to_gene": latent_to_gene, "spatial_ldsc": spatial_ldsc, "cauchy": cauchy, "report": report}
    for name in STEPS[STEPS.index(c.start) : STEPS.index(c.stop) + 1]:
        steps[name](spark, c)
