"""Scans: text with white space, by suffix, by chromosome, matrices in wide and long form, manifests."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULLS = ("NA", ".", "", "nan", "NaN", "NULL")


def read_whitespace(spark: SparkSession, path: str, columns: Sequence[str] | None = None, nulls: Sequence[str] = NULLS) -> DataFrame:
    """A headed text table of fields parted by white space (gz and bz2 by suffix); all columns are strings."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"))
    head = lines.first()[0]
    names = head.split()
    fields = lines.where(F.col("value") != head).where("value <> ''").select(F.split("value", r"\s+").alias("f"))
    out = fields.select(*(F.when(~F.col("f")[i].isin(*nulls), F.col("f")[i]).alias(n) for i, n in enumerate(names)))
    return out.select(*columns) if columns else out


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", header: bool = True, schema: str | None = None, null: str = "") -> DataFrame:
    r = spark.read.option("sep", sep).option("header", header).option("nullValue", null)
    return (r.schema(schema) if schema else r).csv(path)


def read_feather(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Feather files, each decoded by the task that gets it."""
    target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.feather as feather

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                yield from feather.read_table(io.BytesIO(raw), columns=target.names).to_batches(65536)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, target)


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By suffix: parquet, orc, feather, csv, json; tsv, txt, gz and bz2 are text with tabs or white space."""
    kinds = [s.lstrip(".") for s in PurePosixPath(path).suffixes]
    kind = next((k for k in reversed(kinds) if k not in ("gz", "bz2")), "gz")
    if kind in ("parquet", "orc"):
        return spark.read.format(kind).load(path)
    if kind == "feather":
        if schema is None:
            raise ValueError("feather needs a schema")
        return read_feather(spark, path, schema)
    if kind == "json":
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    if kind == "csv":
        return read_delimited(spark, path, ",", schema=schema)
    if kind == "tsv":
        return read_delimited(spark, path, "\t", schema=schema)
    return read_whitespace(spark, path)


def read_by_chromosome(spark: SparkSession, base: str, suffix: str, columns: Sequence[str] | None = None, least: int = 1, most: int = 22) -> DataFrame:
    """All files {base}{n}{suffix} of chromosomes ``least`` to ``most``, with their number as ``file_chrom``."""
    lines = spark.read.text(f"{base}[1-9]*{suffix}*").withColumn("file_chrom", F.regexp_extract(F.input_file_name(), r"(\d+)" + suffix.replace(".", r"\.") + r"[^/]*$", 1).cast("int"))
    lines = lines.where(F.col("file_chrom").between(least, most)).withColumn("value", F.trim("value"))
    names = lines.first()["value"].split()
    body = lines.where(F.col("value") != " ".join(names)).where(F.split("value", r"\s+")[0] != names[0]).withColumn("f", F.split("value", r"\s+"))
    out = body.select("file_chrom", *(F.when(~F.col("f")[i].isin(*NULLS), F.col("f")[i]).alias(n) for i, n in enumerate(names)))
    return out.select("file_chrom", *columns) if columns else out


def missing_chromosomes(df: DataFrame, most: int = 22) -> list[int]:
    have = {r[0] for r in df.select("file_chrom").distinct().collect()}
    return [c for c in range(1, most + 1) if c not in have]


def regression_weights(spark: SparkSession, base: str, suffix: str = ".l2.ldscore") -> DataFrame:
    """(snp, l2): first and last column by position once CHR, BP, CM and MAF are dropped; first of repeated SNPs."""
    df = read_by_chromosome(spark, base, suffix)
    rest = [c for c in df.columns if c not in ("file_chrom", "CHR", "BP", "CM", "MAF")]
    return df.select(F.col(rest[0]).alias("snp"), F.col(rest[1]).cast("double").alias("l2")).dropDuplicates(["snp"])


def reference_scores(spark: SparkSession, base: str, suffix: str) -> DataFrame:
    df = read_by_chromosome(spark, base, suffix)
    return df.withColumnRenamed("index", "SNP")


def wide_to_long(df: DataFrame, row: str, row_name: str = "gene", column_name: str = "cell", value: str = "score", transposed: bool = True) -> DataFrame:
    """A matrix with an identifier column as (cell, gene, value); ``transposed``: rows are genes and columns cells."""
    others = [c for c in df.columns if c != row]
    a, b = (row_name, column_name) if transposed else (column_name, row_name)
    return df.withColumnRenamed(row, a).unpivot([a], others, b, value).select(column_name, row_name, value)


def read_complete(spark: SparkSession, path: str) -> DataFrame:
    """A table whose write has finished; else an error."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        raise FileNotFoundError(f"{path} is not a complete table")
    return spark.read.parquet(path)


def with_metadata(matrix: DataFrame, cells: DataFrame, key: str = "cell") -> DataFrame:
    """Values with their cells' metadata; as many cells on either side, or an error."""
    n, m = matrix.select(key).distinct().count(), cells.select(key).distinct().count()
    if n != m:
        raise ValueError(f"{n} cells in the matrix, {m} in the metadata")
    return matrix.join(cells, key)


def probe(df: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> list[str]:
    """Names of optional columns that are missing, from the schema alone; missing required ones are an error."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return [c for c in optional if c not in df.columns]


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED6 without a header: f_chrom (without 'chr'), start, stop, feature, score, strand; rows without a name are an error."""
    df = spark.read.option("sep", "\t").schema("f_chrom string, start long, stop long, feature string, score double, strand string").csv(path)
    if df.where("feature IS NULL").limit(1).count():
        raise ValueError("every interval needs a name")
    return df.withColumn("f_chrom", F.regexp_replace("f_chrom", "^chr", ""))


def read_mapping(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """(snp, feature) by the columns SNP and Feature, or the first two; of repeated SNPs the last row counts."""
    first = spark.read.text(path).first()[0]
    sep = sep or max("\t,; ", key=first.count)
    df = read_delimited(spark, path, sep)
    snp, feature = ("SNP", "Feature") if {"SNP", "Feature"} <= set(df.columns) else df.columns[:2]
    df = df.select(F.col(snp).alias("snp"), F.col(feature).alias("feature"), F.struct(F.input_file_name(), F.input_file_block_start(), F.monotonically_increasing_id()).alias("_at"))
    return df.groupBy("snp").agg(F.max_by("feature", "_at").alias("feature"))


def read_annotations(spark: SparkSession, path: str, panel: DataFrame, index: str = "row_idx") -> DataFrame:
    """Annotations on the panel's SNPs, 0 where missing: by SNP, or (thin files) by row."""
    df = read_whitespace(spark, path)
    names = [c for c in df.columns if c not in ("CHR", "BP", "SNP", "CM")]
    values = [F.col(c).cast("double").alias(c) for c in names]
    if "SNP" in df.columns:
        return panel.select("snp").join(df.select(F.col("SNP").alias("snp"), *values), "snp", "left").fillna(0.0, names)
    # a thin file has no key: its single text file is read in order, in one pass, and numbered
    thin = df.coalesce(1).select(*values, F.monotonically_increasing_id().alias(index))
    return panel.select("snp", index).join(thin, index, "left").drop(index).fillna(0.0, names)


def read_snp_list(spark: SparkSession, folder: str, chrom: int, patterns: Sequence[str] = ("hm.{}.snp", "hapmap3_snps/hm.{}.snp", "{}.snp", "chr{}.snp", "hm3.{}.txt")) -> DataFrame:
    """(snp): the first of the named files that is there; else an error with all that were tried."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    tried = [f"{folder}/{p.format(chrom)}" for p in patterns]
    for path in tried:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return spark.read.text(path).select(F.trim("value").alias("snp")).where("snp <> ''")
    raise FileNotFoundError("none of these exists: " + ", ".join(tried))


def read_variant_names(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, dbsnp) of a tab-separated list of known variants."""
    df = read_delimited(spark, path, "\t")
    return df.select(F.regexp_replace(df.columns[0], "^chr", "").alias("chrom"), F.col(df.columns[1]).cast("long").alias("pos"), F.col(df.columns[2]).alias("dbsnp"))


def read_homologs(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """((gene, human), species): two columns, the species by the first header; first of repeated genes by name."""
    df = read_delimited(spark, path, "\t")
    species = df.columns[0]
    return df.select(F.col(df.columns[0]).alias("gene"), F.col(df.columns[1]).alias("human")).groupBy("gene").agg(F.min("human").alias("human")), species


def rename_homologs(expr: DataFrame, homologs: DataFrame) -> DataFrame:
    """Genes by their human symbol; of several genes with one symbol the first by name stays."""
    one = homologs.groupBy("human").agg(F.min("gene").alias("gene"))
    return expr.join(one, "gene").drop("gene").withColumnRenamed("human", "gene")


def sample_manifest(mapping: dict[str, str] | None = None, paths: Sequence[str] | None = None, list_file: str | None = None, relative_to: str = "") -> list[tuple[str, str]]:
    """(sample, path) in order; exactly one of the three ways.  Relative paths start at ``relative_to``."""
    given = [x for x in (mapping, paths, list_file) if x]
    if len(given) != 1:
        raise ValueError("give exactly one of a mapping, paths and a list file")
    if list_file:
        with open(list_file) as f:
            paths = [s for s in map(str.strip, f) if s and s[0] != "#"]
        relative_to = relative_to or str(PurePosixPath(list_file).parent)
    pairs = list(mapping.items()) if mapping else [(PurePosixPath(p).name.split(".")[0], p) for p in paths]
    if len({n for n, _ in pairs}) != len(pairs):
        raise ValueError("two samples have one name")
    return [(n, p if "://" in p or p.startswith("/") or not relative_to else f"{relative_to}/{p}") for n, p in pairs]


def trait_manifest(name: str | None = None, path: str | None = None, config: dict[str, str] | None = None) -> dict[str, str]:
    """Trait to file: a single (name, file), or a mapping, not both."""
    if bool(config) == bool(name or path) or bool(name) != bool(path):
        raise ValueError("give a trait's name and file, or a mapping of traits")
    return dict(config) if config else {name: path}


def read_sumstats(spark: SparkSession, path: str) -> DataFrame:
    """(snp, z, n), the first of repeated SNPs in order of file and row; rows without Z or N go."""
    df = read_whitespace(spark, path).withColumn("_at", F.struct(F.input_file_name(), F.input_file_block_start(), F.monotonically_increasing_id()))
    rows = df.select(F.col("SNP").alias("snp"), F.col("Z").cast("double").alias("z"), F.col("N").cast("double").alias("n"), "_at").dropna()
    return rows.groupBy("snp").agg(F.min_by(F.struct("z", "n"), "_at").alias("r")).select("snp", "r.z", "r.n")


def unique_in_order(items: Sequence[str]) -> list[str]:
    """Items without repeats, in order of their first place."""
    return list(dict.fromkeys(items))
