"""Sinks: compressed text, Parquet, JSON for a web page; writes that are skipped where a finished result is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame], **options: str) -> DataFrame:
    """The Parquet table at ``path``, made first if it isn't finished there."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").options(**options).parquet(path)
    return spark.read.parquet(path)


def write_text(df: DataFrame, path: str, sep: str = "\t", digits: int | None = None, mode: str = "overwrite") -> None:
    """Gzip-compressed delimited text; floating columns with fixed digits if given."""
    if digits is not None:
        df = df.withColumns({c: F.format_string(f"%.{digits}f", F.col(c)) for c, t in df.dtypes if t in ("float", "double")})
    df.write.mode(mode).option("sep", sep).option("header", True).option("compression", "gzip").csv(path)


def write_table(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def columnar_json(df: DataFrame, by: str | None = None, digits: int | None = None) -> DataFrame:
    """One JSON object of columns for the table, or for each value of ``by``; rows in order of the first column.

    For report-sized tables: a group's rows meet in one value."""
    cols = [c for c in df.columns if c != by]
    if digits is not None:
        df = df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t in ("float", "double")})
    rows = F.array_sort(F.collect_list(F.struct(*cols)))
    grouped = df.groupBy(by).agg(rows.alias("r")) if by else df.agg(rows.alias("r"))
    return grouped.select(*([by] if by else []), F.to_json(F.struct(*(F.col(f"r.`{c}`").alias(c) for c in cols))).alias("json"))


def write_script(df: DataFrame, path: str, variable: str, by: str | None = None, digits: int | None = None) -> None:
    """Text files that set window.<variable> (with ``by``, one entry for each value) to the columnar JSON."""
    out = columnar_json(df, by, digits)
    safe = F.regexp_replace(F.col(by).cast("string"), "[^0-9A-Za-z]", "_") if by else None
    target = F.concat(F.lit(f"window.{variable}['"), safe, F.lit("'] = ")) if by else F.lit(f"window.{variable} = ")
    out.select(F.concat(target, "json", F.lit(";")).alias("value")).write.mode("overwrite").text(path)
