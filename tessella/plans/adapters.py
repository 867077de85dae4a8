"""Domain tables as views over the star schema, each as one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

VIEWS = {
    "spots": """SELECT event_id AS spot, event_type AS annotation, CAST(user_id % 4 AS STRING) AS sample, value,
        CAST((event_id * 7919) % 99991 + 1 AS DOUBLE) / CAST(99993 AS DOUBLE) AS p,
        -log10(CAST((event_id * 7919) % 99991 + 1 AS DOUBLE) / CAST(99993 AS DOUBLE)) AS x FROM events""",
    "expr": """SELECT l_orderkey AS cell, p_brand AS gene, CAST(sum(l_quantity) AS DOUBLE) AS value
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_brand""",
    "sumstats": """SELECT concat('rs', CAST(o_orderkey AS STRING)) AS SNP, o_custkey % 22 + 1 AS CHR, o_orderkey AS POS, o_totalprice AS N,
        (o_totalprice - CAST(200000 AS DOUBLE)) / CAST(100000 AS DOUBLE) AS BETA, CAST(0.517 AS DOUBLE) + CAST(o_custkey % 7 AS DOUBLE) / CAST(9.7 AS DOUBLE) AS SE,
        CASE o_orderstatus WHEN 'F' THEN 'a' WHEN 'O' THEN 'C' ELSE 'G' END AS A1,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'T' WHEN '2' THEN 'G' WHEN '3' THEN 'A' ELSE 'C' END AS A2,
        CAST(80 + o_orderkey % 20 AS DOUBLE) / CAST(100 AS DOUBLE) AS INFO, CAST((o_orderkey * 31) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS FRQ,
        CAST((o_orderkey * 7919) % 99991 AS DOUBLE) / CAST(99993 AS DOUBLE) AS P FROM orders""",
    "points": "SELECT concat('rs', CAST(o_orderkey AS STRING)) AS snp, CAST(o_custkey % 22 + 1 AS STRING) AS chrom, o_orderkey AS pos FROM orders",
    "features": """SELECT CAST(p_partkey % 22 + 1 AS STRING) AS f_chrom, p_partkey * 7 AS start, p_partkey * 7 + p_size AS stop, concat('g', CAST(p_partkey AS STRING)) AS feature,
        p_retailprice AS score, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part""",
    "cells": """SELECT c_custkey AS cell, c_acctbal AS x, CAST(c_custkey AS DOUBLE) * CAST(3.5 AS DOUBLE) AS y, c_nationkey AS slice, c_mktsegment AS annotation,
        CAST(c_custkey % 40 AS INT) AS n_genes FROM customer""",
    "weights": """SELECT concat('rs', CAST(l_orderkey AS STRING)) AS snp, CASE WHEN p_brand = 'Brand#11' THEN 'Unmapped' ELSE p_brand END AS feature, CAST(sum(l_quantity) / 50 AS DOUBLE) AS w
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "scores": """SELECT l_suppkey % 8 AS cell, p_brand AS gene, CAST(avg(l_discount) AS DOUBLE) AS score
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey % 8, p_brand""",
    "geno": """SELECT p_brand AS snp, l_suppkey AS sample, CAST(count(*) % 3 AS DOUBLE) AS dosage
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, l_suppkey""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of :data:`VIEWS`, or a table, read from ``sf_dir``; no global name is used."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return sql(spark, sf_dir, VIEWS[name])


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {t: view(spark, sf_dir, t) for t in (*TABLES, *VIEWS) if _uses(text, t) and VIEWS.get(t) != text}
    return spark.sql(_marked(text, used), **used)


def _uses(text: str, table: str) -> bool:
    import re

    return bool(re.search(rf"\b(FROM|JOIN)\s+{table}\b", text))


def _marked(text: str, used: dict[str, DataFrame]) -> str:
    import re

    for t in used:
        text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", text)
    return text


def with_views(text: str) -> str:
    """Oracle SQL: the views that the text names, as common table expressions in front of it."""
    need: dict[str, str] = {}

    def add(t: str) -> None:
        for name, body in VIEWS.items():
            if _uses(t, name) and name not in need:
                add(body)
                need[name] = body

    add(text)
    if not need:
        return text
    head = ", ".join(f"{n} AS ({b})" for n, b in need.items())
    body = text.lstrip()
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
