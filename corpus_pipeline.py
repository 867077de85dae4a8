"""A training corpus from raw documents: toxicity, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of ``documents``.
A stage's result is written as Parquet and reread as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, decontam, linededup, neardup, toxicity
from tessella.llm._session import few, fold, table
from tessella.llm.queries import bpe_vocabulary, read
from tessella.operators.relational import dedup_first


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is under 0.5; the score is learned from the labels of the training folds.

    Null and empty texts score as clean words and stay; repeated rows and ties score alike; without labels all stay."""
    labels = read(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    model = toxicity.train(docs, labels)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")  # whatever else the rows hold, no name can clash
    return toxicity.score(rows, model, keep=("_row",)).where("score < 0.5").select("_row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines; a document of which nothing but white space is left goes.

    Null texts, and texts that lose no line, stay as they are; a null doc_id comes before all others."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_key"), F.col("text").alias("_text"))
    rows = linededup.base(packed, "_key", "_text", ("_row",))
    out = linededup.kept(rows, linededup.removed(rows))
    none = F.col("nos").isNull()
    out = out.where(none | F.col("kept").rlike(r"[^\x09-\x0D\x20]"))
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*(F.when(none, F.col(f"_row.{c}")).otherwise(changed[c]).alias(c) if c in changed else F.col(f"_row.{c}").alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least doc_id of each group of near-duplicates; of rows of equal doc_id and text, one.

    Texts without words, and rows of a null doc_id, are linked with nothing and stay."""
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        return drop_repeated_ids(docs)
    found = table(neardup.near_duplicates(docs, hundredths=80).where("not kept").select("doc_id").distinct(), "duplicates")
    return docs.join(few(found), "doc_id", "left_anti")


def drop_repeated_ids(docs: DataFrame) -> DataFrame:
    """Near-duplicates where a doc_id has several texts: each of them is a node, and a group's least is by doc_id."""
    node = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    rows = docs.where("doc_id IS NOT NULL").select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", node.alias("_node"))
    nodes = table(dedup_first(rows, ["_node"], [F.col("text").isNull(), F.xxhash64("_row")]), "nodes")
    groups = table(neardup.near_duplicates(nodes, key="_node", hundredths=80).select("_node", "component_id"), "groups")
    first = nodes.select("_node", "doc_id").join(groups, "_node").groupBy("component_id").agg(F.min(F.struct("doc_id", "_node"))["_node"].alias("_node"))
    return nodes.join(first, "_node", "left_semi").select("_row.*").unionByName(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.  Rows are judged by their own text, whatever their doc_id, null or shared;
    null and empty texts hold nothing and stay; without items all stay."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("_key"), F.col("text").alias("_text"))
    found = decontam.contaminated(rows, read(spark, sf_dir, "benchmark"), key="_key", text="_text")
    found = table(found.select("_key").distinct(), "contaminated")
    return rows.join(few(found), "_key", "left_anti").select("_row.*")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digest of their decoding, which equals the text's; null and empty texts have no ids."""
    out = bpe.encode(docs, *bpe_vocabulary(), keep=("doc_id", "lang", "source"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", to_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
