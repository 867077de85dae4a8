"""Incremental secret scans over a blob ledger, in DataFrame functions only.

Every version of every path is content-addressed by the SHA-256 of its text.  The ledger holds the (blob, rule, rule
version) pairs that were scanned already; texts meet the other pairs first, so that only those are scanned, each blob
once, and their findings and those kept beside the ledger join back to all paths that hold the blob.  Spans are code points, end exclusive; matches are leftmost and do not overlap within a rule.

Edge cases: a null text is an empty one; equal texts share one blob; repeated keys, null keys and further columns
are allowed (paths keep every row); an empty table gives empty results.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._session import few, table


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    base: bool = True


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


WORDS = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), f"{either_case('api')}_?{either_case('key')}"])
RULES = (
    Rule("assign", rf"""({WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]{32,}", 0, 32),  # the runs of 32 or more are the maximal runs that are long enough
    Rule("private", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, base=False),
)


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, stop, rule>> of a rule's matches, from the gaps between them."""
    found, value, gaps = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.split(text, rule.pattern, -1)
    parts = F.transform(F.arrays_zip(gaps.alias("g"), found.alias("m"), value.alias("v")), lambda x: F.struct(F.length(x["g"]).alias("g"), F.coalesce(F.length(x["m"]), F.lit(0)).alias("m"), F.coalesce(F.length(x["v"]), F.lit(-1)).alias("v")))
    none = F.array().cast("array<struct<start:int,stop:int,v:int>>")
    placed = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda s, x: F.struct((s["at"] + x["g"] + x["m"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["g"]).alias("start"), (s["at"] + x["g"] + x["m"]).alias("stop"), x["v"].alias("v")))).alias("out")))["out"]
    kept = F.filter(placed, lambda x: x["v"] >= rule.least)
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.lit(rule.name).alias("rule")))


@dataclass(frozen=True)
class Scan:
    paths: DataFrame  #: key, blob: every row of the input
    findings: DataFrame  #: blob, rule, version, spans: of newly scanned pairs that have some, and the earlier ones of these rules
    ledger: DataFrame  #: blob, rule, version: the pairs scanned now
    scanned: DataFrame  #: blob: the texts that the rules read now


def scan(versions: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, earlier: DataFrame | None = None) -> Scan:
    """Scans the blobs of ``versions`` for the rules that the ledger doesn't have for them yet.

    earlier: the findings kept beside the ledger; without them known blobs have none here."""
    body = F.coalesce(F.col(text), F.lit(""))
    paths = versions.select(F.col(key).alias("key"), F.sha2(body, 256).alias("blob"))
    one = paths.groupBy("blob").agg(F.min(F.xxhash64("key")).alias("rep"))  # a null key has a hash too
    known = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", F.col("version").cast("int").alias("version"))).alias("_seen"))
        one = one.join(seen, "blob", "left").withColumn("todo", F.array_except(known, F.coalesce("_seen", F.array().cast("array<struct<rule:string,version:int>>")))).where(F.size("todo") > 0)
    else:
        one = one.withColumn("todo", known)
    pairs = one.select("blob", F.explode("todo").alias("x")).select("blob", "x.rule", "x.version")
    # Texts meet the unseen pairs first, by the key of a representative, which is spread evenly whatever the number of copies.
    todo = few(table(one.select("rep", "blob", "todo"), "todo"))
    fresh = versions.select(F.xxhash64(F.col(key)).alias("rep"), body.alias("text")).join(todo, "rep").where(F.sha2("text", 256) == F.col("blob"))
    due = {r: F.array_contains("todo", F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"))) for r in rules}
    holds = lambda r: F.expr(f"text rlike {_sql(r.pattern)}")
    some = fresh.where(reduce(Column.__or__, (due[r] & holds(r) for r in rules)))
    each = some.select("blob", F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.when(due[r], spans(F.col("text"), r)).alias("spans")) for r in rules))).alias("x"))
    findings = each.select("blob", "x.rule", "x.version", "x.spans").where(F.size("spans") > 0).dropDuplicates(["blob", "rule", "version"])
    if earlier is not None:
        old = earlier.select("blob", "rule", F.col("version").cast("int").alias("version"), "spans")
        findings = findings.unionByName(old.where(F.array_contains(known, F.struct("rule", "version")))).dropDuplicates(["blob", "rule", "version"])
    return Scan(paths, findings, pairs, fresh.select("blob"))


def record(found: Scan, folder: str) -> None:
    """Adds what a scan has found to the ledger's tables in ``folder``, shared by all machines: findings first, so that a
    run that breaks off in between is repeated rather than lost."""
    found.findings.write.mode("append").parquet(f"{folder}/findings")
    found.ledger.write.mode("append").parquet(f"{folder}/ledger")


def recorded(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(ledger, findings) of all scans recorded there; a finding recorded twice counts once."""
    found = spark.read.parquet(f"{folder}/findings").dropDuplicates(["blob", "rule", "version"])
    return spark.read.parquet(f"{folder}/ledger").distinct(), found


def _sql(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def digest(found: Scan, key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings joined back to every path: counts of the base rules, and spans as text."""
    order = {r.name: i for i, r in enumerate(rules)}
    place = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    base = [r.name for r in rules if r.base]
    rows = found.findings.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("s"))
    rows = rows.select("blob", F.array_sort(F.transform("s", lambda x: F.struct(x["start"].alias("start"), place[x["rule"]].alias("o"), x["stop"].alias("stop"), x["rule"].alias("rule")))).alias("s"))
    said = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["rule"], x["start"], x["stop"])), ",")
    count = lambda n: F.size(F.filter("s", lambda x: x["rule"] == n)).cast("long")
    rows = rows.select("blob", *(count(n).alias(f"n_{n}") for n in base), said(F.filter("s", lambda x: x["rule"].isin(base))).alias("base"), said(F.col("s")).alias("spans"))
    rows = table(rows, "findings")  # from here both sides of the join are plain shuffles, of which hot blobs can be split
    out = found.paths.join(rows, "blob", "left")
    return out.select(F.col("key").alias(key), *(F.coalesce(f"n_{n}", F.lit(0).cast("long")).alias(f"n_{n}") for n in base), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
