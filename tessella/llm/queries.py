"""The ten operators over whole tables, as registered in ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, fingerprint, langid, linededup, neardup, quality, secrets, suffixdedup, toxicity
from ._session import fold


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document, each distinct text scanned once against an empty ledger."""
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text")))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = toxicity.train(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return toxicity.score(docs, model)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 poor, 1 good but toxic, 2 good; ``kept`` where a grade over 0 is likelier than not."""
    docs = read(spark, sf_dir, "documents")
    grade = F.when(F.col("quality") == 0, 0).otherwise(2 - F.coalesce("toxic", F.lit(0)))
    labels = read(spark, sf_dir, "labels").where(F.col("quality").isNotNull() & (fold(F.col("doc_id"), 5) != 0)).select("doc_id", grade.alias("grade"))
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "expected_grade", F.col("tail").alias("score"), (F.col("tail") >= 0.5).cast("int").alias("predicted"), (F.col("tail") >= 0.5).alias("kept"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.versions(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold(F.col("doc_id"), 4) != 2))
    scored = langid.predict(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    return decontam.contaminated(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


def bpe_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), *bpe_vocabulary(), digests=True)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def secrets_sql() -> str:
    """The spans by gaps and matches, in DuckDB."""
    parts = []
    for o, r in enumerate(secrets.RULES):
        pattern = "'" + r.pattern.replace("'", "''") + "'"
        parts.append(
            f"SELECT doc_id, {o} AS o, '{r.name}' AS name, {r.least} AS least, regexp_extract_all(t, {pattern}, 0) AS m, regexp_extract_all(t, {pattern}, {r.group}) AS v, regexp_split_to_array(t, {pattern}) AS g FROM d WHERE regexp_matches(t, {pattern})"
        )
    base = [r.name for r in secrets.RULES if r.base]
    named = ", ".join(f"'{n}'" for n in base)
    counts = ", ".join(f"count(*) FILTER (WHERE name = '{n}') AS n_{n}" for n in base)
    zero = ", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in base)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(parts)}), i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f),
    e AS (SELECT doc_id, o, name, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a, length(m[i]) AS n FROM i WHERE length(v[i]) >= least),
    s AS (SELECT doc_id, {counts}, string_agg(name || ':' || a || ':' || a + n, ',' ORDER BY a, o) FILTER (WHERE name IN ({named})) AS base, string_agg(name || ':' || a || ':' || a + n, ',' ORDER BY a, o) AS spans FROM e GROUP BY doc_id)
    SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (doc_id)"""


#: Line classes by text, their sets by prefixes of the rarest words, and the lines with an earlier similar one.
LINES_SQL = r"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM d),
    l AS (SELECT * FROM e WHERE regexp_matches(line, '[^\x09-\x0D\x20]')), c AS (SELECT line, min(ROW(doc_id, no)) AS f FROM l GROUP BY line),
    w AS (SELECT DISTINCT f, w FROM (SELECT f, unnest(regexp_split_to_array(lower(line), '[\x09-\x0D\x20]+')) AS w FROM c) WHERE w <> ''), r AS (SELECT w, count(*) AS k FROM w GROUP BY w),
    s AS (SELECT f, list(w ORDER BY k, w) AS ws, count(*) AS n FROM w JOIN r USING (w) GROUP BY f),
    p AS (SELECT f, n, unnest(ws[1:(n - ceil(0.8 * n - 1e-9) + 1)::INT]) AS w FROM s),
    q AS (SELECT DISTINCT a.f AS early, b.f AS late FROM p a JOIN p b ON a.w = b.w AND a.f < b.f AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)),
    m AS (SELECT early, late, len(list_intersect(a.ws, b.ws)) AS i, a.n + b.n AS t FROM q JOIN s a ON a.f = early JOIN s b ON b.f = late),
    g AS (SELECT l.doc_id, list(l.no) AS gone FROM l JOIN c USING (line) WHERE ROW(l.doc_id, l.no) > c.f OR c.f IN (SELECT late FROM m WHERE 10 * i >= 8 * (t - i)) GROUP BY l.doc_id)
    SELECT doc_id, len(ls)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
    sha256(array_to_string(list_filter(ls, lambda x, i: NOT coalesce(list_contains(gone, i), false)), chr(10))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""

#: Windows of 100 bytes, as hexadecimal digits, that come earlier; their union, and what is left.
REPEATS_SQL = r"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), b AS (SELECT doc_id, x, strlen(x) // 2 AS n FROM d),
    g AS (SELECT doc_id, p, hash(substr(x, 2 * p + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS p FROM b WHERE n >= 100)),
    r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM g) WHERE k > 1),
    t AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM r),
    i AS (SELECT doc_id, min(p) AS lo, max(p) + 100 AS hi FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM t) GROUP BY doc_id, k),
    v AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before FROM i),
    j AS (SELECT v.doc_id, sum(hi - lo) AS gone, count(*) AS spans, max(hi) AS last, string_agg(substr(x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept FROM v JOIN b USING (doc_id) GROUP BY v.doc_id)
    SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept || substr(x, 2 * last + 1), x))) AS kept_sha256 FROM b LEFT JOIN j USING (doc_id)"""

#: Classes of equal shingle sets, links by prefixes of the rarest shingles, and all that a class reaches.
NEAR_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    h AS (SELECT DISTINCT doc_id, hash(CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i + 4] END) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
    k AS (SELECT h, count(*) AS k FROM h GROUP BY h), s AS (SELECT doc_id, list(h ORDER BY k, h) AS hs, count(*) AS n FROM h JOIN k USING (h) GROUP BY doc_id),
    c AS (SELECT hs, n, min(doc_id) AS rep FROM s GROUP BY hs, n), p AS (SELECT rep, n, unnest(hs[1:(n - ceil(0.85 * n - 1e-9) + 1)::INT]) AS h FROM c),
    q AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.h = b.h AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
    m AS (SELECT a, b, len(list_intersect(x.hs, y.hs)) AS i, x.n + y.n AS t FROM q JOIN c x ON x.rep = a JOIN c y ON y.rep = b), e AS (SELECT a, b FROM m WHERE 100 * i >= 85 * (t - i)),
    u AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e), z AS (SELECT x, y FROM u UNION SELECT z.x, u.y FROM z JOIN u ON z.y = u.x), o AS (SELECT x, min(y) AS y FROM z GROUP BY x)
    SELECT doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(least(c.rep, o.y), c.rep, doc_id)::BIGINT AS component_id, doc_id = coalesce(least(c.rep, o.y), c.rep, doc_id) AS kept
    FROM d LEFT JOIN s USING (doc_id) LEFT JOIN c ON c.hs = s.hs AND c.n = s.n LEFT JOIN o ON o.x = c.rep"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_toxicity, op3_quality, op4_line_dedup, op5_suffix_dedup, op6_fingerprints, op7_language_id, op8_decontamination, op9_byte_bpe, op10_minhash_near_dedup)}
ORACLES: dict[str, str] = {"op1_secret_scan": secrets_sql(), "op4_line_dedup": LINES_SQL, "op5_suffix_dedup": REPEATS_SQL, "op10_minhash_near_dedup": NEAR_SQL}
