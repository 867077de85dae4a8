"""Relational building blocks: ordered dedup and top-k, blocks, range and nearest joins, sampling, multiple testing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import exprs as E

Order = str | Column


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[Order]) -> DataFrame:
    """The first row of each key in the given order; partial aggregation reduces hot keys before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order]))
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, *(F.col(f"_r.`{c}`").alias(c) for c in rest)).select(*df.columns)


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Order], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each group; Spark prunes each map task's groups to k before the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def row_index(df: DataFrame, key: str, order: Sequence[Order] = (), name: str = "row_idx", buckets: int | None = None) -> DataFrame:
    """Consecutive numbers from 0 in order of a numeric key, then ``order``.

    Quantiles of the key deal rows into ranges, a window numbers each range, and the ranges' counts, one row each,
    shift them; no task sees more than its range."""
    n = buckets or min(1024, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 10_000)).head()[0] or []
    bounds = F.array(*(F.lit(c) for c in sorted(set(cuts)))) if cuts else F.array(F.lit(0))
    dealt = df.withColumn("_b", F.size(F.filter(bounds, lambda x: x <= F.col(key))) if cuts else F.lit(0))
    counts = sorted((b, c) for b, c in dealt.groupBy("_b").count().collect())
    total, start = 0, []
    for b, c in counts:
        start += [F.lit(b), F.lit(total)]
        total += c
    offset = F.create_map(*start)[F.col("_b")] if start else F.lit(0)
    w = Window.partitionBy("_b").orderBy(key, *order)
    return dealt.withColumn(name, (F.row_number().over(w) - 1 + offset).cast("long")).drop("_b")


def assign_blocks(df: DataFrame, n_blocks: int, index: str = "row_idx", rows: int | None = None, name: str = "block") -> DataFrame:
    """Keeps the first floor(n / B) * B rows of an indexed table and numbers its B equal blocks."""
    n = df.count() if rows is None else rows
    size = n // n_blocks
    return df.where(F.col(index) < size * n_blocks).withColumn(name, F.expr(f"cast({index} div {max(1, size)} as int)"))


def fixed_batches(df: DataFrame, size: int, index: str = "row_idx", name: str = "batch") -> DataFrame:
    return df.withColumn(name, F.expr(f"cast({index} div {size} as int)"))


def overlap_join(points: DataFrame, features: DataFrame, window: int = 0, bin_size: int = 50_000, chrom: str = "chrom", pos: str = "pos", f_chrom: str = "f_chrom", start: str = "start", end: str = "stop") -> DataFrame:
    """Points [pos, pos + 1) that overlap features [max(0, start - window), stop + window): an equi-join on (chromosome, bin).

    A point has one bin and a feature all of those that it touches, so no pair comes twice whatever the bin size."""
    lo, hi = F.greatest(F.lit(0), F.col(start) - window), F.col(end) + window
    left = points.withColumn("_bin", F.expr(f"{pos} div {bin_size}"))
    right = features.withColumn("_lo", lo).withColumn("_hi", hi).where("_hi > _lo").withColumn("_fbin", F.explode(F.sequence(F.expr(f"_lo div {bin_size}"), F.expr(f"(_hi - 1) div {bin_size}"))))
    on = (F.col(chrom) == F.col(f_chrom)) & (F.col("_bin") == F.col("_fbin")) & (F.col(pos) >= F.col("_lo")) & (F.col(pos) < F.col("_hi"))
    return left.join(right, on).drop("_bin", "_fbin", "_lo", "_hi")


STRATEGIES = ("score", "tss", "center", "allow_repeat")


def map_features(points: DataFrame, features: DataFrame, strategy: str = "score", window: int = 0, bin_size: int = 50_000, point: str = "snp", feature: str = "feature", score: str = "score", strand: str = "strand") -> DataFrame:
    """Pairs (point, feature, weight): every overlap, or the best one of each point; points without one go to 'Unmapped'.

    score: the largest score; tss, center: the nearest start of transcription or centre; ties go to the first feature by name."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    pairs = overlap_join(points, features, window, bin_size)
    if strategy != "allow_repeat":
        at = {"score": f"-{score}", "tss": f"abs(pos - {E.tss('start', 'stop', strand)})", "center": f"abs(pos - {E.centre('start', 'stop')})"}[strategy]
        pairs = pairs.groupBy(point).agg(F.min_by(feature, F.struct(F.expr(at), F.col(feature))).alias(feature))
    pairs = pairs.select(point, feature, F.lit(1.0).alias("weight"))
    missing = points.select(point).join(pairs.select(point), point, "left_anti").select(point, F.lit("Unmapped").alias(feature), F.lit(1.0).alias("weight"))
    return pairs.unionByName(missing)


def band_batches(targets: DataFrame, size: int, wind: float, chrom: str = "chrom", pos: str = "pos", index: str = "row_idx") -> DataFrame:
    """(chrom, batch, lo, hi): windows of batches of consecutive targets of a chromosome, from the batch's least position
    less ``wind`` to its greatest plus it."""
    return fixed_batches(targets, size, index).groupBy(chrom, "batch").agg((F.min(pos) - wind).alias("lo"), (F.max(pos) + wind).alias("hi"))


def band_join(targets: DataFrame, variants: DataFrame, batches: DataFrame, bin_size: float, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """Each batch with the variants inside its window, by an equi-join on (chromosome, bin)."""
    spans = batches.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("lo") / bin_size), F.floor(F.col("hi") / bin_size))))
    v = variants.withColumn("_bin", F.floor(F.col(pos) / bin_size))
    return v.join(spans, [chrom, "_bin"]).where((F.col(pos) >= F.col("lo")) & (F.col(pos) <= F.col("hi"))).drop("_bin")


IN_MEMORY = 1_000_000  # rows of a group whose quantiles one task's memory holds
NARROW = 20_000  # rows of a group of which all are ranked
MARGIN = 0.0005  # on either side of a quantile, five times the sketch's error


def in_memory(df: DataFrame, by: Sequence[str]) -> bool:
    """Whether a task's memory holds any group's values."""
    return (df.groupBy(*by).count().agg(F.max("count")).head()[0] or 0) <= IN_MEMORY


def quantiles(df: DataFrame, value: str, by: Sequence[str], ps: Sequence[float], name: str = "_q") -> DataFrame:
    """(by, name): exact quantiles of each group, interpolated between neighbours; nulls don't count.

    Where a group may not fit in a task's memory, a sketch brackets each quantile, a count of what is below the bracket and
    the ranks of the distinct values inside it give the exact neighbours."""
    keys = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*(keys or [F.lit(1).alias("_all")]), F.col(value).cast("double").alias("_v"))
    group = keys or ["_all"]
    if in_memory(rows, group):
        q = F.expr(f"percentile(_v, array({', '.join(f'{float(p)!r}D' for p in ps)}))").alias(name)
        return rows.groupBy(*keys).agg(q)
    n = len(ps)
    asked = [x for p in ps for x in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    whole = F.col("_n") <= NARROW
    marks = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", asked, 10_000).alias("_a"))
    marks = marks.select(*group, "_n", *(F.when(whole, F.lit(sign * float("inf"))).otherwise(F.col("_a")[2 * i + j]).alias(f"_{side}{i}") for i in range(n) for j, (side, sign) in enumerate((("lo", -1), ("hi", 1)))))
    near = rows.join(marks, group)
    below = near.groupBy(*group).agg(F.first("_n").alias("_n"), *(F.count_if(F.col("_v") < F.col(f"_lo{i}")).alias(f"_b{i}") for i in range(n)))
    inside = near.select(*group, "_v", F.explode(F.array(*(F.when(F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")), F.lit(i)) for i in range(n)))).alias("_i")).where("_i IS NOT NULL")
    w = Window.partitionBy(*group, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.groupBy(*group, "_i", "_v").count().withColumn("_to", F.sum("count").over(w)).join(below, group)
    at = [F.lit(float(p)) * (F.col("_n") - 1) for p in ps]
    holds = lambda i, x: (F.col("_i") == i) & (x >= F.col(f"_b{i}") + F.col("_to") - F.col("count")) & (x < F.col(f"_b{i}") + F.col("_to"))
    ends = [F.max(F.when(holds(i, f(at[i])), F.col("_v"))).alias(f"_{side}{i}") for i in range(n) for side, f in (("l", F.floor), ("h", F.ceil))]
    found = ranked.groupBy(*group).agg(F.first("_n").alias("_n"), *ends)
    pick = [F.when(F.col(f"_l{i}") == F.col(f"_h{i}"), F.col(f"_l{i}")).otherwise((F.ceil(at[i]) - at[i]) * F.col(f"_l{i}") + (at[i] - F.floor(at[i])) * F.col(f"_h{i}")) for i in range(n)]
    return found.select(*keys, F.array(*pick).alias(name))


def nway_join(tables: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """Inner join of many (key, value) tables, a column each: a union and one aggregation in place of a chain of joins."""
    names = list(tables)
    every = reduce(DataFrame.unionByName, (df.select(key, F.lit(n).alias("_t"), F.col(value).alias("_v")) for n, df in tables.items()))
    wide = every.groupBy(key).agg(F.countDistinct("_t").alias("_n"), *(F.max(F.when(F.col("_t") == n, F.col("_v"))).alias(n) for n in names))
    return wide.where(F.col("_n") == len(names)).drop("_n")


def ordered_intersection(left: DataFrame, others: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of ``left`` whose key all others have; the left's order columns stay as they are."""
    return reduce(lambda df, o: df.join(o.select(key).distinct(), key, "left_semi"), others, left)


def align_fill(panel: DataFrame, values: DataFrame, key: str, fill: float = 0.0) -> DataFrame:
    """``values`` on every key of ``panel``, missing ones filled."""
    cols = [c for c in values.columns if c != key]
    return panel.select(key).join(values, key, "left").select(key, *(F.coalesce(c, F.lit(fill)).alias(c) for c in cols))


def union_all(tables: Sequence[DataFrame], fill: float | None = None) -> DataFrame:
    """Rows of all tables; with ``fill`` columns that a table lacks are filled, else all must agree."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill is not None), tables)
    return out if fill is None else out.fillna(fill)


def common_columns(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables with the columns that all have."""
    names = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
    return union_all([t.select(*names) for t in tables])


def bh_fdr(df: DataFrame, p: str, by: Sequence[str], alpha: float = 0.001) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values ``q`` and ``rejected`` within each group.

    Ranks go over distinct p-values, whose counts are pre-aggregated, so equal values cost one row each."""
    counts = df.groupBy(*by, p).count()
    group = Window.partitionBy(*by)
    up = group.orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    down = group.orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_rank", F.sum("count").over(up)).withColumn("_n", F.sum("count").over(group))
    q = ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_rank")).over(down))).select(*by, p, "q")
    return df.join(q, [*by, p]).withColumn("rejected", F.col("q") <= alpha)


def bonferroni(df: DataFrame, p: str, by: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """(n, threshold, n_significant) of each group: p < alpha / n."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return df.join(counts, list(by)).groupBy(*by).agg(F.first("n").alias("n"), (F.lit(alpha) / F.first("n")).alias("threshold"), F.count_if(F.col(p) < F.lit(alpha) / F.col("n")).alias("n_significant"))


def stratified_sample(df: DataFrame, by: str, key: str, n: int, seed: int = 42, at_least: int = 1, ceil: bool = True) -> DataFrame:
    """About n rows: each stratum gives max(at_least, n * its share) by order of a seeded hash, rounded up and then trimmed to
    n in all, or rounded down."""
    counts = df.groupBy(by).count()
    total = df.count()
    share = F.lit(n) * F.col("count") / total
    quota = counts.withColumn("_quota", F.greatest(F.lit(at_least), (F.ceil(share) if ceil else F.floor(share)).cast("long"))).select(by, "_quota")
    most = quota.agg(F.max("_quota")).head()[0] or 0  # a constant bound, so that each map task sends on no more rows of a stratum
    w = Window.partitionBy(by).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    out = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).join(F.broadcast(quota) if quota.count() <= 100_000 else quota, by).where("_n <= _quota").drop("_quota")
    if not ceil:
        return out.drop("_n")
    # each stratum's first row comes before any second one, so that a trim empties none while n lasts
    return out.orderBy(F.col("_n") > at_least, F.xxhash64(F.col(key), F.lit(seed + 1)), key).limit(n).drop("_n")


def cumulative_position(df: DataFrame, chrom: str = "chrom", pos: str = "pos", name: str = "cum_pos", order: Sequence[Order] = ()) -> DataFrame:
    """Positions shifted by the last positions of all earlier chromosomes; one row a chromosome is gathered.

    A chromosome's last position is that of its last row in ``order``, by default in order of position."""
    last = df.groupBy(chrom).agg(F.max_by(pos, F.struct(*(F.col(o) if isinstance(o, str) else o for o in order))).alias("_last") if order else F.max(pos).alias("_last"))
    w = Window.orderBy(chrom).rowsBetween(Window.unboundedPreceding, -1)
    offset = last.withColumn("_offset", F.coalesce(F.sum("_last").over(w), F.lit(0))).select(chrom, "_offset")
    return df.join(F.broadcast(offset), chrom).withColumn(name, F.col(pos) + F.col("_offset")).drop("_offset")


def make_unique(df: DataFrame, name: str, order: Sequence[Order], sep: str = "-") -> DataFrame:
    """Repeated names get a numbered suffix in the given order; the first stays."""
    i = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    return df.withColumn("_i", i).withColumn(name, F.when(F.col("_i") > 0, F.concat_ws(sep, name, "_i")).otherwise(F.col(name))).drop("_i")


def row_slice(df: DataFrame, start: int, end: int | None, index: str = "row_idx") -> DataFrame:
    """Rows [start, end) of an indexed table; bounds beyond the table clamp."""
    if start < 0 or (end is not None and end < start):
        raise ValueError("0 <= start <= end is needed")
    return df.where((F.col(index) >= start) & (F.lit(True) if end is None else F.col(index) < end))


def pseudo_z(df: DataFrame, sample: str, samples: Sequence[str], span: float, name: str = "z") -> DataFrame:
    """span * i / (n - 1) for the i-th of n samples of the manifest."""
    n = max(1, len(samples) - 1)
    at = F.create_map(*(x for i, s in enumerate(samples) for x in (F.lit(s), F.lit(span * i / n))))
    return df.withColumn(name, at[F.col(sample)])


def null_label(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("NaN")))
