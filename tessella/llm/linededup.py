"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line's set is its distinct lower-cased words.  A line goes if an earlier line (smaller key, then smaller line number)
has a Jaccard similarity of THRESHOLD or more with it, judged on the input; lines without words stay.

1. Words are counted over the whole corpus in BINS bins; a word's code is its bin's level of frequency over 56 bits of
   its hash, so that codes in ascending order run from rare to frequent.
2. Equal lines form one class with its first place.  Each class has its prefix, |s| - ceil(t |s|) + 1 rarest codes.
3. One match is enough to remove a line, so first each class is verified against a few earlier classes only: the first
   and the most repeated one of those that hold the same two neighbouring codes near the prefix's end.  Of a group of
   near-copies all but a few are decided so, by a number of checks in proportion to the lines.
4. Prefixes join on the code and a class of length, the shorter line by the 2/18 of it that can hold the first common
   word, the longer one by its whole prefix; length and positional filter (a pair must be possible if this is its first
   common word) and a parity bitmap, whose differing bits can't outnumber the differing words, and pairs whose later line
   is decided, drop out in the join's condition.
5. Surviving pairs are verified on their whole sets; the later line of each goes, and every later copy of a line.

Edge cases: null and empty texts have no lines with words; a null key comes before all others; rows of one key are
ordered by a hash of key and text, and equal such rows keep the same lines; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import few, forget, release, swept, table

BINS = 1 << 16
NO_KEY = -(1 << 63)
TENTHS = 8  # the threshold in tenths
WIDE = 16  # words over which a set has 128 bins in place of 64
SPACES = r"[\x09-\x0D\x20]+"
ENDS = 6  # pairs of neighbouring codes from the prefix's end on
PASSES = 2  # of the join of prefixes, each over its share of the codes, so that half of the rows are on disk at once
MOST = 65535  # sizes and positions are kept in 16 bits; those beyond pass the filters


def split_words(line: Column, others: str = "\t\x0b\x0c\r") -> Column:
    """A line's words between white space; by a single space, which is much faster than the pattern, where it has none of the others."""
    return F.when(reduce(Column.__or__, (F.contains(line, F.lit(c)) for c in others)), F.split(line, SPACES)).otherwise(F.split(line, " "))


def rarity(docs: DataFrame) -> Column:
    """array<tinyint>: the level of each bin, eight levels an octave of its count.  BINS values, whatever the corpus."""
    # words as written, with rarer white space in them: any order of codes is valid, rare first is fast
    words = docs.select(F.explode(F.split("text", "\n")).alias("line")).select(F.explode(split_words(F.col("line"), "\t")).alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(BINS - 1).alias("b")).count().select("b", F.least(F.floor(8 * F.log2("count")).cast("int"), F.lit(127)).alias("v"))
    levels = [0] * BINS
    for b, v in counts.collect():
        levels[b] = v
    return F.split(F.lit(",".join(map(str, levels))), ",").cast("array<tinyint>")


def coded(low: Column, levels: Column) -> Column:
    """Ascending codes of the distinct words of a line in lower case, which should be a column: Spark evaluates what
    stands under a lambda's array anew wherever it is named."""
    hashes = F.transform(F.array_remove(split_words(low), ""), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_distinct(F.transform(hashes, lambda h: F.shiftleft(F.coalesce(F.get(levels, h.bitwiseAND(BINS - 1).cast("int")), F.lit(0).cast("tinyint")).cast("bigint"), 56).bitwiseOR(h.bitwiseAND((1 << 56) - 1)))))


def flipped(a: Column, c: Column) -> Column:
    # a long shifts by the lower six bits; a hash of the code costs less than a checked cast
    return a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.hash(c)))


def bitmap(codes: Column) -> Column:
    """A parity bitmap of 64 bins: each code flips one, by bits of its hash."""
    return F.aggregate(codes, F.lit(0).cast("bigint"), flipped)


def half(codes: Column) -> Column:
    """The bitmap of the codes of which a further bit is set; with the whole one it makes 128 bins."""
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, c: F.call_function("if", c.bitwiseAND(64) == 0, a, flipped(a, c)))


def base(docs: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(k, d, text, *keep): the order of rows, a hash that tells rows of one key apart, and the text.

    k is the key; where a key comes with several texts, k is the rank of key and hash."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("k"), F.xxhash64(F.col(key), body).alias("d"), body.alias("text"), *keep)
    places = rows.select("k", "d").distinct()
    if not places.groupBy("k").count().where("count > 1").limit(1).count():
        return rows
    ranks = table(places.orderBy("k", "d").withColumn("rank", F.monotonically_increasing_id()), "ranks")
    return rows.join(ranks, ["k", "d"]).drop("k").withColumnRenamed("rank", "k")


def lines(rows: DataFrame) -> DataFrame:
    return rows.select("k", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(F.ltrim("line", F.lit("\t\x0b\x0c\r\n ")) != "")


def classes(docs: DataFrame, levels: Column) -> DataFrame:
    """(class, copies, k, no, n, m, h, prefix, ends): the first line of each class of equal lines, its bitmaps, its
    prefix, and the neighbouring codes by which it finds its first check."""
    n, t = F.size("codes"), TENTHS
    head = n - F.ceil(n * t / 10 - 1e-9).cast("int") + 1
    each = lines(docs).select("k", "no", F.xxhash64("line").alias("class"), F.lower("line").alias("low"))
    each = each.select("k", "no", "class", coded(F.col("low"), levels).alias("codes"))
    ends = F.array(*(F.hash(F.get("codes", head - 1 + i), F.get("codes", head + i)) for i in range(ENDS)))
    x = F.struct("k", "no", n.alias("n"), bitmap(F.col("codes")).alias("m"), F.when(n > WIDE, half(F.col("codes"))).otherwise(0).alias("h"), F.slice("codes", 1, head).alias("prefix"), ends.alias("ends"))
    return each.select("class", x.alias("x")).groupBy("class").agg(F.min("x").alias("x"), F.count("*").alias("copies")).select("class", "copies", "x.*")


def places(late: str, early: str) -> list[Column]:
    return [F.struct(F.col(f"{s}.k").alias("k"), F.col(f"{s}.no").cast("int").alias("no")).alias(name) for s, name in ((late, "late"), (early, "early"))]


def met_at_ends(firsts: DataFrame) -> DataFrame:
    """(code, k, no, n, m, copies): the classes by neighbouring codes that at least two of them hold."""
    keys = firsts.select(F.explode("ends").alias("code"), "k", "no", "n", "m", "copies")
    return keys.join(keys.groupBy("code").agg(F.count("*").alias("held")).where("held > 1").select("code"), "code")


def first_checks(keys: DataFrame) -> DataFrame:
    """(late, early) places: each class with the first and with the most repeated one of those that hold the same
    neighbouring codes, if it comes earlier and they can be similar."""
    t, total = TENTHS, "(a.n + b.n)"
    heads = keys.groupBy("code").agg(F.min(F.struct("k", "no", "n", "m")).alias("f"), F.max(F.struct("copies", "k", "no", "n", "m")).alias("r"), F.count("*").alias("held")).where("held > 1")
    plain = F.struct(*(F.col(f"r.{c}").alias(c) for c in ("k", "no", "n", "m")))
    heads = heads.select("code", F.explode(F.array_distinct(F.array(F.col("f"), plain))).alias("f")).select("code", "f.*")
    on = f"a.code = b.code and (a.k > b.k or (a.k = b.k and a.no > b.no)) and 10 * least(a.n, b.n) >= {t} * greatest(a.n, b.n) and {10 + t} * bit_count(a.m ^ b.m) <= {10 - t} * {total}"
    return keys.alias("a").join(heads.alias("b"), F.expr(on)).select(*places("a", "b")).distinct()


def pairs(firsts: DataFrame, decided: DataFrame, turn: int) -> DataFrame:
    """(late, early) places of two classes that pass all filters in one of PASSES, the later of them not in ``decided``."""
    t = TENTHS
    step = -2 * log(t / 10)
    grade = lambda n: F.floor(F.log(n.cast("double")) / step + 1e-9).cast("int")
    every = firsts.join(few(decided.select("late.k", "late.no").withColumn("done", F.lit(1))), ["k", "no"], "left")
    rows = every.select("k", "m", "h", F.col("no").cast("long").bitwiseOR(F.coalesce("done", F.lit(0)).cast("long") * (1 << 32)).alias("no"), F.least("n", F.lit(MOST)).alias("n"), "prefix")
    head = F.when(F.col("n") == MOST, F.size("prefix")).otherwise((F.col("n") - F.ceil(F.col("n") * 2 * t / (10 + t) - 1e-9) + 1).cast("int"))
    long = rows.select("k", "m", "h", "no", "n", F.posexplode("prefix").alias("pos", "code"), grade(F.col("n")).alias("g"))
    short = rows.select("k", "m", "h", "no", "n", F.posexplode(F.slice("prefix", 1, head)).alias("pos", "code"))
    short = short.withColumn("g", F.explode(F.sequence(grade(F.col("n")), grade(F.col("n") * 10 / t))))  # of the sets that are no more than 10 / t as long
    packed = lambda df: df.select(F.hash("code", "g").alias("code"), "k", "m", "h", F.expr("shiftleft(no, 30) | shiftleft(cast(n as bigint), 14) | least(pos, 16383)").alias("p")).where(F.pmod("code", F.lit(PASSES)) == turn)
    n = {s: f"(shiftright({s}.p, 14) & 65535)" for s in "ab"}
    no = {s: f"(shiftright({s}.p, 30) & 4294967295)" for s in "ab"}
    left = {s: f"({n[s]} - ({s}.p & 16383))" for s in "ab"}
    done = {s: f"(shiftright({s}.p, 62) & 1) = 1" for s in "ab"}
    total, a_late = f"({n['a']} + {n['b']})", f"(a.k > b.k or (a.k = b.k and {no['a']} > {no['b']}))"
    # with inter >= t / (10 + t) * total: what differs is total - 2 inter, and what is left from the common word on must hold inter
    on = (
        f"a.code = b.code and {n['b']} <= {n['a']} and ({n['b']} < {n['a']} or {a_late}) and 10 * {n['b']} >= {t} * {n['a']}"
        f" and {10 + t} * bit_count(a.m ^ b.m) <= {10 - t} * {total}"
        f" and ({n['b']} <= {WIDE} or {10 + t} * (bit_count(a.h ^ b.h) + bit_count(a.m ^ a.h ^ b.m ^ b.h)) <= {10 - t} * {total})"
        f" and ({10 + t} * least({left['a']}, {left['b']}) >= {t} * {total} or {n['a']} = {MOST})"
        f" and not (case when {a_late} then {done['a']} else {done['b']} end)"
    )
    met = packed(long).alias("a").join(packed(short).alias("b"), F.expr(on))
    met = met.select("a.k", F.expr(f"cast({no['a']} as int)").alias("no"), F.col("b.k").alias("k2"), F.expr(f"cast({no['b']} as int)").alias("no2")).distinct()
    x, y = F.struct("k", "no"), F.struct(F.col("k2").alias("k"), F.col("no2").alias("no"))
    return met.select(F.greatest(x, y).alias("late"), F.least(x, y).alias("early"))


def verified(pairs_: DataFrame, docs: DataFrame, levels: Column) -> DataFrame:
    """(late): the later places of the pairs whose whole sets are similar; places are structs (k, no)."""
    places_ = pairs_.select("late.k", "late.no").unionByName(pairs_.select("early.k", "early.no")).groupBy("k").agg(F.collect_set("no").alias("nos"))
    places_ = table(places_, "places")
    sets = docs.join(few(places_), "k").withColumn("all", F.split("text", "\n")).select("k", F.explode("nos").alias("no"), "all").select(F.struct("k", "no").alias("x"), F.lower(F.get("all", F.col("no"))).alias("low")).select("x", coded(F.col("low"), levels).alias("codes"))
    if docs.groupBy("k").count().where("count > 1").limit(1).count():  # repeated rows, whose sets are the same
        sets = sets.dropDuplicates(["x"])
    sets = table(sets, "linesets")
    both = pairs_.join(sets.select(F.col("x").alias("late"), F.col("codes").alias("c1")), "late").join(sets.select(F.col("x").alias("early"), F.col("codes").alias("c2")), "early").withColumn("common", F.size(F.array_intersect("c1", "c2")))
    late = table(both.where(f"10 * common >= {TENTHS} * (size(c1) + size(c2) - common)").select("late").distinct(), "similar")
    forget(places_, sets, pairs_)
    return late


def removed(docs: DataFrame) -> DataFrame:
    """(k, nos): the lines of each row of :func:`base` that go, by number from 0."""
    with swept(docs.sparkSession):
        return found(docs)


def found(docs: DataFrame) -> DataFrame:
    """What :func:`removed` returns; each step's shuffle files are to be gone before the next, or the disk holds several at once."""
    levels = rarity(docs)
    firsts = table(classes(docs, levels), "classes")
    release(docs.sparkSession)
    keys = table(met_at_ends(firsts), "ends")
    decided = verified(table(first_checks(keys), "pairs"), docs, levels)
    forget(keys)
    release(docs.sparkSession)
    met = []
    for turn in range(PASSES):
        met.append(table(pairs(firsts, decided, turn), "pairs"))
        release(docs.sparkSession)
    others = verified(table(reduce(DataFrame.unionByName, met).distinct(), "pairs"), docs, levels)
    forget(*met)
    release(docs.sparkSession)
    repeated = table(firsts.where("copies > 1").select("class", F.struct("k", "no").alias("f")), "repeated")
    every = lines(docs).select("k", "no", F.xxhash64("line").alias("class"))
    copies = every.join(few(repeated), "class").where(F.struct("k", "no") > F.col("f")).select("k", "no")
    similar = decided.unionByName(others).select("late.k", "late.no")
    gone = table(copies.unionByName(similar).groupBy("k").agg(F.collect_set("no").alias("nos")), "gone")
    forget(firsts, decided, others, repeated)
    return gone


def kept(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows with ``kept``, the text without the lines that go, and ``nos``, null where none goes."""
    text = F.when(F.col("nos").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("nos", i)), "\n"))
    return rows.join(few(gone), "k", "left").withColumn("kept", text)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kept, n_lines, n_removed): each row's text without the lines that go, the others joined by line feeds."""
    rows = base(docs.select(F.struct(F.col(key).cast("long").alias(key)).alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text")), "_key", "_text", ("_row",))
    out = kept(rows, removed(rows))
    return out.select(f"_row.{key}", "kept", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.coalesce(F.size("nos"), F.lit(0)).cast("long").alias("n_removed"))
