"""Cleaning of association summary statistics: names, derived columns, quality filters, identifiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import exprs as E
from tessella.operators.relational import dedup_first, quantiles

# Header spellings and the columns that they stand for.
SYNONYMS = {
    "SNP": ("SNP", "RS", "RSID", "RS_NUMBER", "RS_NUMBERS", "MARKERNAME", "SNPID"),
    "CHR": ("CHR", "CHROM", "CHROMOSOME", "HG18CHR"),
    "POS": ("POS", "BP", "BASE_PAIR_LOCATION", "POSITION"),
    "P": ("P", "PVALUE", "P_VALUE", "PVAL", "P_VAL", "GC_PVALUE"),
    "A1": ("A1", "ALLELE1", "ALLELE_1", "EFFECT_ALLELE", "REFERENCE_ALLELE", "INC_ALLELE", "EA"),
    "A2": ("A2", "ALLELE2", "ALLELE_2", "OTHER_ALLELE", "NON_EFFECT_ALLELE", "DEC_ALLELE", "NEA"),
    "N": ("N", "WEIGHT", "TOTAL_N", "SAMPLE_SIZE"),
    "N_CAS": ("N_CAS", "NCASE", "CASES_N", "N_CASE", "N_CASES"),
    "N_CON": ("N_CON", "NCONTROL", "CONTROLS_N", "N_CONTROL", "N_CONTROLS"),
    "LOG_ODDS": ("LOG_ODDS",),
    "BETA": ("BETA", "B", "EFFECT", "EFFECTS", "EFFECT_SIZE"),
    "SE": ("SE", "STANDARD_ERROR"),
    "OR": ("OR", "ODDS_RATIO"),
    "SE_OR": ("SE_OR",),
    "Z": ("Z", "ZSCORE", "Z_SCORE", "GC_ZSCORE"),
    "INFO": ("INFO", "IMPINFO", "IMPUTATION_INFO"),
    "FRQ": ("FRQ", "EAF", "MAF", "FRQ_U", "F_U", "FRQ_A1", "FREQ", "EFFECT_ALLELE_FREQUENCY", "FREQ1"),
}
# Allele pairs that differ from their complement.
UNAMBIGUOUS = ("AC", "AG", "CA", "CT", "GA", "GT", "TC", "TG")
COJO = ("A1", "A2", "FRQ", "BETA", "SE", "P", "N")


def rename(df: DataFrame, names: Mapping[str, str] | None = None, synonyms: Mapping[str, Sequence[str]] = SYNONYMS) -> DataFrame:
    """Standard column names by synonym (case, '-' and '.' aside), then by ``names``; two columns of one name are an error."""
    known = {s: k for k, v in synonyms.items() for s in v}
    plain = lambda c: c.upper().replace("-", "_").replace(".", "_")
    new = {c: (names or {}).get(c) or known.get(plain(c), c) for c in df.columns}
    twice = sorted({n for n in new.values() if list(new.values()).count(n) > 1})
    if twice:
        raise ValueError(f"several columns stand for {', '.join(twice)}")
    return df.withColumnsRenamed(new)


def log_odds(df: DataFrame) -> DataFrame:
    """BETA and SE from OR and SE_OR, if both are there; values that are not positive give null."""
    if not {"OR", "SE_OR"} <= set(df.columns):
        return df
    return df.withColumns({"BETA": F.expr(E.log_ratio("OR")), "SE": F.expr(E.log_ratio("SE_OR"))})


def with_z(df: DataFrame) -> DataFrame:
    """Z as given, else from P with the sign of BETA, else BETA / SE."""
    have = set(df.columns)
    if "Z" in have:
        return df
    if "P" in have and "BETA" in have:
        return df.withColumn("Z", F.expr(f"sqrt({E.chi2_1_isf('P')}) * CASE WHEN BETA < 0 THEN -1 ELSE 1 END"))
    if {"BETA", "SE"} <= have:
        return df.withColumn("Z", F.expr("BETA / nullif(SE, 0)"))
    raise ValueError("Z needs P and BETA, or BETA and SE")


def check_cojo(df: DataFrame) -> DataFrame:
    missing = [c for c in COJO if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return with_z(df.drop("Z"))


def info_filter(df: DataFrame, columns: Sequence[str], least: float = 0.9) -> DataFrame:
    """The sum of the columns is at least ``least`` times their number; nulls go."""
    total = " + ".join(f"`{c}`" for c in columns)
    return df.where(F.expr(f"{total} >= {E.num(least)} * {len(columns)}"))


def maf_filter(df: DataFrame, column: str = "FRQ", least: float = 0.01, strict: bool = True) -> DataFrame:
    op = ">" if strict else ">="
    return df.where(F.expr(f"{column} BETWEEN 0 AND 1 AND {E.maf(column)} {op} {E.num(least)}"))


def p_filter(df: DataFrame, column: str = "P") -> DataFrame:
    return df.where((F.col(column) > 0) & (F.col(column) <= 1))


def allele_filter(df: DataFrame, a1: str = "A1", a2: str = "A2") -> DataFrame:
    return df.where(F.concat(F.upper(a1), F.upper(a2)).isin(*UNAMBIGUOUS))


def n_filter(df: DataFrame, column: str = "N", quantile: float = 0.9, divisor: float = 1.5) -> DataFrame:
    """N at least its quantile over the divisor."""
    found = quantiles(df, column, (), (quantile,)).head()
    return df.where(F.col(column) >= F.lit(found["_q"][0] / divisor if found and found["_q"] else None).cast("double"))


def chisq_cap(df: DataFrame, z: str = "Z", n: str = "N", most: float | None = None) -> DataFrame:
    """Z^2 under max(0.001 max N, 80) or the given bar; null Z goes."""
    bar = F.lit(float(most)) if most is not None else df.agg(F.greatest(0.001 * F.max(n), F.lit(80.0))).scalar()
    return df.where(F.col(z) * F.col(z) < bar)


def clean(df: DataFrame, info_min: float = 0.9, maf_min: float = 0.01, fmt: str = "z", names: Mapping[str, str] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """All steps: names, log odds, nulls, INFO, MAF, P, alleles, first of repeated SNPs (by ``order``), N, Z."""
    df = log_odds(rename(df, names))
    have = set(df.columns)
    df = df.dropna(subset=[c for c in df.columns if c != "INFO" and c not in order])
    if "INFO" in have:
        df = info_filter(df, ["INFO"], info_min)
    if "FRQ" in have:
        df = maf_filter(df, "FRQ", maf_min)
    if "P" in have:
        df = p_filter(df)
    if {"A1", "A2"} <= have:
        df = allele_filter(df)
    if "SNP" in have:
        df = dedup_first(df, ["SNP"], list(order) or [c for c in df.columns if c != "SNP"])
    if "N" in have:
        df = n_filter(df)
    return check_cojo(df) if fmt == "cojo" else with_z(df)


def to_rsid(df: DataFrame, known: DataFrame, chrom: str = "CHR", pos: str = "POS", snp: str = "dbsnp") -> DataFrame:
    """SNP by chromosome (without 'chr') and position; one row for each position and each identifier, the first by name."""
    place = known.select(F.concat_ws("_", F.expr(E.chromosome("chrom")), "pos").alias("_id"), F.col(snp))
    place = dedup_first(dedup_first(place, [snp], ["_id"]), ["_id"], [snp])
    mine = df.withColumn("_id", F.concat_ws("_", F.expr(E.chromosome(f"cast({chrom} as string)")), pos))
    return mine.join(place, "_id").withColumnRenamed(snp, "SNP").drop("_id")


def printed(df: DataFrame, digits: int = 3, exact: Sequence[str] = ("P",)) -> DataFrame:
    """Floating columns as text of fixed digits, those of ``exact`` in full."""
    return df.withColumns({c: F.format_string(f"%.{digits}f", F.col(c)) for c, t in df.dtypes if t in ("float", "double") and c not in exact})
