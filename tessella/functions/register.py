"""The scalar expressions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessella.functions import exprs as E

FUNCTIONS = {
    "norm_sf": ("z DOUBLE", E.norm_sf("z")),
    "norm_isf": ("p DOUBLE", E.norm_isf("p")),
    "chi2_1_isf": ("p DOUBLE", E.chi2_1_isf("p")),
    "cauchy_sf": ("t DOUBLE", E.cauchy_sf("t")),
    "log_gamma": ("x DOUBLE", E.log_gamma("x")),
    "nb_log_likelihood": ("x DOUBLE, mu DOUBLE, theta DOUBLE", E.nb_log_likelihood("x", "mu", "theta")),
    "cauchy_combination": ("ps ARRAY<DOUBLE>", E.cauchy_sf("(aggregate(ps, 0D, (s, p) -> s + tan((0.5D - p) * pi())) / size(ps))")),
}


def register(spark: SparkSession) -> list[str]:
    """Makes :data:`FUNCTIONS` temporary functions of the session; their bodies are expanded into each plan."""
    for name, (given, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS DOUBLE RETURN {body}")
    return list(FUNCTIONS)
