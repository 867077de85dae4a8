"""Scalar expressions as SQL text that Spark and ANSI engines both run; wrap them in ``F.expr``.

Each function takes SQL text (a column name or an expression) and returns SQL text.
"""

from __future__ import annotations

from functools import reduce

import numpy as np


def num(x: float) -> str:
    """A DOUBLE literal; plain decimals would be DECIMAL."""
    return f"{float(x):.17e}"


def horner(coefficients: list[float], x: str) -> str:
    """Coefficients from the constant term upwards."""
    return reduce(lambda acc, c: f"({num(c)} + {x} * {acc})", reversed(coefficients[:-1]), num(coefficients[-1]))


# Chebyshev coefficients of ln(erfc(z) / t) + z^2 with t = 2 / (2 + z), W. Press et al.
ERFC = [
    -1.3026537197817094, 6.4196979235649026e-1, 1.9476473204185836e-2, -9.561514786808631e-3, -9.46595344482036e-4,
    3.66839497852761e-4, 4.2523324806907e-5, -2.0278578112534e-5, -1.624290004647e-6, 1.303655835580e-6,
    1.5626441722e-8, -8.5238095915e-8, 6.529054439e-9, 5.059343495e-9, -9.91364156e-10, -2.27365122e-10,
    9.6467911e-11, 2.394038e-12, -6.886027e-12, 8.94487e-13, 3.13092e-13, -1.12708e-13, 3.81e-16, 7.106e-15,
    -1.523e-15, -9.4e-17, 1.21e-16, -2.8e-17,
]
ERFC_POWERS = np.polynomial.chebyshev.cheb2poly([ERFC[0] / 2, *ERFC[1:]]).tolist()

# The rational approximations of algorithm AS 241, M. Wichura.
CENTRE = (
    [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
    [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3],
)
NEAR = (
    [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
)
FAR = (
    [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
    [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
)


def _ratio(parts: tuple[list[float], list[float]], x: str) -> str:
    return f"({horner(parts[0], x)} / {horner(parts[1], x)})"


def norm_sf(z: str) -> str:
    """Upper tail of the standard normal distribution."""
    u = f"(abs({z}) / sqrt({num(2)}))"
    t = f"({num(2)} / ({num(2)} + {u}))"
    half = f"({num(0.5)} * {t} * exp(-{u} * {u} + {horner(ERFC_POWERS, f'({num(2)} * {t} - {num(1)})')}))"
    return f"(CASE WHEN {z} >= 0 THEN {half} ELSE {num(1)} - {half} END)"


def norm_isf(p: str) -> str:
    """z with upper tail p, 0 < p < 1; null outside."""
    q = f"({num(0.5)} - {p})"
    r = f"sqrt(-ln(CASE WHEN {p} < {num(0.5)} THEN {p} ELSE {num(1)} - {p} END))"
    tail = f"(CASE WHEN {r} <= {num(5)} THEN {_ratio(NEAR, f'({r} - {num(1.6)})')} ELSE {_ratio(FAR, f'({r} - {num(5)})')} END)"
    centre = f"({q} * {_ratio(CENTRE, f'({num(0.180625)} - {q} * {q})')})"
    return f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN abs({q}) <= {num(0.425)} THEN {centre} WHEN {q} > 0 THEN {tail} ELSE -{tail} END)"


def chi2_1_isf(p: str) -> str:
    """Upper quantile of chi-square with one degree of freedom: the square of the normal one at p / 2."""
    z = norm_isf(f"({p} / {num(2)})")
    return f"({z} * {z})"


def two_sided_p(z: str, floor: float = 1e-300) -> str:
    return f"greatest({num(2)} * {norm_sf(f'abs({z})')}, {num(floor)})"


def neg_log10(p: str, floor: float | None = 1e-300) -> str:
    return f"(-log10(greatest({p}, {num(floor)})))" if floor else f"(-log10({p}))"


def from_neg_log10(x: str) -> str:
    return f"power({num(10)}, -{x})"


def cauchy_sf(t: str) -> str:
    """Upper tail of the Cauchy distribution, with all its digits for large t."""
    return f"(atan2({num(1)}, {t}) / pi())"


def unbiased_r2(r: str, n: str) -> str:
    return f"({r} * {r} - ({num(1)} - {r} * {r}) / ({n} - {num(2)}))"


def maf(f: str) -> str:
    return f"least({f}, {num(1)} - {f})"


def log_ratio(x: str) -> str:
    """ln x, null where x is not positive."""
    return f"(CASE WHEN {x} > 0 THEN ln({x}) END)"


def chromosome(x: str) -> str:
    return f"regexp_replace({x}, '^chr', '')"


def chrom_number(x: str) -> str:
    """The digits of a chromosome's name as a number (Spark SQL)."""
    return f"CAST(regexp_replace({x}, '[^0-9]', '') AS INT)"


def log_gamma(x: str) -> str:
    """ln of the gamma function for x > 0, by Stirling's series at x + 8."""
    z = f"({x} + {num(8)})"
    low = " * ".join(f"({x} + {num(i)})" for i in range(8))
    terms = ((1, 12), (-1, 360), (1, 1260), (-1, 1680), (1, 1188))
    series = " + ".join(f"{num(a)} / ({num(b)} * power({z}, {num(2 * k + 1)}))" for k, (a, b) in enumerate(terms))
    return f"(({z} - {num(0.5)}) * ln({z}) - {z} + {num(0.5)} * ln({num(2)} * pi()) + {series} - ln({low}))"


def nb_log_likelihood(x: str, mu: str, theta: str, eps: float = 1e-8) -> str:
    """Negative binomial with mean mu and inverse dispersion theta."""
    both = f"ln({theta} + {mu} + {num(eps)})"
    return f"({theta} * (ln({theta} + {num(eps)}) - {both}) + {x} * (ln({mu} + {num(eps)}) - {both}) + {log_gamma(f'({x} + {theta})')} - {log_gamma(theta)} - {log_gamma(f'({x} + {num(1)})')})"


def softplus(x: str) -> str:
    return f"(greatest({x}, {num(0)}) + ln({num(1)} + exp(-abs({x}))))"


def zinb_log_likelihood(x: str, mu: str, theta: str, pi: str, eps: float = 1e-8) -> str:
    """Zero-inflated negative binomial; pi is the logit of a dropout."""
    zero = f"(-({pi}) + {theta} * (ln({theta} + {num(eps)}) - ln({theta} + {mu} + {num(eps)})))"
    dropped = softplus(f"(-({pi}))")
    return f"(CASE WHEN {x} < {num(eps)} THEN {softplus(zero)} - {dropped} ELSE {nb_log_likelihood(x, mu, theta, eps)} - ({pi}) - {dropped} END)"


def tss(start: str, end: str, strand: str) -> str:
    return f"(CASE WHEN {strand} = '-' THEN {end} ELSE {start} END)"


def centre(start: str, end: str) -> str:
    return f"(({start} + {end}) / {num(2)})"


def safe_name(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9A-Za-z]', '_')"


def equal_width(x: str, lo: str, hi: str, n: int = 4) -> str:
    """Bins 0 to n - 1 of equal width over [lo, hi]; 0 where all are equal."""
    return f"(CASE WHEN {hi} <= {lo} THEN 0 ELSE CAST(least({n - 1}, floor(({x} - {lo}) / ({hi} - {lo}) * {num(n)})) AS INT) END)"


def cosine(a: str, b: str, eps: float = 1e-8) -> str:
    """Cosine of two array columns (Spark SQL)."""
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (u, v) -> CAST(u AS DOUBLE) * v), {num(0)}, (s, w) -> s + w)"
    return f"({dot(a, b)} / ((sqrt({dot(a, a)}) + {num(eps)}) * (sqrt({dot(b, b)}) + {num(eps)})))"


def standardised(dosages: str) -> str:
    """Mean-imputed, standardised dosages (population variance); zeros for a variant of one value (Spark SQL)."""
    seen = f"filter({dosages}, x -> x IS NOT NULL AND NOT isnan(x))"
    mean = f"(aggregate({seen}, {num(0)}, (s, x) -> s + x) / size({seen}))"
    centred = f"transform({dosages}, x -> CASE WHEN x IS NULL OR isnan(x) THEN {num(0)} ELSE x - {mean} END)"
    return f"transform({centred}, (x, i) -> coalesce(x / nullif(sqrt(aggregate({centred}, {num(0)}, (s, v) -> s + v * v) / size({dosages})), 0), {num(0)}))"


def z_last(coords: str, axis: str) -> str:
    """Coordinates with the given axis (from 0) moved to the end (Spark SQL)."""
    return f"concat(filter({coords}, (x, i) -> i <> {axis}), array(element_at({coords}, {axis} + 1)))"
