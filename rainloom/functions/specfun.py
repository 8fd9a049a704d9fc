"""Special functions as Catalyst expressions: log gamma, regularised gamma, normal and chi-square."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos coefficients, g = 7.
LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]
#: Wichura's AS241 rational approximations, numerators and denominators in ascending powers.
CENTRAL = (
    [3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727],
    [1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610],
)
MIDDLE = (
    [1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
)
TERMS = 200


def _horner(coefficients: list[float], x: str) -> str:
    text = f"CAST({coefficients[-1]!r} AS DOUBLE)"
    for c in reversed(coefficients[:-1]):
        text = f"({text} * {x} + CAST({c!r} AS DOUBLE))"
    return text


def norm_ppf_sql(p: str) -> str:
    """The normal quantile as SQL text for Spark and DuckDB alike, for p within [1e-10, 1 - 1e-10]."""
    q = f"({p} - 0.5)"
    r = f"(0.180625 - {q} * {q})"
    s = f"(sqrt(-ln(least({p}, 1 - {p}))) - 1.6)"
    central = f"{q} * {_horner(CENTRAL[0], r)} / {_horner(CENTRAL[1], r)}"
    tail = f"sign({q}) * {_horner(MIDDLE[0], s)} / {_horner(MIDDLE[1], s)}"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {central} ELSE {tail} END"


def norm_ppf(p: Column) -> Column:
    holder = F.transform(F.array(p), lambda v: _ppf(v))
    return F.get(holder, F.lit(0))


def _ppf(p: Column) -> Column:
    q = p - 0.5
    r, s = F.lit(0.180625) - q * q, F.sqrt(-F.log(F.least(p, 1 - p))) - 1.6

    def poly(coefficients: list[float], x: Column) -> Column:
        out = F.lit(coefficients[-1])
        for c in reversed(coefficients[:-1]):
            out = out * x + c
        return out

    return F.when(F.abs(q) <= 0.425, q * poly(CENTRAL[0], r) / poly(CENTRAL[1], r)).otherwise(F.signum(q) * poly(MIDDLE[0], s) / poly(MIDDLE[1], s))


def lgamma(x: Column) -> Column:
    """log gamma for x > 0."""
    z = x - 1
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + k)
    t = z + 7.5
    return 0.5 * F.log(2 * F.pi()) + (z + 0.5) * F.log(t) - t + F.log(total)


def gamma_p(a: Column, x: Column, lgamma_a1: Column | None = None) -> Column:
    """Regularised lower incomplete gamma by its series; 1 far in the upper tail.

    Term n is at most x^n / n!, under exp(-40) from e x + 40 on, where it changes no sum of 1 or more: later ones are left out.
    """
    base = lgamma(a + 1) if lgamma_a1 is None else lgamma_a1
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(acc: Column, n: Column) -> Column:
        t = acc["t"] * x / (a + n)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    terms = F.least(F.lit(TERMS), F.greatest(F.lit(1), F.ceil(F.lit(math.e) * x + 40).cast("int")))
    series = F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda acc: acc["s"])
    return (
        F.when(x.isNull() | a.isNull(), F.lit(None))
        .when(x <= 0, 0.0)
        .when(x > a + 10 * F.sqrt(a) + 40, 1.0)
        .otherwise(F.exp(a * F.log(x) - x - base) * series)
    )


def gamma_p_sql(a: str, x: str) -> str:
    """The same series for DuckDB, which has lgamma."""
    terms = f"list_sum(list_transform(range(0, {TERMS + 1}), lambda n: exp(n * ln({x}) - (lgamma({a} + 1 + n) - lgamma({a} + 1)))))"
    return f"CASE WHEN {x} IS NULL OR {a} IS NULL THEN NULL WHEN {x} <= 0 THEN 0 WHEN {x} > {a} + 10 * sqrt({a}) + 40 THEN 1 ELSE exp({a} * ln({x}) - {x} - lgamma({a} + 1)) * {terms} END"


def norm_cdf(z: Column) -> Column:
    return 0.5 * (1 + F.signum(z) * gamma_p(F.lit(0.5), z * z / 2))


def chi2_tail(statistic: Column, freedom: Column) -> Column:
    return 1 - gamma_p(freedom / 2, statistic / 2)
