"""Statistics that Spark lacks, as column expressions or driver-side numbers."""

from __future__ import annotations

import math
from functools import lru_cache, reduce
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


EXACT = 200  # degrees of freedom up to which t quantiles are numbers


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-13:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@lru_cache(maxsize=100_000)
def t_quantile(p: float, df: int) -> float:
    """Student's t quantile by bisection of the tail's incomplete beta."""
    tail, low, high = 2 * (1 - p), 0.0, 1000.0
    for _ in range(70):
        mid = (low + high) / 2
        low, high = (mid, high) if incomplete_beta(df / 2, 0.5, df / (df + mid * mid)) > tail else (low, mid)
    return (low + high) / 2


def t_quantile_of(p: float, df: Column) -> Column:
    """Student's t quantile for a column of degrees of freedom, 1 or more; null else.

    Up to ``EXACT`` degrees it is looked up among numbers, beyond that it is the normal quantile with four terms of
    Fisher's expansion, which is exact to ten digits there.
    """
    z = NormalDist().inv_cdf(p)
    # Coefficients of z, z^3, z^5, ... and divisors of the expansion's terms.
    terms = (((1, 1), 4), ((3, 16, 5), 96), ((-15, 17, 19, 3), 384), ((-945, -1920, 1482, 776, 79), 92160))
    series = F.lit(z)
    for k, (coefficients, divisor) in enumerate(terms, 1):
        series = series + F.lit(sum(c * z ** (2 * i + 1) for i, c in enumerate(coefficients)) / divisor) / F.pow(df, F.lit(float(k)))
    known = F.array(*[F.lit(t_quantile(p, d)) for d in range(1, EXACT + 1)])
    return F.when(df.between(1, EXACT), F.try_element_at(known, df.cast("int"))).when(df > EXACT, series)


def skewness(x: str) -> Column:
    """Bias-corrected; 0 for fewer than three values or no spread."""
    n = F.count(x).cast("double")
    found = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when((n > 2) & (F.stddev_samp(x) > 0), found).otherwise(0.0)


def kurtosis(x: str) -> Column:
    """Bias-corrected excess; 0 for fewer than four values or no spread."""
    n = F.count(x).cast("double")
    found = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    return F.when((n > 3) & (F.stddev_samp(x) > 0), found).otherwise(0.0)


def log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for x > 0: Stirling's series eight places up, and the recurrence back."""
    y = x + 8
    # B(2k) / (2k (2k - 1)).
    terms = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
    series = reduce(lambda a, b: a + b, [F.lit(t) / F.pow(y, F.lit(2.0 * k + 1)) for k, t in enumerate(terms)])
    back = reduce(lambda a, b: a + b, [F.log(x + i) for i in range(8)])
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - back


def mcnemar_p(n10: Column, n01: Column) -> Column:
    """Exact two-sided p of the discordant counts: twice the lower binomial tail, 1 at most.

    The tail's last term comes from log_gamma; before it each is k / (n - k + 1) times the next, so that ten times the
    square root of n of them hold all that counts in a double.
    """
    n, least = (n10 + n01).cast("double"), F.least(n10, n01).cast("double")
    last = log_gamma(n + 1) - log_gamma(least + 1) - log_gamma(n - least + 1) - n * math.log(2)
    most = F.least(least, F.ceil(10 * F.sqrt(n)) + 50).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def term(acc: Column, i: Column) -> Column:
        t = acc["term"] * (least - i) / (n - least + 1 + i)
        return F.struct(t.alias("term"), (acc["total"] + t).alias("total"))

    places = F.when(most > 0, F.sequence(F.lit(0), most - 1)).otherwise(F.array().cast("array<int>"))
    tail = F.exp(last) * F.aggregate(places, start, term)["total"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))
