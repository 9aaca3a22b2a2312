"""Tail probabilities as vectorised column functions: incomplete beta and gamma by continued fractions and series."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def betainc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + num * d) or tiny), (1 + num / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def gammainc_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        num = -i * (i - a)
        b += 2
        d, c = 1 / ((num * d + b) or tiny), (b + num / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _each(f, *series: pd.Series) -> pd.Series:
    return pd.Series([None if any(v is None or v != v for v in row) else f(*row) for row in zip(*series, strict=True)], dtype="float64")


def f_sf(f: Column, d1: Column, d2: Column) -> Column:
    """P(F > f) with d1 and d2 degrees of freedom."""

    @F.pandas_udf("double")
    def run(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return _each(lambda x, a, b: betainc(b / 2, a / 2, b / (b + a * x)) if a > 0 and b > 0 else math.nan, x, a, b)

    return F.nanvl(run(f, d1.cast("double"), d2.cast("double")), F.lit(None).cast("double"))


def chi2_sf(x: Column, k: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, k: pd.Series) -> pd.Series:
        return _each(lambda x, k: gammainc_upper(k / 2, x / 2), x, k)

    return run(x, k.cast("double"))


def normal_two_sided(z: Column) -> Column:
    @F.pandas_udf("double")
    def run(z: pd.Series) -> pd.Series:
        return _each(lambda z: math.erfc(abs(z) / math.sqrt(2)), z)

    return run(z)


#: Rows of the larger class up to which the exact distribution of U is computed.
MOST_EXACT = 10_000


@lru_cache(maxsize=256)
def _wilcoxon_counts(n: int) -> np.ndarray:
    """How many sets of signs give each sum of positive ranks, as a share of all."""
    out = np.zeros(n * (n + 1) // 2 + 1)
    out[0] = 1.0
    for i in range(1, n + 1):
        out[i:] = out[i:] + out[:-i]
    return out / 2.0**n


@lru_cache(maxsize=256)
def _mann_whitney_counts(a: int, b: int) -> np.ndarray:
    """How many orders of a and b rows give each U, as a share of all: the Gaussian binomial coefficients, term by term."""
    a, b = min(a, b), max(a, b)
    out = np.zeros(a * b + 1)
    out[0] = 1.0
    for i in range(1, a + 1):
        if b + i <= a * b:
            out[b + i :] -= out[: -(b + i)].copy()
        for k in range(i, len(out)):
            out[k] += out[k - i]
    return out / out.sum()


def wilcoxon_exact(n: int, w: float) -> float:
    """Two-sided p of the lesser rank sum w of n differences without zeros and ties."""
    return float(min(1.0, 2 * _wilcoxon_counts(n)[: math.floor(w) + 1].sum()))


def mann_whitney_exact(a: int, b: int, u: float) -> float:
    """Two-sided p of U without ties."""
    return float(min(1.0, 2 * _mann_whitney_counts(a, b)[math.ceil(max(u, a * b - u)) :].sum()))


def wilcoxon_p(n: Column, w: Column) -> Column:
    @F.pandas_udf("double")
    def run(n: pd.Series, w: pd.Series) -> pd.Series:
        return _each(lambda n, w: wilcoxon_exact(int(n), w) if n <= 50 else math.nan, n, w)

    return run(n, w)


def mann_whitney_p(n1: Column, n2: Column, u: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, u: pd.Series) -> pd.Series:
        return _each(lambda a, b, u: mann_whitney_exact(int(a), int(b), u) if min(a, b) <= 8 and max(a, b) <= MOST_EXACT else math.nan, a, b, u)

    return run(n1, n2, u)


def percent_point(p: float) -> float:
    """The standard normal quantile, by bisection."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return float(np.float64((lo + hi) / 2))
