"""Proportion and contingency statistics. Tails are computed in logarithmic or constant time, whatever the counts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

Z95 = 1.959963984540054


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def binomial_cdf(k: int, n: int, p: float) -> float:
    return 0.0 if k < 0 else 1.0 if k >= n else beta_inc(n - k, k + 1, 1 - p)


def binomial_two_sided(k: int, n: int, p: float) -> float:
    """Sum of the probabilities that do not exceed that of k (up to 1e-7 of it); the other tail's end is found by bisection."""
    if n == 0 or p in (0.0, 1.0):
        return 1.0 if n == 0 or k == n * p else 0.0
    log_pmf = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    limit = log_pmf(k) + math.log1p(1e-7)
    mode = min(n, int((n + 1) * p))
    if log_pmf(mode) <= limit:
        return 1.0
    if k < mode:
        low, high = mode, n + 1  # first place above the mode within the limit
        while low < high:
            mid = (low + high) // 2
            if mid <= n and log_pmf(mid) > limit:
                low = mid + 1
            else:
                high = mid
        far = binomial_cdf(n - low, n, 1 - p) if low <= n else 0.0
        return min(1.0, binomial_cdf(k, n, p) + far)
    low, high = -1, mode  # last place below the mode within the limit
    while low < high:
        mid = (low + high + 1) // 2
        if log_pmf(mid) > limit:
            high = mid - 1
        else:
            low = mid
    return min(1.0, binomial_cdf(n - k, n, 1 - p) + binomial_cdf(low, n, p))


def chi2_tail(x: float, dof: float) -> float:
    """Regularised upper incomplete gamma function of (dof / 2, x / 2)."""
    a, x = dof / 2, x / 2
    if x <= 0 or dof <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        i = a
        while term > total * 1e-17:
            i += 1
            term *= x / i
            total += term
        return max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 100_000):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b)
        c = b + num / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


@pandas_udf(DoubleType())
def binomial_p(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """Exact two-sided p values of k of n against p."""
    return pd.Series([binomial_two_sided(int(a), int(b), float(c)) for a, b, c in zip(k, n, p)], dtype="float64")


@pandas_udf(DoubleType())
def chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(float(a), float(b)) for a, b in zip(x, dof)], dtype="float64")


def wilson(k: Column, n: Column, upper: bool, z: float = Z95) -> Column:
    p = k / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    bound = (p + z * z / (2 * n) + (half if upper else -half)) / (1 + z * z / n)
    return F.least(F.greatest(bound, F.lit(0.0)), F.lit(1.0))


def benjamini_hochberg(frame: DataFrame, p: str, key: str, out: str = "q_value") -> DataFrame:
    """q values over all rows of a table that has a row per group; ties in p go by key.

    The windows see the groups, not the documents: their number is that of topics.
    """
    order = Window.orderBy(F.col(p), F.col(key))
    ranked = frame.withColumn("_rank", F.row_number().over(order)).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy()))
    behind = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(behind))).drop("_rank", "_m")


def average_rank(value: str) -> Column:
    """Rank by value where ties share their mean rank; over a table with a row per group."""
    return F.rank().over(Window.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(value)) - 1) / 2
