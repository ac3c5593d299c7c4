"""Probabilities of test statistics: regularised incomplete gamma and beta functions on columns, and p-values from them.

Spark has no such functions, so they are computed on Arrow batches, vectorised; they belong on aggregated rows (one a test).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Terms of the series and of the continued fractions, which both converge well before.
TERMS = 400
_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Q(a, x), the share of the gamma integral beyond x: a series below a + 1, a continued fraction (from its end) above."""
    a, x = np.asarray(a, float), np.maximum(np.asarray(x, float), 1e-300)
    front = np.exp(a * np.log(x) - x - _log_gamma(a))
    series, fraction = np.ones_like(x), x + 2 * TERMS + 1 - a
    for k in range(TERMS, 0, -1):
        series = 1 + x / (a + k) * series
        fraction = x + 2 * k - 1 - a - k * (k - a) / fraction
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x < a + 1, 1 - front * series / a, front / fraction)


def lower_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b), the share of the beta integral up to x, by its continued fraction (from its end)."""
    a, b, x = (np.asarray(v, float) for v in (a, b, np.clip(x, 1e-300, 1 - 1e-16)))
    turned = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    fraction = np.ones_like(y)
    for k in range(TERMS, 0, -1):
        m = k // 2
        step = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)) if k % 2 else m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        fraction = 1 + step / fraction
    part = front / fraction
    return np.where(turned, 1 - part, part)


def _column(function: object, *values: Column) -> Column:
    """The function of columns on Arrow batches; null where any value is null or not a number."""

    def run(*batch: pd.Series) -> pd.Series:
        known = np.logical_and.reduce([b.notna().to_numpy() for b in batch])
        out = np.full(len(known), np.nan)
        out[known] = function(*(b.to_numpy(float, na_value=np.nan)[known] for b in batch))
        return pd.Series(out)

    # a pandas function states its arguments by their number
    arity = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c)}[len(values)]
    return F.nanvl(F.pandas_udf(arity, DoubleType())(*(v.cast("double") for v in values)), F.lit(None).cast("double"))


def chi_square_p(statistic: Column, dof: Column) -> Column:
    """P(chi-square >= statistic); 1 without degrees of freedom."""
    return F.when(dof > 0, _column(lambda x, d: upper_gamma(np.maximum(d, 1) / 2, x / 2), statistic, dof)).otherwise(1.0)


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a normal deviate."""
    return _column(lambda v: upper_gamma(np.full(len(v), 0.5), v * v / 2), z)


def student_p(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t."""
    return _column(lambda v, d: lower_beta(d / 2, np.full(len(d), 0.5), d / (d + v * v)), t, dof)


def variance_p(f: Column, dof1: Column, dof2: Column) -> Column:
    """Two-sided p-value of a ratio of variances: twice the smaller tail."""

    def both(v: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        below = lower_beta(d1 / 2, d2 / 2, d1 * v / (d1 * v + d2))
        return 2 * np.minimum(below, 1 - below)

    return _column(both, f, dof1, dof2)


def kolmogorov_p(distance: Column, n: Column, m: Column) -> Column:
    """P(distance or more) between samples of n and m of one continuous distribution, by the limit law. Plain columns: a sum of 100 terms."""
    scaled = distance * F.sqrt(n * m / (n + m))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * scaled * scaled))
    return F.when(scaled < 0.05, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
