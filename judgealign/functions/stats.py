"""Two-sided p-values of correlations.

They are needed only on metric rows (dimensions x models), so a small vectorised pandas function is enough.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from judgealign.session import ship_with_tasks

ship_with_tasks(__name__)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def correlation_p(r: float, n: float) -> float:
    """Two-sided p of a correlation of n points under independence; NaN below three points."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    # P(|t| > t0) with t0 = r sqrt((n-2)/(1-r^2)) is I_{1-r^2}((n-2)/2, 1/2)
    return incomplete_beta((n - 2) / 2.0, 0.5, 1.0 - r * r)


def p_value(r: Column, n: Column) -> Column:
    """p-value column; NULL where undefined."""

    @F.pandas_udf("double")
    def compute(rs: pd.Series, ns: pd.Series) -> pd.Series:
        out = [correlation_p(a, b) for a, b in zip(rs.astype(float), ns.astype(float))]
        return pd.Series(np.array(out, dtype=float))

    p = compute(r, n.cast("double"))
    return F.when(~F.isnan(p), p)
