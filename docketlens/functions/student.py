"""Quantiles of Student's t without third-party packages."""

from __future__ import annotations

from functools import lru_cache
from math import exp, lgamma, log, sqrt

import pandas as pd
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) > 0 else -1)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
            d = 1 / d
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_cdf(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


@lru_cache(maxsize=65536)
def t_quantile(p: float, df: float) -> float:
    """By bisection; to about 1e-12."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 2.0
    while t_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
        if high - low < 1e-12 * max(1.0, high):
            break
    return (low + high) / 2


def t_critical(p: float, df):
    """Column of the quantile at ``p``; null where ``df`` is null or not positive."""

    @F.pandas_udf("double")
    def run(d: pd.Series) -> pd.Series:
        return d.map(lambda v: t_quantile(p, float(v)) if v == v and v and v > 0 else None).astype("float64")

    return run(df)
