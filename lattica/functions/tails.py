"""Tails of the normal, Student, F and chi-square distributions, for numpy arrays and as columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_sf(z):
    """P(Z > z)."""
    return np.vectorize(lambda v: 0.5 * math.erfc(v / math.sqrt(2)), otypes=[float])(np.asarray(z, float))


def normal_ppf(p: float) -> float:
    """The quantile of the standard normal, by bisection of the tail."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t, df):
    """P(|T| > |t|) with ``df`` degrees of freedom; NaN in, NaN out."""
    one = lambda v, n: float("nan") if not (math.isfinite(n) and n > 0) or math.isnan(v) else beta_inc(n / 2, 0.5, n / (n + v * v))
    return np.vectorize(one, otypes=[float])(np.asarray(t, float), np.asarray(df, float))


def f_sf(f, d1, d2):
    """P(F > f)."""
    one = lambda v, a, b: float("nan") if math.isnan(v) or min(a, b) <= 0 else 1.0 if v <= 0 else beta_inc(b / 2, a / 2, b / (b + a * v))
    return np.vectorize(one, otypes=[float])(np.asarray(f, float), np.asarray(d1, float), np.asarray(d2, float))


def t_ppf(p: float, df: float) -> float:
    """The quantile of Student's distribution, by bisection."""
    lo, hi = -1e6, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        cdf = 1 - t_two_sided(mid, df) / 2 if mid > 0 else t_two_sided(mid, df) / 2
        lo, hi = (mid, hi) if cdf < p else (lo, mid)
    return (lo + hi) / 2


def _udf(fn):
    """An Arrow-batched column function that exists only once a session does."""
    made = {}

    def call(*cols: Column) -> Column:
        if "f" not in made:
            made["f"] = F.pandas_udf(fn, "double")
        return made["f"](*[c.cast("double") for c in cols])

    return call


def _two_sided_normal(z: pd.Series) -> pd.Series:
    return pd.Series(2 * normal_sf(z.abs().to_numpy()))


def _two_sided_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(), df.to_numpy()))


def _f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_sf(f.to_numpy(), d1.to_numpy(), d2.to_numpy()))


normal_p = _udf(_two_sided_normal)
t_p = _udf(_two_sided_t)
f_p = _udf(_f_tail)


def chi2_1_p(x: Column) -> Column:
    """P(chi-square with one degree of freedom > x)."""
    return normal_p(F.sqrt(x))
