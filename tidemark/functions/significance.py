"""p-values of t and F statistics as column functions, over whole Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of distinct arguments, which are few where degrees of freedom repeat."""
    some, back = np.unique(x, return_inverse=True)
    return np.array([math.lgamma(v) if v == v and v > 0 else math.nan for v in some.tolist()])[back].reshape(np.shape(x))


def incomplete_beta(a, b, x):
    """The regularised incomplete beta function of arrays, by Lentz's continued fraction on the side where it converges fast; NaN in, NaN out."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inside = (z > 0) & (z < 1) & (p > 0) & (q > 0)
    p, q, z = (np.where(inside, v, w) for v, w in ((p, 1.0), (q, 1.0), (z, 0.5)))
    tiny = 1e-300
    c, d, out = np.ones_like(z), np.zeros_like(z), np.ones_like(z)
    for k in range(400):
        m = k // 2
        if k == 0:
            step = np.ones_like(z)
        elif k % 2 == 0:
            step = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        else:
            step = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d = 1 + step * d
        d = 1 / np.where(d == 0, tiny, d)
        c = 1 + step / c
        c = np.where(c == 0, tiny, c)
        out = out * c * d
        if k and np.all(np.abs(1 - c * d) < 1e-15):
            break
    front = np.exp(p * np.log(z) + q * np.log1p(-z) + log_gamma(p + q) - log_gamma(p) - log_gamma(q)) / p
    found = front * (out - 1)
    found = np.where(swap, 1 - found, found)
    return np.where(np.isnan(a) | np.isnan(b) | np.isnan(x) | ~(a > 0) | ~(b > 0), np.nan, np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, found)))


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic; null or NaN where an argument is, or without degrees of freedom."""

    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        x, v = t.to_numpy(float), np.where(df > 0, df, np.nan)
        return pd.Series(incomplete_beta(v / 2, 0.5, v / (v + x * x)))

    return F.pandas_udf(p, "double")(t.cast("double"), df.cast("double"))


def f_p_value(f: Column, df1: Column, df2: Column) -> Column:
    """Upper-tail p-value of an F statistic."""

    def p(f: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        x, u, v = np.where(f >= 0, f, np.nan), np.where(a > 0, a, np.nan), np.where(b > 0, b, np.nan)
        return pd.Series(incomplete_beta(v / 2, u / 2, v / (v + u * x)))

    return F.pandas_udf(p, "double")(f.cast("double"), df1.cast("double"), df2.cast("double"))
