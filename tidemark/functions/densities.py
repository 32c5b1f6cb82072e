"""Predictive densities as column functions: normal, Student's t, and a t whose sides are stretched by a skewness.

``skew`` s > 0 makes the upper side wider: a value above the centre is e^s times, one below e^-s times that of a symmetric t (two halves of
weights e^s and e^-s). Scales are those of the t, not its deviation. Arrow batches are computed as arrays.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.significance import incomplete_beta, log_gamma

#: Degrees of freedom from which a t is a normal distribution.
NORMAL_FROM = 1e6


def t_density(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.exp(log_gamma((df + 1) / 2) - log_gamma(df / 2) - 0.5 * np.log(df * math.pi) - (df + 1) / 2 * np.log1p(x * x / df))


def _tail(inner: np.ndarray, outer: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Mass beyond x, of inner = x²/(df + x²) and outer = 1 - inner, from whichever is the smaller."""
    near = inner * (df + 1) < 1
    found = incomplete_beta(np.where(near, 0.5, df / 2), np.where(near, df / 2, 0.5), np.where(near, inner, outer))
    return np.where(near, 0.5 - 0.5 * found, 0.5 * found)


def t_cdf(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    tail = _tail(x * x / (df + x * x), df / (df + x * x), df)
    return np.where(x < 0, tail, 1 - tail)


def t_quantile(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Inverse of ``t_cdf``: Newton's steps on the smaller tail, kept inside a bracket that each step narrows."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    tail = np.minimum(p, 1 - p)
    goal = np.where((tail > 0) & (df > 0), tail, 0.25)
    free = np.where(df > 0, df, 1.0)
    # in y = ln(1 + x²/df), where tails are nearly straight; the bracket covers all doubles
    low, high = np.zeros_like(goal), np.full_like(goal, 1400.0) / np.minimum(free, 2.0)
    y = np.minimum(np.maximum(-2 * np.log(2 * goal) / free, 1e-12), high / 2)
    for _ in range(200):
        x = np.sqrt(free * np.expm1(y))
        held = _tail(-np.expm1(-y), np.exp(-y), free)
        low, high = np.where(held > goal, y, low), np.where(held > goal, high, y)
        slope = t_density(x, free) * (free + x * x) / (2 * np.maximum(x, 1e-300))
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            step = y + (np.log(held) - np.log(goal)) * held / slope
        after = np.where((step > low) & (step < high) & np.isfinite(step), step, (low + high) / 2)
        done = np.abs(after - y) <= 1e-15 * np.maximum(y, 1e-300)
        y = after
        if done.all():
            break
    x = np.sqrt(free * np.expm1(y))
    out = np.where(p < 0.5, -x, x)
    return np.where(np.isnan(p) | ~(df > 0) | (p < 0) | (p > 1), np.nan, np.where(p == 0.5, 0.0, np.where(p == 0, -np.inf, np.where(p == 1, np.inf, out))))


def _each(f, x: np.ndarray) -> np.ndarray:
    return np.array([f(v) for v in np.ravel(x).tolist()], float).reshape(np.shape(x))


def _normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p) if 0 < p < 1 else math.inf if p == 1 else -math.inf if p == 0 else math.nan


def _base(kind: str, z: np.ndarray, df: np.ndarray) -> np.ndarray:
    normal = df >= NORMAL_FROM
    t = np.where(normal, 10.0, df)
    if kind == "pdf":
        return np.where(normal, np.exp(-z * z / 2) / math.sqrt(2 * math.pi), t_density(z, t))
    if kind == "cdf":
        return np.where(normal, 0.5 * _each(math.erfc, -z / math.sqrt(2)), t_cdf(z, t))
    return np.where(normal, _each(_normal_quantile, z), t_quantile(z, t))


def skewed(kind: str, x: np.ndarray, df: np.ndarray, skew: np.ndarray) -> np.ndarray:
    """pdf or cdf at ``x``, or quantile of the probability ``x``, of the standard skewed t."""
    up, down = np.exp(skew), np.exp(-skew)
    below = down / (up + down)
    if kind == "quantile":
        low = x < below
        # a half's own probability is on its side of the symmetric t
        inner = np.where(low, x * (up + down) / (2 * down), 1 - (1 - x) * (up + down) / (2 * up))
        return _base("quantile", inner, df) * np.where(low, down, up)
    side = np.where(x < 0, down, up)
    if kind == "pdf":
        return 2 / (up + down) * _base("pdf", x / side, df)
    half = _base("cdf", x / side, df)
    return np.where(x < 0, 2 * down / (up + down) * half, 1 - 2 * up / (up + down) * (1 - half))


def _column(kind: str, x: Column, mu: Column, sigma: Column, df: Column, skew: Column) -> Column:
    def f(x: pd.Series, mu: pd.Series, sigma: pd.Series, df: pd.Series, skew: pd.Series) -> pd.Series:
        x, mu, sigma, df, skew = (s.to_numpy(float) for s in (x, mu, sigma, df, skew))
        with np.errstate(invalid="ignore"):
            if kind == "quantile":
                return pd.Series(mu + sigma * skewed(kind, x, df, skew))
            out = skewed(kind, (x - mu) / sigma, df, skew)
            return pd.Series(out / sigma if kind == "pdf" else out)

    return F.pandas_udf(f, "double")(*(c.cast("double") for c in (x, mu, sigma, df, skew)))


def density(x: Column, mu: Column, sigma: Column, df: Column, skew: Column | None = None) -> Column:
    """Density at ``x``; df of ``NORMAL_FROM`` or more is normal."""
    return _column("pdf", x, mu, sigma, df, F.lit(0.0) if skew is None else skew)


def probability(x: Column, mu: Column, sigma: Column, df: Column, skew: Column | None = None) -> Column:
    """Probability of values up to ``x``."""
    return _column("cdf", x, mu, sigma, df, F.lit(0.0) if skew is None else skew)


def quantile(p: Column, mu: Column, sigma: Column, df: Column, skew: Column | None = None) -> Column:
    """The value below which the share ``p`` lies."""
    return _column("quantile", p, mu, sigma, df, F.lit(0.0) if skew is None else skew)


def fit_densities(residuals: DataFrame) -> DataFrame:
    """(series_id, n, sigma, df, skew) of each series' residuals (value), by moments.

    df follows from the excess kurtosis (4 + 6/excess, 200 at most, and where there is none), the skewness from how much larger the squares above 0
    are than those below, the scale from the mean square. Series of fewer than five residuals, or without any spread, are left out."""
    v = F.col("value")
    out = residuals.filter("value is not null").groupBy("series_id").agg(F.count("*").alias("n"), F.avg(v * v).alias("m2"), F.kurtosis(v).alias("excess"), F.avg(F.when(v > 0, v * v)).alias("above"), F.avg(F.when(v < 0, v * v)).alias("below"))
    df = F.when(F.col("excess") > 6 / 196, 4 + 6 / F.col("excess")).otherwise(200.0)
    skew = F.coalesce(F.ln(F.try_divide("above", "below")) / 4, F.lit(0.0))
    # the mean square of the stretched halves is (e^3s + e^-3s) / (e^s + e^-s) times the t's df / (df - 2)
    wide = (F.exp(3 * F.col("skew")) + F.exp(-3 * F.col("skew"))) / (F.exp(F.col("skew")) + F.exp(-F.col("skew")))
    out = out.filter("n >= 5 and m2 > 0").withColumn("df", df).withColumn("skew", skew)
    return out.select("series_id", "n", F.sqrt(F.col("m2") * (F.col("df") - 2) / F.col("df") / wide).alias("sigma"), "df", "skew")


def density_bands(forecasts: DataFrame, fitted: DataFrame, interval: float = 0.8) -> DataFrame:
    """``forecasts`` (series_id, h, point) with lower, upper and median of the fitted density, whose scale grows with the root of h."""
    rows = forecasts.join(fitted, "series_id").withColumn("scale", F.col("sigma") * F.sqrt("h"))
    at = lambda p: quantile(F.lit(p), F.col("point"), F.col("scale"), F.col("df"), F.col("skew"))
    return rows.select("series_id", "h", "point", at((1 - interval) / 2).alias("lower"), at(0.5).alias("median"), at((1 + interval) / 2).alias("upper"))
