"""Forecasts with prediction intervals, for all series at once.

Closed-form methods come from window sums over (series_id, idx); recursive ones fold over a series' array, once for each
point of their parameter grid, so that work is spread over series and grid points. Bands are point ± z·sigma·sqrt(h).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import INTERVAL_Z, box_cox, inverse_box_cox
from tidemark.sources.tables import arrays

# fixed values: grids of smoothing parameters
FINE = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
COARSE = [0.1, 0.3, 0.5, 0.7, 0.9]
DAMPING = [0.3, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.98]
#: Least points of a method; a seasonal one needs a number of seasons beside.
LEAST_POINTS = {"naive": 2, "mean": 2, "drift": 2, "linear": 3, "holt": 4, "holt_damped": 4, "theta": 3, "croston": 2, "snaive": 2}


def _sum_squares(errors: Column) -> Column:
    return F.aggregate(errors, F.lit(0.0), lambda a, e: a + e * e)


def _values(y: str = "y") -> Column:
    return F.col(y)


def simple_fits(points: DataFrame, season: int | None = None, methods: tuple[str, ...] | None = None) -> DataFrame:
    """(series_id, method, n, sigma, a, b, ring) of naive, mean, drift, linear and, with a season, snaive; of ``methods`` only, if given.

    The forecast of step h is ``a + b·h``, or ring[(h - 1) mod season] of the seasonal method."""
    s = arrays(points).filter("n >= 2")
    y, n, last, first = F.col("y"), F.col("n"), F.element_at("y", -1), F.element_at("y", 1)
    mean = F.aggregate(y, F.lit(0.0), lambda a, v: a + v) / n
    mid = (n - 1) / F.lit(2.0)
    s = s.withColumn("mean", mean)
    moment = F.aggregate(F.transform(y, lambda v, i: (i - mid) * (v - F.col("mean"))), F.lit(0.0), lambda a, v: a + v)
    s = s.withColumn("slope", moment / (n * (n * n - F.lit(1.0)) / 12)).withColumn("drift", (last - first) / (n - 1))
    steps = lambda k: F.zip_with(F.slice(y, k + 1, n - k), F.slice(y, 1, n - k), lambda p, q: p - q)
    sigma = lambda errors, count, used: F.sqrt(_sum_squares(errors) / F.greatest(count - used, F.lit(1)))
    none = F.array().cast("array<double>")
    line = F.col("mean") - F.col("slope") * mid
    fit = lambda name, sg, a, b, ring=none: F.struct(F.lit(name).alias("method"), sg.alias("sigma"), a.alias("a"), b.alias("b"), ring.alias("ring"))
    zero = F.lit(0.0)
    fits = {
        "naive": fit("naive", sigma(steps(1), n - 1, 0), last, zero),
        "mean": fit("mean", sigma(F.transform(y, lambda v: v - F.col("mean")), n, 1), F.col("mean"), zero),
        "drift": fit("drift", sigma(F.transform(y, lambda v, i: v - (first + F.col("drift") * i)), n, 1), last, F.col("drift")),
        "linear": F.when(n >= 3, fit("linear", sigma(F.transform(y, lambda v, i: v - (line + F.col("slope") * i)), n, 2), line + F.col("slope") * (n - 1), F.col("slope"))),
    }
    if season:
        fits["snaive"] = F.when(n > season, fit("snaive", sigma(steps(season), n - season, 0), zero, zero, F.slice(y, n - season + 1, F.lit(season))))
    asked = [f for name, f in fits.items() if methods is None or name in methods]
    if not asked:
        return s.filter(F.lit(False)).select("series_id", "n", fits["naive"].alias("f")).select("series_id", "n", "f.*")
    return s.select("series_id", "n", F.explode(F.array_compact(F.array(*asked))).alias("f")).select("series_id", "n", "f.*")


def holt_fits(points: DataFrame, damped: bool = False) -> DataFrame:
    """(series_id, n, alpha, beta, phi, sse, level, trend): the grid point of least squared error, the first of equals.

    All grid points of up to 32 series, the longest first, run together in a task; a null value makes all of a fit null."""
    grid = np.array([(a, b, p) for a in FINE for b in FINE for p in (DAMPING if damped else [1.0])])
    least, slots = LEAST_POINTS["holt"], 32

    def smooth(many: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        alpha, beta, phi = (c[None, :] for c in grid.T)
        sizes = np.array([len(y) for y in many])
        y = np.zeros((sizes[0], len(many)))
        for k, one in enumerate(many):
            y[: len(one), k] = one
        level = np.repeat(y[0][:, None], len(grid), 1)
        trend, sse = np.repeat((y[1] - y[0])[:, None], len(grid), 1), np.zeros((len(many), len(grid)))
        for t in range(1, len(y)):
            on = slice(0, int((sizes > t).sum()))
            v, was = y[t, on, None], level[on].copy()
            ahead = was + phi * trend[on]
            level[on] = alpha * v + (1 - alpha) * ahead
            trend[on] = beta * (level[on] - was) + (1 - beta) * phi * trend[on]
            sse[on] += (v - ahead) ** 2
        return level, trend, sse

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values("n", ascending=False, kind="stable")
            for low in range(0, len(batch), slots):
                part = batch.iloc[low : low + slots]
                level, trend, sse = smooth([np.asarray(y, float) for y in part["y"]])
                k, rows = np.nanargmin(np.where(np.isnan(sse), np.inf, sse), 1), np.arange(len(part))
                yield pd.DataFrame({"series_id": part["series_id"], "n": part["n"], "alpha": grid[k, 0], "beta": grid[k, 1], "phi": grid[k, 2], "sse": sse[rows, k], "level": level[rows, k], "trend": trend[rows, k]})

    fields = "series_id string, n int, alpha double, beta double, phi double, sse double, level double, trend double"
    return arrays(points).filter(f"n >= {least}").select("series_id", "n", "y").mapInPandas(fit, fields)


def _damped_sum(phi: Column, h: Column) -> Column:
    return F.when(phi >= 1, h.cast("double")).otherwise(phi * (1 - F.pow(phi, h)) / (1 - phi))


def forecast(points: DataFrame, horizon: int, interval: int = 80, season: int | None = None, methods: tuple[str, ...] | None = None) -> DataFrame:
    """(series_id, method, h, point, lower, upper)."""
    simple = simple_fits(points, season, methods)
    parts = [simple.select("series_id", "method", "sigma", "a", "b", "ring", F.lit(1.0).alias("phi"))]
    for name, damped in (("holt", False), ("holt_damped", True)):
        if methods is None or name in methods:
            f = holt_fits(points, damped)
            sigma = F.sqrt(F.col("sse") / F.greatest(F.col("n") - 1 - (3 if damped else 2), F.lit(1)))
            parts.append(f.select("series_id", F.lit(name).alias("method"), sigma.alias("sigma"), F.col("level").alias("a"), F.col("trend").alias("b"), F.array().cast("array<double>").alias("ring"), "phi"))
    fits = parts[0]
    for p in parts[1:]:
        fits = fits.unionByName(p)
    steps = fits.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    ring = F.get("ring", (F.col("h") - 1) % F.size("ring"))
    point = F.when(F.size("ring") > 0, ring).otherwise(F.col("a") + F.col("b") * _damped_sum(F.col("phi"), F.col("h")))
    half = INTERVAL_Z[interval] * F.col("sigma") * F.sqrt(F.col("h"))
    return steps.withColumn("point", point).select("series_id", "method", "h", "point", (F.col("point") - half).alias("lower"), (F.col("point") + half).alias("upper"))


def theta(points: DataFrame, horizon: int) -> DataFrame:
    """Two theta lines around the last value: last + slope·h/4; sigma from one-step forecasts of all prefixes."""
    w = Window.partitionBy("series_id").orderBy("idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    slope = F.regr_slope("value", F.col("idx").cast("double"))
    p = points.withColumn("ahead", F.lag("value").over(w) + 0.25 * slope.over(before))
    error = F.when(F.col("idx") >= 2, F.col("value") - F.col("ahead"))
    fit = p.groupBy("series_id").agg(F.count("*").alias("n"), slope.alias("slope"), F.max_by("value", "idx").alias("last"), F.sqrt(F.avg(error * error)).alias("sigma")).filter("n >= 3")
    out = fit.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("point", F.col("last") + 0.25 * F.col("slope") * F.col("h"))
    half = INTERVAL_Z[80] * F.col("sigma") * F.sqrt("h")
    return out.select("series_id", "h", "point", (F.col("point") - half).alias("lower"), (F.col("point") + half).alias("upper"))


def croston(points: DataFrame) -> DataFrame:
    """(series_id, demand, tsb): smoothed size of the positive values, and size times chance of the TSB variant.

    A smoothed value is a sum in which a demand's weight falls with the demands (or steps) after it, so that partial sums
    do, and no series is gathered. Null values count as no demand, and so do steps between a series' smallest and largest
    ``idx`` that have no row; ``idx`` may start anywhere."""
    after = Window.partitionBy("series_id").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    positive = F.col("value") > 0
    p = points.withColumn("later", F.sum(positive.cast("int")).over(after) - 1).withColumn("age", F.max("idx").over(after) - F.col("idx"))
    kept = lambda rate, of: F.sum(F.when(positive, rate * F.pow(F.lit(1 - rate), of) * F.col("value")))
    out = p.groupBy("series_id").agg(
        F.min_by("value", "idx").alias("first"),
        F.count_if(positive).alias("m"),
        (F.max("age") + 1).alias("n"),
        kept(0.5, F.col("later")).alias("size"),
        kept(0.2, F.col("later")).alias("slow"),
        F.sum(F.when(positive, 0.2 * F.pow(F.lit(0.8), "age"))).alias("share"),
    )
    start = lambda rate: F.coalesce("first", F.lit(0.0)) * F.pow(F.lit(1 - rate), "m")
    size, slow = start(0.5) + F.coalesce("size", F.lit(0.0)), start(0.2) + F.coalesce("slow", F.lit(0.0))
    chance = 0.5 * F.pow(F.lit(0.8), "n") + F.coalesce("share", F.lit(0.0))
    return out.select("series_id", size.alias("demand"), (chance * slow).alias("tsb"))


def box_cox_lambda(points: DataFrame, textbook: bool = True) -> DataFrame:
    """(series_id, lambda): of 41 values in [-2, 2] the one of the largest likelihood, the smallest of equals; positive series only.

    The likelihood's Jacobian is weighed by lambda - 1; without ``textbook`` it isn't, so that the least variance decides."""
    positive = points.join(points.groupBy("series_id").agg(F.min("value").alias("low")).filter("low > 0"), "series_id")
    grid = positive.withColumn("k", F.explode(F.sequence(F.lit(-20), F.lit(20)))).withColumn("lambda", F.col("k") / 10.0)
    x = F.when(F.col("k") == 0, F.ln("value")).otherwise((F.pow("value", F.col("lambda")) - 1) / F.col("lambda"))
    per = grid.withColumn("x", x).groupBy("series_id", "k", "lambda").agg(F.var_pop("x").alias("v"), F.avg(F.ln("value")).alias("m"), F.count("*").alias("n"))
    score = -F.col("n") / 2 * F.ln("v") + (F.col("lambda") - 1 if textbook else F.lit(1.0)) * F.col("n") * F.col("m")
    return per.filter("v > 0").withColumn("score", F.round(score, 6)).groupBy("series_id").agg(F.max_by("lambda", F.struct("score", -F.col("k"))).alias("lambda"))


def holt_winters(points: DataFrame, season: int, horizon: int, interval: int = 80, damped: bool = False, multiplicative: bool = False) -> DataFrame:
    """(series_id, h, point, lower, upper) by Holt-Winters; all grid points of a series run together, series over tasks.

    ``damped`` adds the grid of damping factors. ``multiplicative`` needs positive series: seasons are factors, errors and
    bands are relative, and the lower band ends at 0."""
    phis = DAMPING if damped else [1.0]
    grid = np.array([(a, b, g, p) for a in COARSE for b in COARSE for g in COARSE for p in phis])
    z, used = INTERVAL_Z[interval], 4 if damped else 3

    def smooth(y: np.ndarray, m: int) -> tuple[int, float, float, np.ndarray, float]:
        alpha, beta, gamma, phi = grid.T
        first, second = y[:m].mean(), y[m : 2 * m].mean()
        level, trend = np.full(len(grid), first), np.full(len(grid), (second - first) / m)
        ring, sse = np.tile(y[:m] / first if multiplicative else y[:m] - first, (len(grid), 1)), np.zeros(len(grid))
        for t in range(m, len(y)):
            was, ahead = ring[:, t % m].copy(), level + phi * trend
            expected = ahead * was if multiplicative else ahead + was
            sse += ((y[t] - expected) / (expected if multiplicative else 1.0)) ** 2
            new = alpha * (y[t] / was if multiplicative else y[t] - was) + (1 - alpha) * ahead
            trend = beta * (new - level) + (1 - beta) * phi * trend
            level = new
            ring[:, t % m] = gamma * (y[t] / level if multiplicative else y[t] - level) + (1 - gamma) * was
        k = int(np.nanargmin(sse))
        return k, level[k], trend[k], ring[k], sse[k]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, y in zip(batch["series_id"], batch["y"], strict=True):
                n = len(y)
                if n < 2 * season or multiplicative and min(y) <= 0:
                    continue
                k, level, trend, ring, sse = smooth(np.asarray(y, float), season)
                sigma, h, phi = np.sqrt(sse / max(n - season - used, 1)), np.arange(1, horizon + 1), grid[k, 3]
                far = level + (np.cumsum(phi**h) if damped else h) * trend
                wide, turn = z * sigma * np.sqrt(h), ring[(n + h - 1) % season]
                point = far * turn if multiplicative else far + turn
                lower, upper = (np.maximum(0, point * (1 - wide)), point * (1 + wide)) if multiplicative else (point - wide, point + wide)
                yield pd.DataFrame({"series_id": key, "h": h, "point": point, "lower": lower, "upper": upper})

    return arrays(points).select("series_id", "y").mapInPandas(fit, "series_id string, h int, point double, lower double, upper double")


def box_cox_forecast(points: DataFrame, horizon: int, interval: int = 80) -> DataFrame:
    """(series_id, h, point, lower, upper): Holt on the transformed values, mapped back; the band doesn't widen with h.

    Series with values at or below 0 are shifted to a smallest value of 1 first."""
    low = points.groupBy("series_id").agg(F.min("value").alias("low"))
    shifted = points.join(low, "series_id").withColumn("shift", F.when(F.col("low") <= 0, 1 - F.col("low")).otherwise(0.0)).withColumn("value", F.col("value") + F.col("shift"))
    lam = box_cox_lambda(shifted)
    plain = shifted.join(lam, "series_id").withColumn("value", box_cox(F.col("value"), F.col("lambda")))
    f = holt_fits(plain).join(lam, "series_id").join(shifted.groupBy("series_id").agg(F.first("shift").alias("shift")), "series_id")
    f = f.withColumn("half", INTERVAL_Z[interval] * F.sqrt(F.col("sse") / F.greatest(F.col("n") - 3, F.lit(1)))).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    ahead = F.col("level") + F.col("h") * F.col("trend")
    back = lambda x: inverse_box_cox(x, F.col("lambda")) - F.col("shift")
    return f.select("series_id", "h", back(ahead).alias("point"), back(ahead - F.col("half")).alias("lower"), back(ahead + F.col("half")).alias("upper"))
