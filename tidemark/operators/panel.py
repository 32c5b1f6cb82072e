"""Panels: closed-form methods over many series as partial aggregates, their errors by category, tests, ensembles, bottom-up checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import norm_cdf

METHODS = ("naive", "mean", "drift", "linear")


def panel_forecasts(points: DataFrame, test: int, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(by…, idx, h, value, method, point) of the last ``test`` points of each series of at least test + 2 points.

    A series is never gathered: last, first, mean and line are aggregates of its rows."""
    n = points.groupBy(*by).agg((F.max("idx") + 1).alias("n"))
    rows = points.join(n, list(by)).filter(F.col("n") >= test + 2)
    train = rows.filter(F.col("idx") < F.col("n") - test)
    fit = train.groupBy(*by).agg(F.max_by("value", "idx").alias("last"), F.min_by("value", "idx").alias("first"), F.avg("value").alias("mean"), F.regr_slope("value", F.col("idx").cast("double")).alias("slope"), F.regr_intercept("value", F.col("idx").cast("double")).alias("level"))
    held = rows.filter(F.col("idx") >= F.col("n") - test).join(fit, list(by))
    h = F.col("idx") - F.col("n") + test + 1
    point = {"naive": F.col("last"), "mean": F.col("mean"), "drift": F.col("last") + h * F.try_divide(F.col("last") - F.col("first"), F.col("n") - test - 1), "linear": F.col("level") + F.col("slope") * F.col("idx")}
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), p.alias("point")) for m, p in point.items())))
    return held.select(*by, "idx", h.alias("h"), "value", each.alias("m")).select(*by, "idx", "h", "value", "m.method", "m.point")


def compare_methods(forecasts: DataFrame, category: str, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(method, category, series, rmse, mae, mape): errors of each series, averaged over the series of a category."""
    e = F.col("point") - F.col("value")
    per = forecasts.groupBy("method", *dict.fromkeys((category, *by))).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(F.abs(F.try_divide(e, F.col("value"))) * 100).alias("mape"))
    return per.groupBy("method", F.col(category).alias("category")).agg(F.count("*").alias("series"), *(F.avg(c).alias(c) for c in ("rmse", "mae", "mape")))


def panel_dm(forecasts: DataFrame, a: str, b: str, category: str) -> DataFrame:
    """(category, n, statistic, p, significant, better) of the squared losses of two methods."""
    loss = lambda m: F.max(F.when(F.col("method") == m, F.pow(F.col("point") - F.col("value"), 2)))
    keys = [c for c in forecasts.columns if c not in ("method", "point", "value")]
    d = forecasts.groupBy(*keys).agg((loss(a) - loss(b)).alias("d"))
    out = d.groupBy(F.col(category).alias("category")).agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.var_samp("d").alias("v"))
    out = out.withColumn("statistic", F.try_divide(F.col("mean"), F.sqrt(F.col("v") / F.col("n")))).withColumn("p", 2 * (1 - norm_cdf(F.abs("statistic"))))
    return out.select("category", "n", "statistic", "p", (F.col("p") < 0.05).alias("significant"), F.when(F.col("mean") > 0, b).otherwise(a).alias("better"))


def batch_summary(forecasts: DataFrame, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(method, runs, successes, avg_sigma, min_sigma, max_sigma): a run succeeds if it has a spread."""
    per = forecasts.groupBy("method", *by).agg(F.stddev_samp(F.col("point") - F.col("value")).alias("sigma"))
    return per.groupBy("method").agg(F.count("*").alias("runs"), F.count("sigma").alias("successes"), F.avg("sigma").alias("avg_sigma"), F.min("sigma").alias("min_sigma"), F.max("sigma").alias("max_sigma"))


def ensembles(forecasts: DataFrame, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(by…, h, simple, trimmed): the mean of all methods, and of those that are neither the smallest nor the largest."""
    out = forecasts.groupBy(*by, "h").agg(F.avg("point").alias("simple"), F.sum("point").alias("s"), F.min("point").alias("low"), F.max("point").alias("high"), F.count("point").alias("k"))
    return out.select(*by, "h", "simple", F.when(F.col("k") > 2, (F.col("s") - F.col("low") - F.col("high")) / (F.col("k") - 2)).otherwise(F.col("simple")).alias("trimmed"))


def bottom_up_errors(forecasts: DataFrame, node: str) -> DataFrame:
    """(node, method, rmse) of sums of the bottom forecasts against sums of the bottom values."""
    up = forecasts.groupBy(node, "method", "idx").agg(F.sum("point").alias("point"), F.sum("value").alias("value"))
    return up.groupBy(F.col(node).alias("node"), "method").agg(F.sqrt(F.avg(F.pow(F.col("point") - F.col("value"), 2))).alias("rmse"))
