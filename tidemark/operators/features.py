"""Features and seasons, recommendation, ensembles, drift, and differences between reports."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.operators.evaluate import backtest
from tidemark.operators.models import forecast
from tidemark.operators.prepare import autocorrelation
from tidemark.sources.tables import arrays


def _series() -> WindowSpec:
    return Window.partitionBy("series_id")


def _by_idx() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("idx")


def fourier(points: DataFrame, season: int, harmonics: int) -> DataFrame:
    """Adds k (1 .. harmonics), s and c: sine and cosine of 2·pi·k·idx/season."""
    out = points.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(harmonics))))
    angle = 2 * math.pi * F.col("k") * F.col("idx") / season
    return out.withColumn("s", F.sin(angle)).withColumn("c", F.cos(angle))


def seasonal_lags(points: DataFrame, max_lag: int, least: float = 0.1, z: float = 1.96) -> DataFrame:
    """(series_id, lag, acf): local maxima of the autocorrelation, by mean product over variance, above ``least`` and z/sqrt(n)."""
    sizes = points.groupBy("series_id").agg(F.count("*").alias("n"))
    acf = autocorrelation(points, max_lag).join(sizes, "series_id").withColumn("acf", F.col("acf") * F.col("n") / (F.col("n") - F.col("lag")))
    w = Window.partitionBy("series_id").orderBy("lag")
    peaks = acf.withColumn("before", F.lag("acf").over(w)).withColumn("after", F.lead("acf").over(w))
    return peaks.filter((F.col("acf") > F.col("before")) & (F.col("acf") > F.col("after")) & (F.col("acf") > F.greatest(F.lit(least), z / F.sqrt("n")))).select("series_id", "lag", "acf")


def characteristics(points: DataFrame) -> DataFrame:
    p = points.withColumn("b", F.lag("value").over(_by_idx())).withColumn("m", F.avg("value").over(_series()))
    v, i = F.col("value"), F.col("idx").cast("double")
    return p.groupBy("series_id").agg(
        F.count("*").alias("n"),
        F.regr_slope(v, i).alias("slope"),
        F.regr_r2(v, i).alias("trend_r2"),
        F.try_divide(F.stddev_pop(v), F.avg(v)).alias("cv"),
        F.avg((v == 0).cast("double")).alias("zero_ratio"),
        F.try_divide(F.sum((v - F.col("m")) * (F.col("b") - F.col("m"))), F.sum(F.pow(v - F.col("m"), 2))).alias("acf1"),
    )


def recommend(traits: DataFrame) -> DataFrame:
    """(series_id, method, reason): the first rule that holds."""
    rules = [
        (F.col("n") < 10, "naive", "very short series"),
        (F.col("zero_ratio") > 0.3, "croston", "intermittent demand"),
        (F.col("trend_r2") > 0.5, "holt", "strong trend"),
        (F.col("acf1") > 0.5, "holt", "strong persistence"),
        (F.col("cv") < 0.1, "mean", "stable level"),
    ]
    method, reason = F.lit("theta"), F.lit("no dominant trait")
    for test, m, r in reversed(rules):
        method, reason = F.when(test, m).otherwise(method), F.when(test, r).otherwise(reason)
    return traits.select("series_id", method.alias("method"), reason.alias("reason"))


def ensemble(points: DataFrame, test: int, horizon: int, methods: tuple[str, ...] = ("naive", "mean", "drift", "linear", "holt")) -> DataFrame:
    """(series_id, h, point, lower, upper): forecasts weighed by the inverse of their hold-out error."""
    error = backtest(points, test, methods=methods).select("series_id", "method", (1 / F.greatest("rmse", F.lit(1e-9))).alias("w"))
    f = forecast(points, horizon, methods=methods).join(error, ["series_id", "method"])
    return f.groupBy("series_id", "h").agg(*((F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in ("point", "lower", "upper")))


def drift(points: DataFrame, recent: int = 30, threshold: float = 3.0) -> DataFrame:
    """(series_id, z, drift): distance of the last ``recent`` values' mean from the mean, in deviations."""
    n = F.count("*").over(_series())
    p = points.withColumn("late", F.col("idx") >= n - recent)
    out = p.groupBy("series_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.avg(F.when(F.col("late"), F.col("value"))).alias("recent"))
    z = F.try_divide(F.abs(F.col("recent") - F.col("mean")), F.col("sd"))
    return out.select("series_id", z.alias("z"), F.coalesce(z > threshold, F.lit(False)).alias("drift"))


def changes(old: DataFrame, new: DataFrame, key: str, value: str, tolerance: float = 1e-10) -> DataFrame:
    """(key, change, delta) of two reports: added, removed, changed or same."""
    a, b = old.select(F.col(key).alias("k"), F.col(value).alias("x")), new.select(F.col(key).alias("key"), F.col(value).alias("y"))
    both = a.join(b, F.col("k") == F.col("key"), "full_outer")
    change = F.when(F.col("k").isNull(), "added").when(F.col("key").isNull(), "removed").when(F.abs(F.col("y") - F.col("x")) > tolerance, "changed").otherwise("same")
    return both.select(F.coalesce("k", "key").alias("key"), change.alias("change"), (F.col("y") - F.col("x")).alias("delta"))


def periodogram(points: DataFrame) -> DataFrame:
    """(series_id, k, frequency, power) of the values padded with zeros to a power of two, power by the number of values.

    A fast transform per series, in tasks; a null counts as 0, a series of fewer than three values gives no row."""

    def transform(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, y in zip(batch["series_id"], batch["y"], strict=True):
                size = 1 << (len(y) - 1).bit_length()
                power = np.abs(np.fft.rfft(np.nan_to_num(np.asarray(y, float)), size)) ** 2 / len(y)
                k = np.arange(1, size // 2)
                yield pd.DataFrame({"series_id": key, "k": k, "frequency": k / size, "power": power[k]})

    return arrays(points).filter("n >= 3").select("series_id", "y").mapInPandas(transform, "series_id string, k int, frequency double, power double")


def elapsed_weekday(points: DataFrame, step_ms: int) -> DataFrame:
    """Adds weekday (0 .. 6, days since the first point modulo a week) and weekend (weekday of 5 or more), by idx and step."""
    day = F.floor(F.pmod(F.col("idx").cast("bigint") * step_ms, F.lit(7 * 86_400_000)) / 86_400_000).cast("int")
    return points.withColumn("weekday", day).withColumn("weekend", (F.col("weekday") >= 5).cast("int"))


def last_points(points: DataFrame, n: int) -> DataFrame:
    """The last ``n`` points of each series."""
    w = Window.partitionBy("series_id").orderBy(F.col("idx").desc())
    return points.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def error_spikes(errors: DataFrame, ratio: float = 2.0, recent: int = 5) -> DataFrame:
    """(series_id, recent, before, ratio): series whose mean error of the last ``recent`` points is ``ratio`` times that before."""
    n = F.count("*").over(_series())
    p = errors.withColumn("late", F.col("idx") >= n - recent)
    out = p.groupBy("series_id").agg(F.avg(F.when(F.col("late"), F.col("value"))).alias("recent"), F.avg(F.when(~F.col("late"), F.col("value"))).alias("before"))
    return out.withColumn("ratio", F.try_divide("recent", "before")).filter(F.col("ratio") >= ratio)
