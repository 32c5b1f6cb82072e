"""Running sums of deviations, patterns around outliers, stationarity, kind of season, isolation scores."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _series() -> WindowSpec:
    return Window.partitionBy("series_id")


def _by_idx() -> WindowSpec:
    return _series().orderBy("idx")


def cusum(points: DataFrame, drift: float = 0.5, threshold: float | None = None) -> DataFrame:
    """(series_id, idx, value, up, down, detected): sums of standardised deviations beyond ``drift`` that restart at 0.

    A restarting sum is the plain running sum less its running minimum (maximum), so that window functions express it.
    Without ``threshold`` it is five standard deviations of the values, although the sums are standardised."""
    sd = F.stddev_pop("value").over(_series())
    z = (F.col("value") - F.avg("value").over(_series())) / F.when(sd > 0, sd).otherwise(1.0)
    p = points.withColumn("_z", z).withColumn("_limit", F.lit(threshold) if threshold is not None else 5 * sd)
    p = p.withColumn("_a", F.sum(F.col("_z") - drift).over(_by_idx())).withColumn("_b", F.sum(F.col("_z") + drift).over(_by_idx()))
    up = F.col("_a") - F.least(F.lit(0.0), F.min("_a").over(_by_idx()))
    down = F.col("_b") - F.greatest(F.lit(0.0), F.max("_b").over(_by_idx()))
    p = p.withColumn("up", up).withColumn("down", down)
    return p.select("series_id", "idx", "value", "up", "down", (F.greatest("up", -F.col("down")) > F.col("_limit")).alias("detected"))


def anomaly_patterns(points: DataFrame, threshold: float = 2.5, near: int = 5) -> DataFrame:
    """(series_id, idx, score, before, after, pattern) of the points beyond ``threshold`` deviations, by the trends on either side."""
    score = F.abs(F.col("value") - F.avg("value").over(_series())) / F.stddev_pop("value").over(_series())
    slope = lambda a, b: F.coalesce(F.regr_slope("value", "idx").over(_by_idx().rowsBetween(a, b)), F.lit(0.0))
    p = points.select("series_id", "idx", score.alias("score"), slope(-near, -1).alias("before"), slope(1, near).alias("after")).filter(F.col("score") > threshold)
    flat = (F.col("before") == 0) & (F.col("after") == 0)
    pattern = F.when(flat, "isolated_spike").when(F.col("before") != F.col("after"), "trend_reversal").when(F.col("score") > 3, "extreme_outlier").otherwise("moderate_deviation")
    return p.withColumn("pattern", pattern)


def stationarity(points: DataFrame) -> DataFrame:
    """(series_id, statistic, stationary): variance of the values over that of their differences, the first of which is 0."""
    p = points.filter("value is not null").withColumn("_d", F.coalesce(F.col("value") - F.lag("value").over(_by_idx()), F.lit(0.0)))
    out = p.groupBy("series_id").agg((F.var_pop("value") / F.greatest(F.var_pop("_d"), F.lit(0.001))).alias("statistic"))
    return out.withColumn("stationary", F.col("statistic") < 2)


def season_kind(points: DataFrame, season: int) -> DataFrame:
    """(series_id, variation, kind): multiplicative where the phases' mean coefficient of variation is above one half."""
    phase = points.groupBy("series_id", (F.col("idx") % season).alias("phase")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("*").alias("k"))
    usable = (F.col("k") >= 2) & (F.col("mean") > 0)
    out = phase.groupBy("series_id").agg(F.avg(F.when(usable, F.col("sd") / F.col("mean"))).alias("variation"), F.sum("k").alias("n"))
    kind = F.when((F.col("n") >= 2 * season) & (F.col("variation") > 0.5), "multiplicative").otherwise("additive")
    return out.select("series_id", "variation", kind.alias("kind"))


def isolation_scores(points: DataFrame, trees: int = 30, sample: int = 32, seed: int = 1) -> DataFrame:
    """(series_id, idx, value, score): 2 to the power of minus the mean depth at which random cuts isolate a value, over the expected depth.

    Draws depend on (seed, series_id) alone. Near 1: isolated at once; near 0.5 and below: ordinary."""

    def expected(n: int) -> float:
        return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def score(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        v = group["value"].to_numpy(float)
        rng = np.random.default_rng([seed, zlib.crc32(str(group["series_id"].iloc[0]).encode())])
        known = np.sort(v[np.isfinite(v)])
        size = min(sample, len(known))
        limit = int(np.ceil(np.log2(max(size, 2))))
        depth = np.zeros(len(v))

        def split(drawn: np.ndarray, rows: np.ndarray, level: int) -> None:
            if level >= limit or len(drawn) < 2 or drawn[0] == drawn[-1] or not len(rows):
                depth[rows] += level + expected(len(drawn))
                return
            cut = rng.uniform(drawn[0], drawn[-1])
            left = v[rows] < cut
            split(drawn[drawn < cut], rows[left], level + 1)
            split(drawn[drawn >= cut], rows[~left], level + 1)

        for _ in range(trees):
            split(np.sort(rng.choice(known, size, replace=False)), np.arange(len(v)), 0)
        group["score"] = np.where(np.isfinite(v), 2 ** (-depth / trees / max(expected(size), 1e-9)), np.nan)
        return group[["series_id", "idx", "value", "score"]]

    return points.select("series_id", F.col("idx").cast("bigint").alias("idx"), "value").groupBy("series_id").applyInPandas(score, "series_id string, idx bigint, value double, score double")
