"""Preparation of series: steps, resampling, trend and season, weights, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def _series() -> WindowSpec:
    return Window.partitionBy("series_id")


def _by_idx() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("idx")


def dominant_step(points: DataFrame) -> DataFrame:
    """(series_id, step_ms): the most frequent positive step; of several, the one that comes first."""
    ms = F.unix_millis(F.col("t").cast("timestamp"))
    steps = points.withColumn("d", ms - F.lag(ms).over(_by_idx())).filter("d > 0")
    counts = steps.groupBy("series_id", "d").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    return counts.groupBy("series_id").agg(F.max_by("d", F.struct("n", -F.col("first"))).alias("step_ms"))


def resample(points: DataFrame, step_ms: int) -> DataFrame:
    """(series_id, bin, mean, sum, first, last, min, max, n) of bins of ``step_ms`` from the first point; empty bins are absent."""
    ms = F.unix_millis(F.col("t").cast("timestamp"))
    binned = points.withColumn("bin", F.floor((ms - F.min(ms).over(_series())) / step_ms))
    v = F.col("value")
    return binned.groupBy("series_id", "bin").agg(
        F.avg(v).alias("mean"), F.sum(v).alias("sum"), F.min_by(v, "idx").alias("first"), F.max_by(v, "idx").alias("last"), F.min(v).alias("min"), F.max(v).alias("max"), F.count("*").alias("n")
    )


def summary(points: DataFrame) -> DataFrame:
    ms = F.unix_millis(F.col("t").cast("timestamp"))
    steps = points.withColumn("d", ms - F.lag(ms).over(_by_idx()))
    per = steps.groupBy("series_id").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.count_if(F.col("d") <= 0).alias("duplicates"))
    typical = dominant_step(points)
    irregular = steps.join(typical, "series_id").groupBy("series_id").agg(F.count_if(F.col("d") > 1.5 * F.col("step_ms")).alias("gaps"))
    return per.join(typical, "series_id", "left").join(irregular, "series_id", "left")


def detrended(points: DataFrame) -> DataFrame:
    """Adds ``detrended``: the residual of the line over idx (the value where fewer than three points)."""
    v, i = F.col("value"), F.col("idx").cast("double")
    slope, n = F.regr_slope(v, i).over(_series()), F.count("*").over(_series())
    line = F.avg(v).over(_series()) + slope * (i - F.avg(i).over(_series()))
    return points.withColumn("detrended", F.when(n < 3, v).otherwise(v - line))


def deseasonalised(points: DataFrame, season: int) -> DataFrame:
    """Adds ``deseasonalised``: value less its phase's mean residual, centred by the mean of the phases' sums."""
    d = detrended(points).withColumn("phase", F.col("idx") % season)
    phase = Window.partitionBy("series_id", "phase")
    d = d.withColumn("phase_mean", F.avg("detrended").over(phase))
    centre = F.sum("detrended").over(_series()) / season
    return d.withColumn("deseasonalised", F.col("value") - (F.col("phase_mean") - centre))


def train_test(points: DataFrame, test: int) -> DataFrame:
    """Adds ``is_test`` for the last ``test`` points."""
    return points.withColumn("is_test", F.col("idx") >= F.count("*").over(_series()) - test)


def decay_weighted(points: DataFrame, rho: float) -> DataFrame:
    """(series_id, mean, variance, half_life) with weights rho^(n - t), normalised."""
    n = F.count("*").over(_series())
    w = points.withColumn("w", F.pow(F.lit(rho), n - F.col("idx") - 1))
    w = w.withColumn("w", F.col("w") / F.sum("w").over(_series())).withColumn("m", F.sum(F.col("w") * F.col("value")).over(_series()))
    return w.groupBy("series_id").agg(F.first("m").alias("mean"), F.sum(F.col("w") * F.pow(F.col("value") - F.col("m"), 2)).alias("variance")).withColumn("half_life", F.ln(F.lit(0.5)) / F.ln(F.lit(rho)))


def floor_quantile(points: DataFrame, *ps: float) -> DataFrame:
    """(series_id, q...): sorted[floor(n * p)], without interpolation."""
    per = points.groupBy("series_id").agg(F.array_sort(F.collect_list("value")).alias("v"))
    return per.select("series_id", *(F.get("v", F.least(F.floor(F.size("v") * F.lit(p)), F.size("v") - 1).cast("int")).alias(f"q{round(p * 100)}") for p in ps))


def differences(points: DataFrame, lag: int = 1) -> DataFrame:
    return points.withColumn("diff", F.col("value") - F.lag("value", lag).over(_by_idx()))


def autocorrelation(points: DataFrame, lags: int) -> DataFrame:
    """(series_id, lag, acf) for lags 1 .. ``lags``: products of centred values by their total square."""
    c = points.withColumn("c", F.col("value") - F.avg("value").over(_series()))
    lagged = c.select("series_id", "c", *(F.lag("c", k).over(_by_idx()).alias(f"l{k}") for k in range(1, lags + 1)))
    wide = lagged.groupBy("series_id").agg(F.sum(F.col("c") * F.col("c")).alias("total"), *(F.sum(F.col("c") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, lags + 1)))
    long = wide.select("series_id", "total", F.posexplode(F.array(*(f"s{k}" for k in range(1, lags + 1)))).alias("k", "s"))
    return long.select("series_id", (F.col("k") + 1).alias("lag"), F.try_divide("s", "total").alias("acf"))
