"""What to do with a series: traits, the method they suggest, seasons, first weights, when to refit, alerts, and coming steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.operators.features import seasonal_lags
from tidemark.operators.prepare import dominant_step


def _series(*order: str) -> WindowSpec:
    w = Window.partitionBy("series_id")
    return w.orderBy(*order) if order else w


def _middle(rows: DataFrame, column: str) -> DataFrame:
    """(series_id, middle): the value at place floor(n / 2) in order."""
    ranked = rows.withColumn("_k", F.row_number().over(_series(column)) - 1).withColumn("_n", F.count("*").over(_series()))
    return ranked.filter("_k = floor(_n / 2)").select("series_id", F.col(column).alias("middle"))


def traits(points: DataFrame) -> DataFrame:
    """(series_id, n, trend, acf1, zeros, cv, outliers) of the known values; series of under five give none.

    ``trend`` is the slope in deviations a step, ``outliers`` counts values whose distance from the median exceeds 3.5
    when measured by the median distance. ``acf1`` divides the products of neighbours by n - 1 and the population variance."""
    p = points.filter("value is not null").select("series_id", "idx", "value")
    v = F.col("value")
    p = p.join(_middle(p, "value"), "series_id").withColumn("off", F.abs(v - F.col("middle"))).drop("middle")
    p = p.join(_middle(p, "off"), "series_id").withColumn("far", (0.6745 * F.col("off") / F.when(F.col("middle") > 0, F.col("middle")).otherwise(1e-10) > 3.5).cast("int"))
    p = p.withColumn("d", v - F.avg("value").over(_series())).withColumn("b", F.lag("d").over(_series("idx")))
    out = p.groupBy("series_id").agg(
        F.count("*").alias("n"),
        F.coalesce(F.try_divide(F.abs(F.regr_slope(v, F.col("idx").cast("double"))), F.stddev_pop(v)), F.lit(0.0)).alias("trend"),
        F.coalesce(F.try_divide(F.sum(F.col("d") * F.col("b")), (F.count("*") - 1) * F.var_pop(v)), F.lit(0.0)).alias("acf1"),
        F.avg((F.abs(v) < 1e-10).cast("double")).alias("zeros"),
        (F.stddev_pop(v) / F.when(F.avg(v) == 0, 1.0).otherwise(F.abs(F.avg(v)))).alias("cv"),
        F.sum("far").alias("outliers"),
    )
    return out.filter("n >= 5")


def recommendation(known: DataFrame) -> DataFrame:
    """(series_id, method, alternatives, reasons, confidence) from ``traits``; the first rule that holds names the method."""
    n, trend, season, zeros = F.col("n"), F.col("trend"), F.abs("acf1"), F.col("zeros")
    seasonal, trending, sparse = season > 0.3, trend > 0.01, zeros > 0.3
    strong = seasonal & (season > 0.4)
    rules = [
        (sparse, "croston"),
        (strong & (trend > 0.2), "holt_winters"),
        (strong & trending, "holt"),
        (strong, "seasonal_naive"),
        (trend > 0.15, "drift"),
        (F.col("outliers") > 0.05 * n, "robust_mean"),
        (F.col("cv") > 1.5, "theta"),
    ]
    method = F.lit("mean")
    for test, name in reversed(rules):
        method = F.when(test, name).otherwise(method)
    others = F.array_compact(
        F.array(
            F.when(~seasonal & (season > 0.2), "seasonal_naive"),
            F.when(seasonal | trending, "stl"),
            F.lit("theta"),
            F.lit("ensemble"),
            F.when(~sparse & (zeros > 0.1), "boot_croston"),
        )
    )
    reasons = F.array_compact(
        F.array(
            F.when(seasonal, "strong seasonality"),
            F.when(trend > 0.15, "significant trend"),
            F.when(sparse, "intermittent demand"),
            F.when(n > 100, "long history"),
            F.when(F.col("outliers") == 0, "no outliers"),
        )
    )
    add = lambda test, by: F.when(test, by).otherwise(0.0)
    sure = 0.6 + add(season > 0.5, 0.1) + add(trend > 0.3, 0.1) + add(zeros > 0.4, 0.1) + add(n > 200, 0.05) + add(n > 500, 0.05)
    sure = sure - add(F.col("outliers") > 0.1 * n, 0.1) - add(n < 30, 0.1)
    told = F.when(F.size(reasons) > 0, F.array_join(reasons, ", ")).otherwise("few signals")
    return known.select("series_id", method.alias("method"), F.array_join(F.slice(others, 1, 3), ",").alias("alternatives"), told.alias("reasons"), F.least(F.lit(0.95), F.greatest(F.lit(0.4), sure)).alias("confidence"))


def starting_weights(known: DataFrame) -> DataFrame:
    """(series_id, alpha, beta, gamma): first smoothing weights from ``traits``; calm series start lower, trends raise beta, seasons gamma."""
    calm = F.when(F.col("cv") > 1.5, 1.0).otherwise(0.7)
    beta, season = 0.1 * calm, F.abs("acf1")
    return known.select("series_id", (0.3 * calm).alias("alpha"), F.when(F.col("trend") > 0.3, F.least(F.lit(0.5), 1.3 * beta)).otherwise(beta).alias("beta"), F.when(season > 0.3, F.least(F.lit(1.0), 0.3 * (1 + season))).otherwise(0.3).alias("gamma"))


def auto_seasons(points: DataFrame, max_lag: int, harmonics: int = 2, least: float = 0.1, z: float = 1.96) -> DataFrame:
    """(series_id, season): peaks of the autocorrelation that aren't a multiple, up to ``harmonics`` times, of a shorter season kept.

    A series has at most ``max_lag`` peaks, which fold in order in one row."""
    listed = seasonal_lags(points, max_lag, least, z).groupBy("series_id").agg(F.array_sort(F.collect_list(F.col("lag").cast("int"))).alias("lags"))

    def keep(kept: Column, lag: Column) -> Column:
        again = F.exists(kept, lambda s: (lag % s == 0) & (lag / s <= harmonics))
        return F.when(again, kept).otherwise(F.concat(kept, F.array(lag)))

    return listed.select("series_id", F.explode(F.aggregate("lags", F.array().cast("array<int>"), keep)).alias("season"))


def seasonal_methods(seasons: DataFrame) -> DataFrame:
    """(series_id, methods) from seasons (series_id, season, acf): by their number, and by the strength and length of the strongest."""
    top = seasons.groupBy("series_id").agg(F.count("*").alias("k"), F.max(F.struct("acf", "season")).alias("top"))
    strong = F.col("top.acf") > 0.8
    one = F.concat(F.when(strong, F.array(F.lit("seasonal_naive"), F.lit("holt_winters"))).otherwise(F.array().cast("array<string>")), F.when(strong & (F.col("top.season") > 20), F.array(F.lit("snaive"))).otherwise(F.array().cast("array<string>")), F.array(F.lit("stl")))
    more = F.array(*map(F.lit, ("stl", "ms_holt_winters", "fourier_arima")))
    return top.select("series_id", F.array_join(F.concat(F.array(F.lit("naive"), F.lit("theta")), F.when(F.col("k") >= 2, more).otherwise(one)), ",").alias("methods"))


def refresh_decisions(points: DataFrame, every: int = 1, recent: int = 30, threshold: float = 3.0, least: int = 10) -> DataFrame:
    """(series_id, idx, refresh, reason) as each point arrives: insufficient-data, no-fit, drift, new-points or below-threshold.

    The first fit is made at ``least`` points, the next ones after ``every`` new points each; drift is the distance of the
    last ``recent`` values' mean from that of all so far, in deviations, and is judged from 20 points on, 10 of them among the last 2 · ``recent``."""
    w = _series("idx")
    so_far, late = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1 - recent, 0)
    z = F.try_divide(F.abs(F.avg("value").over(late) - F.avg("value").over(so_far)), F.stddev_samp("value").over(so_far))
    seen = F.count("value").over(so_far)
    z = F.when((seen >= 20) & (F.least(seen, F.lit(2 * recent)) >= 10), z)
    since = F.col("idx") - (least - 1)
    reason = F.when(since < 0, "insufficient-data").when(since == 0, "no-fit").when(since % every != 0, "below-threshold").when(F.round(z, 9) > threshold, "drift").otherwise("new-points")
    return points.select("series_id", "idx", reason.alias("reason")).select("series_id", "idx", F.col("reason").isin("no-fit", "drift", "new-points").alias("refresh"), "reason")


def anomaly_alerts(points: DataFrame, times: float = 3.0, least: int = 5) -> DataFrame:
    """(series_id, idx, value, z): readings farther than ``times`` deviations from the mean of all readings before, of which there are ``least``."""
    before = _series("idx").rowsBetween(Window.unboundedPreceding, -1)
    z = F.try_divide(F.col("value") - F.avg("value").over(before), F.stddev_samp("value").over(before))
    rows = points.select("series_id", "idx", "value", z.alias("z"), F.count("value").over(before).alias("seen"))
    return rows.filter((F.col("seen") >= least) & (F.abs("z") > times)).select("series_id", "idx", "value", "z")


def fold_summary(folds: DataFrame) -> DataFrame:
    """(series_id, method, folds, mean, sd) of the root mean squared error over the folds of ``rolling_origin``."""
    return folds.groupBy("series_id", "method").agg(F.count("rmse").alias("folds"), F.avg("rmse").alias("mean"), F.stddev_samp("rmse").alias("sd"))


def future_steps(points: DataFrame, horizon: int) -> DataFrame:
    """(series_id, h, t, label) of the coming steps at the most common step; labels are hours for steps under twelve hours, else days."""
    last = points.groupBy("series_id").agg(F.unix_millis(F.max("t").cast("timestamp")).alias("last")).join(dominant_step(points), "series_id")
    steps = last.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("t", F.timestamp_millis(F.col("last") + F.col("h") * F.col("step_ms")))
    return steps.select("series_id", "h", "t", F.when(F.col("step_ms") < 43_200_000, F.date_format("t", "yyyy-MM-dd HH:mm")).otherwise(F.date_format("t", "yyyy-MM-dd")).alias("label"))
