"""One report of the quality of series: detectors united with their severity, confidence, requirements, and what is most conspicuous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _series() -> Window:
    return Window.partitionBy("series_id")


def severity(ratio: Column) -> Column:
    """1 moderate, 2 severe, 3 extreme, by how many times a score exceeds its threshold."""
    return F.when(ratio >= 3, 3).when(ratio >= 2, 2).otherwise(1)


def anomaly_union(points: DataFrame, mad: float = 3.5, iqr: float = 1.5, z: float = 3.0) -> DataFrame:
    """(series_id, idx, value, severity, methods) of points that any detector flags; the severest counts. Series of under five points give none.

    Medians and quartiles are aggregates with linear interpolation; nothing is gathered."""
    v = F.col("value")
    stats = points.groupBy("series_id").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.expr("percentile(value, array(0.25, 0.5, 0.75))").alias("q"))
    rows = points.join(stats.filter("n >= 5"), "series_id").withColumn("deviation", F.abs(v - F.col("q")[1]))
    spread = rows.groupBy("series_id").agg(F.expr("percentile(deviation, 0.5)").alias("mad"))
    rows = rows.join(spread, "series_id")
    reach = (F.col("q")[2] - F.col("q")[0]) * iqr
    beyond = F.greatest(F.col("q")[0] - reach - v, v - F.col("q")[2] - reach)
    tests = {"mad": F.try_divide(0.6745 * F.col("deviation"), F.col("mad")) / mad, "iqr": F.when(beyond > 0, 1 + F.coalesce(F.try_divide(beyond, reach), F.lit(2.0))), "zscore": F.try_divide(F.abs(v - F.col("mean")), F.col("sd")) / z}
    found = F.array_compact(F.array(*(F.when(ratio > 1, F.struct(F.lit(name).alias("method"), severity(ratio).alias("severity"))) for name, ratio in tests.items())))
    out = rows.select("series_id", "idx", "value", found.alias("found")).filter(F.size("found") > 0)
    return out.select("series_id", "idx", "value", F.array_max("found.severity").alias("severity"), F.array_join("found.method", ",").alias("methods"))


def deduplicated(anomalies: DataFrame) -> DataFrame:
    """One row for each (series_id, rounded idx, rounded value), the first by method."""
    w = Window.partitionBy("series_id", F.round("idx"), F.round("value")).orderBy("methods", "idx")
    return anomalies.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def confidence_buckets(points: DataFrame) -> DataFrame:
    """(series_id, high, medium, low): points by the confidence of their z-score, min(0.95, exp(-2 / z)), from 0.8 and 0.5."""
    z = F.try_divide(F.abs(F.col("value") - F.avg("value").over(_series())), F.stddev_pop("value").over(_series()))
    c = F.least(F.lit(0.95), F.when(z > 0, F.exp(-2 / z)).otherwise(0.0))
    rows = points.select("series_id", c.alias("c"))
    return rows.groupBy("series_id").agg(F.count_if(F.col("c") >= 0.8).alias("high"), F.count_if((F.col("c") >= 0.5) & (F.col("c") < 0.8)).alias("medium"), F.count_if(F.col("c") < 0.5).alias("low"))


def top_points(points: DataFrame, k: int = 10) -> DataFrame:
    """(series_id, rank, idx, z) of the ``k`` points of each series that are farthest from its mean."""
    stats = points.groupBy("series_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    rows = points.join(stats, "series_id").withColumn("z", F.try_divide(F.col("value") - F.col("mean"), F.col("sd")))
    ranked = rows.withColumn("rank", F.row_number().over(_series().orderBy(F.desc(F.round(F.abs("z"), 6)), "idx")))
    return ranked.filter(F.col("rank") <= k).select("series_id", "rank", "idx", "z")


def requirements(points: DataFrame, season: int, least: int = 30, confidence: float = 0.95) -> DataFrame:
    """(series_id, n, sufficient, reason, window, least_window, test_size): whether a series is long enough, and windows for it."""
    window = max(30, 3 * season if season else 90)
    n = F.col("n")
    short = F.when(n < least, F.concat(F.lit("Insufficient observations: "), n.cast("string"), F.lit(f" < {least}"))).when((F.lit(season) > 0) & (n < 2 * season), F.concat(F.lit("Need more history for seasonality: "), n.cast("string"), F.lit(f" < {2 * season}")))
    out = points.groupBy("series_id").agg(F.count("value").alias("n"))
    return out.select("series_id", "n", short.isNull().alias("sufficient"), F.coalesce(short, F.lit("")).alias("reason"), F.lit(window).alias("window"), F.lit(window * (1.5 if confidence == 0.99 else 1.0)).alias("least_window"), F.greatest(F.lit(1), F.least(F.lit(365), F.floor(n / 5 + 0.5))).alias("test_size"))


def differenced(points: DataFrame, d: int = 2) -> DataFrame:
    """(series_id, idx, value): differences taken ``d`` times."""
    out = points.select("series_id", "idx", "value")
    for _ in range(d):
        out = out.withColumn("value", F.col("value") - F.lag("value").over(_series().orderBy("idx"))).filter("value is not null")
    return out


def naive_baseline(points: DataFrame, horizon: int, season: int = 0) -> DataFrame:
    """(series_id, h, point): the last value, or the last season's, with the drift over the last quarter (three steps at least)."""
    n = points.groupBy("series_id").agg((F.max("idx") + 1).alias("n"))
    n = n.withColumn("k", F.least(F.col("n") - 1, F.greatest(F.lit(3), F.floor(F.col("n") / 4))))
    rows = points.join(n, "series_id")
    at = lambda back: F.max(F.when(F.col("idx") == F.col("n") - 1 - back, F.col("value")))
    drift = F.coalesce(F.try_divide(at(F.lit(0)) - at(F.col("k")), F.first("k")), F.lit(0.0))
    ends = rows.groupBy("series_id").agg(F.first("n").alias("n"), at(F.lit(0)).alias("last"), drift.alias("drift"), *(at(F.lit(season - 1 - j)).alias(f"s{j}") for j in range(season)))
    steps = ends.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    plain = F.col("last") + F.col("drift") * F.col("h")
    if season < 2:
        return steps.select("series_id", "h", plain.alias("point"))
    phase = (F.col("h") - 1) % season
    seasonal = F.element_at(F.array(*(F.col(f"s{j}") for j in range(season))), (phase + 1).cast("int")) + F.col("drift") * (season - phase + F.col("h") - 1)
    return steps.select("series_id", "h", F.when(F.col("n") >= 2 * season, seasonal).otherwise(plain).alias("point"))


def lower_bound(points: DataFrame, moments: DataFrame) -> DataFrame:
    """(series_id, at, idx, value) for moments (at): the first point at or after it, the last where there is none, null before the first.

    Points and moments are sorted together once for each series, not joined by range."""
    span = points.groupBy("series_id").agg(F.min("t").alias("low"), F.max("idx").alias("last"), F.max_by("value", "idx").alias("last_value"))
    asked = span.crossJoin(F.broadcast(moments)).select("series_id", F.col("at").alias("t"), F.lit(None).cast("bigint").alias("idx"), F.lit(None).cast("double").alias("value"), "low", "last", "last_value", F.lit(True).alias("asked"))
    seen = points.select("series_id", F.col("t").cast(asked.schema["t"].dataType).alias("t"), F.col("idx").cast("bigint").alias("idx"), "value")
    both = asked.unionByName(seen, allowMissingColumns=True)
    after = _series().orderBy(F.col("t"), F.col("asked").desc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    next_ = F.first(F.when(F.col("asked").isNull(), F.struct("idx", "value")), ignorenulls=True).over(after)
    out = both.withColumn("next", next_).filter("asked")
    inside = F.col("t") >= F.col("low")
    return out.select("series_id", F.col("t").alias("at"), F.when(inside, F.coalesce("next.idx", "last")).alias("idx"), F.when(inside, F.coalesce("next.value", "last_value")).alias("value"))


def seasonal_mase(points: DataFrame, forecasts: DataFrame, season: int) -> DataFrame:
    """(series_id, mase) of forecasts (series_id, idx, point): mean error by the mean seasonal change of the actuals; 0 where nothing changes."""
    change = F.abs(F.col("value") - F.lag("value", season).over(_series().orderBy("idx")))
    naive = points.select("series_id", change.alias("c")).groupBy("series_id").agg(F.avg("c").alias("naive"))
    e = points.join(forecasts, ["series_id", "idx"]).groupBy("series_id").agg(F.avg(F.abs(F.col("value") - F.col("point"))).alias("mae"))
    return e.join(naive, "series_id").select("series_id", F.coalesce(F.try_divide("mae", "naive"), F.lit(0.0)).alias("mase"))


def varying(points: DataFrame) -> DataFrame:
    """The points of series that vary."""
    kept = points.groupBy("series_id").agg(F.stddev_pop("value").alias("sd")).filter("sd > 0")
    return points.join(kept, "series_id", "left_semi")


def thinned_peaks(peaks: DataFrame, distance: int = 3) -> DataFrame:
    """(series_id, idx, height) of peaks (series_id, idx, height): of peaks nearer than ``distance`` to the last kept one the higher stays in its place.

    A fold over the peaks of a series, which are few."""
    listed = peaks.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("idx", "height"))).alias("p"))
    last = lambda a: F.element_at(a, -1)
    fold = F.aggregate("p", F.slice("p", 1, 0), lambda a, x: F.when(F.size(a) == 0, F.array(x)).when(x["idx"] - last(a)["idx"] >= distance, F.concat(a, F.array(x))).when(x["height"] > last(a)["height"], F.concat(F.slice(a, 1, F.size(a) - 1), F.array(x))).otherwise(a))
    return listed.select("series_id", F.explode(fold).alias("p")).select("series_id", "p.*")


def scenario_weights(scenarios: DataFrame) -> DataFrame:
    """``scenarios`` with their probabilities ``p`` made to sum to one; equal where none has any."""
    total = scenarios.agg(F.sum("p").alias("_total"), F.count("*").alias("_n"))
    return scenarios.crossJoin(F.broadcast(total)).withColumn("p", F.coalesce(F.try_divide("p", "_total"), 1 / F.col("_n"))).drop("_total", "_n")
