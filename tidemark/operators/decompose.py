"""Decomposition into trend, season and remainder, and its forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.functions.stats import INTERVAL_Z

#: Points of the centred mean that makes the trend.
SMOOTH = 7


def _by_idx() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("idx")


def centred_mean(points: DataFrame, column: str, name: str, width: int = SMOOTH) -> DataFrame:
    """Adds ``name``: the mean of ``width`` neighbours; at the edges that of the nearest full window."""
    w = _by_idx().rowsBetween(-(width // 2), width // 2)
    out = points.withColumn("_m", F.when(F.count("*").over(w) == width, F.avg(column).over(w)))
    back, ahead = _by_idx().rowsBetween(Window.unboundedPreceding, 0), _by_idx().rowsBetween(0, Window.unboundedFollowing)
    return out.withColumn(name, F.coalesce(F.last("_m", True).over(back), F.first("_m", True).over(ahead))).drop("_m")


def decomposed(points: DataFrame, season: int, textbook: bool = False) -> DataFrame:
    """Adds trend, seasonal, remainder; series of at least two seasons.

    The first seasonal means (of value less trend, by phase) are taken out before the trend is smoothed again; what is
    left within each cycle, smoothed around the cycle and centred, is the seasonal part. ``textbook`` adds the first
    seasonal means to the seasonal part, where the reference leaves them in the remainder."""
    n = F.count("*").over(Window.partitionBy("series_id"))
    p = points.withColumn("n", n).filter(F.col("n") >= 2 * season)
    p = centred_mean(p, "value", "trend0").withColumn("phase", F.col("idx") % season)
    p = p.withColumn("initial", F.avg(F.col("value") - F.col("trend0")).over(Window.partitionBy("series_id", "phase"))).withColumn("plain", F.col("value") - F.col("initial"))
    p = centred_mean(p, "plain", "trend").withColumn("raw", F.col("plain") - F.col("trend")).withColumn("cycle", F.floor(F.col("idx") / season))
    # neighbours around the cycle: places that a last, short cycle lacks are left out
    half = season // 2
    reach = p.select("series_id", "idx", "cycle", F.explode(F.array(*(F.pmod(F.col("phase") + j, F.lit(season)) for j in range(-half, half + 1)))).alias("phase"))
    near = reach.join(p.select("series_id", "cycle", "phase", "raw"), ["series_id", "cycle", "phase"]).groupBy("series_id", "idx").agg(F.avg("raw").alias("smooth"))
    p = p.join(near, ["series_id", "idx"])
    p = p.withColumn("seasonal", F.col("smooth") - F.avg("smooth").over(Window.partitionBy("series_id")))
    if textbook:
        p = p.withColumn("seasonal", F.col("seasonal") + F.col("initial"))
    p = p.withColumn("remainder", F.col("value") - F.col("trend") - F.col("seasonal"))
    return p.select(*points.columns, "n", "trend", "seasonal", "remainder")


def decomposed_forecast(points: DataFrame, season: int, horizon: int, textbook: bool = False) -> DataFrame:
    """(series_id, h, point, lower, upper): last trend with the slope of its last three points, and the seasonal values from the last point's phase on."""
    d = decomposed(points, season, textbook)
    fit = d.groupBy("series_id").agg(
        F.max_by("trend", "idx").alias("last"),
        F.regr_slope(F.when(F.col("idx") >= F.col("n") - 3, F.col("trend")), F.col("idx").cast("double")).alias("slope"),
        F.stddev_pop("remainder").alias("sigma"),
        ((F.max("idx")) % season).alias("first"),
    )
    steps = fit.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("idx", F.col("first") + (F.col("h") - 1) % season)
    steps = steps.join(d.select("series_id", "idx", "seasonal"), ["series_id", "idx"], "left")
    point = F.col("last") + F.col("h") * F.col("slope") + F.coalesce("seasonal", F.lit(0.0))
    half = INTERVAL_Z[80] * F.col("sigma") * F.sqrt("h")
    return steps.select("series_id", "h", point.alias("point"), (point - half).alias("lower"), (point + half).alias("upper"))
