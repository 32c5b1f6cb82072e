"""Joins in time, effects of events, and tests of cause between series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import decay_kernel
from tidemark.operators import causal_graph


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """``left`` with ``value`` of the last row of ``right`` at or before its time, by key: one sort of both, no range join."""
    a = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(key, time, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    w = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return both.filter("_side = 1").drop("_side", "_v")


def nearest(times: DataFrame, points: DataFrame) -> DataFrame:
    """(name, when, idx): for each named time the nearest point's idx, of two equally near the earlier.

    Points are searched by day; only each day's first and last point are carried over to other days, so that a task sorts
    one day, and one row a day is sorted together."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    day = lambda c: F.unix_date(F.to_date(c))
    at = F.struct("t", "idx").alias("at")
    known = points.select(day("t").alias("day"), "t", at, (-micros("t")).alias("m"))
    asked = times.select("name", F.col("when").alias("t"), day("when").alias("day")).withColumn("m", -micros("t"))
    days = known.groupBy("day").agg(F.min_by("at", "t").alias("first"), F.max_by("at", "t").alias("last")).unionByName(asked.select("day").distinct(), allowMissingColumns=True)
    days = days.groupBy("day").agg(F.first("first", ignorenulls=True).alias("first"), F.first("last", ignorenulls=True).alias("last"))
    one = Window.partitionBy(F.lit(0)).orderBy("day")
    ends = days.select("day", F.last("last", ignorenulls=True).over(one.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.first("first", ignorenulls=True).over(one.rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    before = as_of(asked, known.select("day", "t", "at"), "day", "t", "at")
    both = as_of(before, known.select("day", "m", F.col("at").alias("then")), "day", "m", "then").join(ends, "day")
    both = both.withColumn("at", F.coalesce("at", "earlier")).withColumn("then", F.coalesce("then", "later"))
    gap = lambda c: F.abs(micros(f"{c}.t") - micros("t"))
    follows = F.col("at").isNull() | (F.col("then").isNotNull() & (gap("then") < gap("at")))
    return both.select("name", F.col("t").alias("when"), F.when(follows, F.col("then.idx")).otherwise(F.col("at.idx")).alias("idx"))


def event_weights(events: DataFrame, steps: int, kind: str) -> DataFrame:
    """(name, idx, weight) of the steps that an event (name, start, duration) touches; events carry their steps, no range join."""
    reach = F.col("duration") if kind in ("box", "triangular") else F.lit(steps)
    low = F.col("start") if kind != "gaussian" else F.lit(0)
    idx = F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(low + reach, F.lit(steps)) - 1))
    out = events.filter((F.col("start") < steps) & (F.col("duration") > 0)).select("name", "start", "duration", idx.alias("idx"))
    return out.select("name", "idx", decay_kernel(kind, F.col("idx") - F.col("start"), F.col("duration")).alias("weight"))


def diff_in_diff(points: DataFrame, treated: str, event: int, pre: int, post: int) -> DataFrame:
    """One row: means of the treated series and of the mean of all others before and after ``event``, the effect, its error and t."""
    w = points.filter((F.col("idx") >= event - pre) & (F.col("idx") < event + post)).withColumn("after", F.col("idx") >= event)
    per = w.groupBy("series_id", "after").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    is_treated = F.col("series_id") == treated
    pick = lambda c, t, a: F.avg(F.when((is_treated if t else ~is_treated) & (F.col("after") == a), F.col(c)))
    out = per.agg(*(pick(c, t, a).alias(f"{c}_{'t' if t else 'c'}_{'post' if a else 'pre'}") for c in "mv" for t in (True, False) for a in (False, True)), (F.count_distinct("series_id") - 1).alias("controls"))
    effect = (F.col("m_t_post") - F.col("m_t_pre")) - (F.col("m_c_post") - F.col("m_c_pre"))
    se = F.sqrt(F.col("v_t_pre") / pre + F.col("v_t_post") / post + (F.col("v_c_pre") / pre + F.col("v_c_post") / post) / F.col("controls"))
    return out.select("m_t_pre", "m_t_post", "m_c_pre", "m_c_post", effect.alias("effect"), se.alias("se"), F.try_divide(effect, se).alias("t"), (F.lit(2 * (pre + post) - 4)).alias("df"))


def granger_edges(points: DataFrame, max_lag: int = 3, ar_lag: int = 2) -> DataFrame:
    """(a, b, lag, r, effect, f, df1, df2): for each ordered pair the strongest lag, and the F statistic of a's lags beyond b's own past; see ``causal_graph.edges``."""
    return causal_graph.edges(points, max_lag, ar_lag).select("a", "b", "lag", "r", "effect", "f", "df1", "df2")


def pulse_response(coefficients: list[float], change: float, start: int, duration: int, horizon: int, spark) -> DataFrame:
    """(h, delta, active): a pulse of ``change`` through lagged coefficients."""
    lags = spark.createDataFrame(list(enumerate(coefficients)), "lag int, c double")
    steps = spark.range(horizon).select(F.col("id").cast("int").alias("h"))
    hit: Column = (F.col("h") - F.col("lag")).between(start, start + duration - 1)
    return steps.crossJoin(F.broadcast(lags)).groupBy("h").agg(F.sum(F.when(hit, change * F.col("c")).otherwise(0.0)).alias("delta"), F.count_if(hit).alias("active"))


def matched_windows(points: DataFrame, event: int, pre: int, post: int, k: int = 3) -> DataFrame:
    """(series_id, place, distance, rank): places whose ``pre`` points before are most like those before ``event``.

    The distance is the root of the difference of means, half the relative difference of slopes and 0.3 of the relative
    difference of variances; places nearer to the event than a whole window are left out."""
    w = Window.partitionBy("series_id").orderBy("idx").rowsBetween(-pre, -1)
    n = F.count("*").over(Window.partitionBy("series_id"))
    v = F.col("value")
    p = points.select("series_id", F.col("idx").alias("place"), F.avg(v).over(w).alias("m"), F.var_samp(v).over(w).alias("s2"), ((F.last(v).over(w) - F.first(v).over(w)) / (pre - 1)).alias("slope"), n.alias("n"))
    p = p.filter((F.col("place") >= pre) & (F.col("place") + post <= F.col("n")))
    own = p.filter(F.col("place") == event).select("series_id", F.col("m").alias("m0"), F.col("s2").alias("s0"), F.col("slope").alias("slope0"))
    far = lambda a, b: F.abs(F.col(a) - F.col(b)) / (F.abs(F.col(b)) + 1e-9)
    d = p.filter(F.abs(F.col("place") - event) >= pre + post).join(own, "series_id").withColumn("distance", F.sqrt(F.abs(F.col("m") - F.col("m0")) + 0.5 * far("slope", "slope0") + 0.3 * far("s2", "s0")))
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.round("distance", 9), "place"))
    return d.withColumn("rank", rank).filter(F.col("rank") <= k).select("series_id", "place", "distance", "rank")


def natural_experiments(points: DataFrame, window: int = 5, times: float = 4.0) -> DataFrame:
    """(series_id, idx, jump, before, after, t): steps of at least ``times`` the median step, with the means around them."""
    w = Window.partitionBy("series_id").orderBy("idx")
    p = points.withColumn("jump", F.col("value") - F.lag("value").over(w))
    typical = p.groupBy("series_id").agg(F.percentile(F.abs("jump"), F.lit(0.5)).alias("typical"))
    pre, post = w.rowsBetween(-window, -1), w.rowsBetween(0, window - 1)
    for side, frame in (("before", pre), ("after", post)):
        p = p.withColumn(side, F.avg("value").over(frame)).withColumn(f"v_{side}", F.var_samp("value").over(frame)).withColumn(f"n_{side}", F.count("*").over(frame))
    p = p.join(typical, "series_id").filter((F.abs("jump") >= times * F.col("typical")) & (F.col("typical") > 0) & (F.col("n_before") == window) & (F.col("n_after") == window))
    t = F.try_divide(F.col("after") - F.col("before"), F.sqrt((F.col("v_before") + F.col("v_after")) / window))
    return p.select("series_id", "idx", "jump", "before", "after", t.alias("t"))
