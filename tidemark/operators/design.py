"""Feature matrices from a configuration, windows by count or duration, and all quality checks of a series in one table."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import anomalies, features, guidance, quality

#: What a window's unit means: points (by count) or milliseconds (by duration).
POINTS = {"": 1, "point": 1, "day": 1, "week": 7, "month": 30}
MILLIS = {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000, "month": 2_592_000_000}

#: Checks and how grave a finding is.
SEVERITY = {"duplicate": "error", "gap": "error", "hole": "warning", "outlier": "warning", "outlier_cluster": "warning", "trend_shift": "info", "season_break": "info", "not_stationary": "info"}
WEIGHT = {"error": 3, "warning": 1, "info": 0}


@dataclass(frozen=True)
class FeatureConfig:
    """Which columns a feature matrix has. ``seasons`` empty and ``auto``: found in each series by its autocorrelation."""

    seasons: tuple[int, ...] = ()
    harmonics: tuple[int, ...] = ()
    auto: bool = False
    max_lag: int = 60
    least: float = 0.1
    z: float = 1.96
    weekdays: bool = False
    lags: tuple[int, ...] = ()


def parse_config(config: Mapping) -> FeatureConfig:
    """A FeatureConfig of ``{"fourier": {"seasons": [7], "harmonics": 2 or [2], "auto": false}, "weekdays": true, "lags": [1, 7]}``.

    Raises ValueError for unknown keys, seasons below 2, harmonics beyond half a season, lags below 1, or nothing asked for."""
    unknown = set(config) - {"fourier", "weekdays", "lags"} | set(config.get("fourier", {})) - {"seasons", "harmonics", "auto", "max_lag", "least", "z"}
    if unknown:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    fourier = config.get("fourier", {})
    seasons, given = tuple(fourier.get("seasons", ())), fourier.get("harmonics", 1)
    auto, lags = bool(fourier.get("auto", False)), tuple(config.get("lags", ()))
    harmonics = tuple(given) if isinstance(given, Iterable) else (given,) * (1 if auto else len(seasons))
    if auto and seasons or len(harmonics) != (1 if auto else len(seasons)):
        raise ValueError("either seasons, each with its harmonics, or auto with one number of harmonics")
    if any(m < 2 for m in seasons) or any(k < 1 for k in harmonics) or any(2 * k > m for m, k in zip(seasons, harmonics)):
        raise ValueError("a season has at least 2 steps, and 1 harmonic to half as many as it has steps")
    if any(lag < 1 for lag in lags):
        raise ValueError("lags begin at 1")
    search = {k: fourier[k] for k in ("max_lag", "least", "z") if k in fourier}
    out = FeatureConfig(seasons, harmonics, auto, weekdays=bool(config.get("weekdays", False)), lags=lags, **search)
    if not (seasons or auto or out.weekdays or lags):
        raise ValueError("no features asked for")
    return out


def _waves(idx: Column, season: Column, harmonics: int) -> Column:
    angle = lambda k: 2 * math.pi * k * idx / season
    return F.array(*(f(angle(k)) for k in range(1, harmonics + 1) for f in (F.sin, F.cos)))


def _seasons(points: DataFrame, config: FeatureConfig) -> DataFrame:
    """(series_id, seasons): found seasons, shortest first; a series without any has none."""
    found = guidance.auto_seasons(points, config.max_lag, config.harmonics[0], config.least, config.z)
    return found.groupBy("series_id").agg(F.array_sort(F.collect_list("season")).alias("seasons"))


def _with_terms(rows: DataFrame, config: FeatureConfig, seasons: DataFrame | None) -> DataFrame:
    parts = [_waves(F.col("idx"), F.lit(m), k) for m, k in zip(config.seasons, config.harmonics)]
    if config.auto:
        rows = rows.join(seasons, "series_id", "left")
        rows = rows.withColumn("seasons", F.coalesce("seasons", F.array().cast("array<int>")))
        parts.append(F.flatten(F.transform("seasons", lambda m: _waves(F.col("idx"), m, config.harmonics[0]))))
    else:
        rows = rows.withColumn("seasons", F.array(*map(F.lit, config.seasons)).cast("array<int>"))
    if config.weekdays:
        # Monday is the base and has no column
        parts.append(F.array(*((F.weekday("t") == d).cast("double") for d in range(1, 7))))
    return rows.withColumn("terms", F.concat(*parts) if parts else F.array().cast("array<double>"))


def feature_matrix(points: DataFrame, config: FeatureConfig) -> DataFrame:
    """``points`` (series_id, t, idx, value) with seasons, terms (sine and cosine of each harmonic by season, then weekdays) and lagged (values before).

    Terms depend on idx and t alone. Lags are a window by series; with ``auto`` series join their own few seasons."""
    rows = _with_terms(points, config, _seasons(points, config) if config.auto else None)
    by = Window.partitionBy("series_id").orderBy("idx")
    return rows.withColumn("lagged", F.array(*(F.lag("value", k).over(by) for k in config.lags)).cast("array<double>"))


def future_matrix(points: DataFrame, config: FeatureConfig, horizon: int) -> DataFrame:
    """(series_id, h, idx, t, seasons, terms) of the ``horizon`` days after each series' last point, with the terms that its history has."""
    last = points.groupBy("series_id").agg(F.max("idx").alias("last"), F.max("t").alias("end"))
    rows = last.select("series_id", "last", "end", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    rows = rows.select("series_id", "h", (F.col("last") + F.col("h")).alias("idx"), F.date_add("end", F.col("h")).alias("t"))
    return _with_terms(rows, config, _seasons(points, config) if config.auto else None)


def matrix_faults(matrix: DataFrame) -> DataFrame:
    """(series_id, rows, widths, unusable): series whose rows differ in their number of terms or hold a null or NaN; none if all is well."""
    bad = F.exists("terms", lambda x: x.isNull() | F.isnan(x))
    out = matrix.groupBy("series_id").agg(F.count("*").alias("rows"), F.count_distinct(F.size("terms")).alias("widths"), F.count_if(bad).alias("unusable"))
    return out.filter("widths > 1 or unusable > 0")


def window_of(points: DataFrame, spec: int | str, by: str = "points") -> DataFrame:
    """The end of each series: a number of points, or ``last_90_days`` and the like.

    By points, a day is one, a week 7 and a month 30 points; by time, the window reaches so far back from the series' last t, that end excluded."""
    n, unit = (spec, "") if isinstance(spec, int) else _spec(spec)
    if by == "points":
        if unit not in POINTS:
            raise ValueError(f"no number of points: {unit}")
        return features.last_points(points, n * POINTS[unit])
    if by != "time" or unit not in MILLIS:
        raise ValueError(f"no duration: {spec!r} by {by}")
    end = points.groupBy("series_id").agg(F.max(F.unix_millis(F.col("t").cast("timestamp"))).alias("_end"))
    inside = F.unix_millis(F.col("t").cast("timestamp")) > F.col("_end") - n * MILLIS[unit]
    return points.join(end, "series_id").filter(inside).drop("_end")


def _spec(spec: str) -> tuple[int, str]:
    m = re.fullmatch(r"last_(\d+)_?([a-z]*?)s?", spec)
    if not m or int(m[1]) < 1:
        raise ValueError(f"not a window: {spec!r}")
    return int(m[1]), m[2]


def findings(points: DataFrame, season: int = 7, observed: DataFrame | None = None) -> DataFrame:
    """(series_id, check, severity, first, last, size): every quality check on one table of points; first and last are idx.

    Nulls in value are holes (up to two in a row) and gaps; the other checks take the points that have a value. ``observed`` (series_id, t): the raw
    rows, of which those that repeat a time are told by series, without place. A series without points has no row."""
    known = points.filter("value is not null")
    one = lambda df, check, first, last, size: df.select("series_id", F.lit(check).alias("check"), first.cast("bigint").alias("first"), last.cast("bigint").alias("last"), size.cast("bigint").alias("size"))
    # shifts compare neighbours among the known points, whose places are then those of the series
    dense = known.select("series_id", F.col("idx").alias("place"), "value", (F.row_number().over(Window.partitionBy("series_id").orderBy("idx")) - 1).alias("idx"))
    shifts = quality.trend_shifts(dense.drop("place")).join(dense.select("series_id", "idx", "place"), ["series_id", "idx"])
    runs, c = quality.missing_runs(points), F.col
    ends = known.groupBy("series_id").agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.count("*").alias("n"))
    parts = [
        one(runs.filter("kind = 'scattered_hole'"), "hole", c("first"), c("last"), c("duration")),
        one(runs.filter("kind <> 'scattered_hole'"), "gap", c("first"), c("last"), c("duration")),
        one(quality.zscore_outliers(points), "outlier", c("idx"), c("idx"), F.lit(1)),
        one(quality.outlier_clusters(known), "outlier_cluster", c("first"), c("last"), c("size")),
        one(shifts, "trend_shift", c("place"), c("place"), F.lit(1)),
        one(quality.season_breaks(known, season), "season_break", c("block") * season, (c("block") + 2) * season - 1, F.lit(1)),
        one(anomalies.stationarity(points).filter("not stationary").join(ends, "series_id"), "not_stationary", c("a"), c("b"), c("n")),
    ]
    if observed is not None:
        again = observed.groupBy("series_id", "t").agg((F.count("*") - 1).alias("more")).groupBy("series_id").agg(F.sum("more").alias("more")).filter("more > 0")
        none = F.lit(None)
        parts.append(one(again, "duplicate", none, none, c("more")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    grave = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    return out.select("series_id", "check", grave[F.col("check")].alias("severity"), "first", "last", "size")


def quality_profile(points: DataFrame, season: int = 7, observed: DataFrame | None = None) -> DataFrame:
    """(series_id, n, missing, errors, warnings, notes, health, issues): one row a series, those without findings too.

    health is the share of weight (error 3, warning 1) that kinds of issues leave; issues lists kind and number of findings."""
    found = findings(points, season, observed).groupBy("series_id", "check", "severity").agg(F.count("*").alias("k"))
    kinds = lambda s: F.count_if(F.col("severity") == s)
    listed = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "check", F.col("k").cast("string")))), ",")
    found = found.groupBy("series_id").agg(kinds("error").alias("errors"), kinds("warning").alias("warnings"), kinds("info").alias("notes"), listed.alias("issues"))
    base = points.groupBy("series_id").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"))
    out = base.join(found, "series_id", "left").na.fill(0, ["errors", "warnings", "notes"]).na.fill("", ["issues"])
    weight = WEIGHT["error"] * F.col("errors") + WEIGHT["warning"] * F.col("warnings")
    health = F.when(weight > 0, 100 * (1 - weight / (WEIGHT["error"] * (F.col("errors") + F.col("warnings"))))).otherwise(100.0)
    return out.select("series_id", "n", "missing", "errors", "warnings", "notes", F.round(health, 1).alias("health"), "issues")
