"""Forecasts on a transformed scale: Box-Cox around any forecaster, chosen by the kind of season, and regressions on harmonics from sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import INTERVAL_Z, box_cox, inverse_box_cox
from tidemark.operators.anomalies import season_kind
from tidemark.operators.models import box_cox_lambda

KINDS = ("auto", "additive", "multiplicative")


def shifts(points: DataFrame) -> DataFrame:
    """(series_id, shift): what brings the smallest value to 1 where a value is 0 or below, else 0; nulls are left out."""
    low = F.min("value")
    return points.groupBy("series_id").agg(F.when(low <= 0, 1 - low).otherwise(0.0).cast("double").alias("shift"))


def auto_transform(points: DataFrame, season: int | None, kind: str = "auto", textbook: bool = True) -> DataFrame:
    """(series_id, kind, transform, lambda, shift): which series forecast better on a Box-Cox scale, and which scale.

    A series whose season is multiplicative is transformed, with the most likely lambda of its shifted values. Others keep their
    values (lambda null, shift 0), also those without two whole seasons; without a season of 2 or more every series is additive
    unless ``kind`` says otherwise. A series of equal values has no lambda and keeps its values. ``textbook``: see ``box_cox_lambda``."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    points = points.select("series_id", "idx", "value")
    if kind == "auto" and season is not None and season >= 2:
        kinds = season_kind(points.filter("value is not null"), season).select("series_id", "kind")
    else:
        kinds = points.select("series_id").distinct().withColumn("kind", F.lit("additive" if kind == "auto" else kind))
    moved = points.filter("value is not null").join(kinds.filter("kind = 'multiplicative'"), "series_id").join(shifts(points), "series_id")
    best = box_cox_lambda(moved.select("series_id", (F.col("value") + F.col("shift")).alias("value")), textbook)
    found = best.join(shifts(points), "series_id")
    out = kinds.join(found, "series_id", "left")
    return out.select("series_id", "kind", F.col("lambda").isNotNull().alias("transform"), "lambda", F.coalesce("shift", F.lit(0.0)).alias("shift"))


def transformed_forecast(points: DataFrame, scales: DataFrame, fit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``fit`` gives for points (series_id, idx, value, …) on the scales (series_id, lambda, shift), with point, lower and upper brought back.

    A series without a scale, or with lambda null, is forecast as it is, in the same plan. A value that is 0 or below after its
    shift has no transform and becomes null. Where a step ahead leaves the transform's range, the way back ends at 0, less the shift.
    Extra columns of the result of ``fit`` stay; columns of points that clash with the scales' names give way."""
    scales = scales.select("series_id", F.col("lambda").alias("_lambda"), F.coalesce("shift", F.lit(0.0)).alias("_shift"))
    moved = F.col("value") + F.col("_shift")
    there = F.when(F.col("_lambda").isNull(), F.col("value")).when(moved > 0, box_cox(moved, F.col("_lambda")))
    plain = points.join(scales, "series_id", "left").withColumn("value", there).drop("_lambda", "_shift")

    def back(c: str) -> Column:
        return F.when(F.col("_lambda").isNull(), F.col(c)).when(F.col(c).isNotNull(), inverse_box_cox(F.col(c), F.col("_lambda")) - F.col("_shift"))

    out = fit(plain)
    names = out.columns
    changed = {c: back(c) for c in ("point", "lower", "upper") if c in names}
    return out.join(scales, "series_id", "left").withColumns(changed).select(*names)


def auto_forecast(points: DataFrame, season: int | None, fit: Callable[[DataFrame], DataFrame], kind: str = "auto", textbook: bool = True) -> DataFrame:
    """``transformed_forecast`` on the scales of ``auto_transform``. ``points`` is read several times: store a costly one first."""
    return transformed_forecast(points, auto_transform(points, season, kind, textbook), fit)


def _angles(season: int, harmonics: int, idx: Column) -> list[Column]:
    return [f(2 * np.pi * k * idx / season) for k in range(1, harmonics + 1) for f in (F.sin, F.cos)]


def harmonic_regression(points: DataFrame, seasons: tuple[int, ...], harmonics: int, horizon: int, interval: int = 80, least: int = 10) -> DataFrame:
    """(series_id, h, point, lower, upper): least squares on an intercept and ``harmonics`` sine-cosine pairs of each season.

    A series is never gathered: its normal equations are sums, of values less their mean, which tasks then solve in batches. Each
    diagonal entry is raised by 1e-8 of itself, which also settles columns that others make. Bands widen with sqrt(1 + h/n).
    Null values are left out; series of fewer than ``least`` values, or not more values than columns, give no row; steps count on from the last idx."""
    p = points.filter("value is not null")
    mean = p.groupBy("series_id").agg(F.avg("value").alias("mean"))
    terms = [F.lit(1.0)] + [c for s in seasons for c in _angles(s, harmonics, F.col("idx"))]
    m = len(terms)
    rows = p.join(mean, "series_id").select("series_id", "idx", "mean", *(c.cast("double").alias(f"x{k}") for k, c in enumerate(terms)), (F.col("value") - F.col("mean")).cast("double").alias(f"x{m}"))
    cells = [(i, j) for i in range(m + 1) for j in range(i, m + 1)]
    sums = rows.groupBy("series_id").agg(F.count("*").alias("n"), F.max("idx").alias("last"), F.first("mean").alias("mean"), F.array(*(F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in cells)).alias("sums"))
    z = INTERVAL_Z[interval]

    def design(t: np.ndarray) -> np.ndarray:
        angles = [2 * np.pi * k * t / s for s in seasons for k in range(1, harmonics + 1)]
        return np.column_stack([np.ones(len(t)), *(f(a) for a in angles for f in (np.sin, np.cos))])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above = np.array(cells).T
        h = np.arange(1, horizon + 1)
        for batch in batches:
            for key, n, last, mean, held in zip(batch["series_id"], batch["n"], batch["last"], batch["mean"], batch["sums"], strict=True):
                g = np.zeros((m + 1, m + 1))
                g[above[0], above[1]] = g[above[1], above[0]] = held
                x, xy, yy = g[:m, :m], g[:m, m], g[m, m]
                beta = np.linalg.solve(x + np.diag(np.maximum(1e-8 * np.diag(x), 1e-12)), xy + mean * x[0])
                off = beta - mean * (np.arange(m) == 0)
                variance = max(yy - 2 * off @ xy + off @ x @ off, 0.0) / max(n - m, 1)
                point, half = design(last + h) @ beta, z * np.sqrt(variance * (1 + h / n))
                yield pd.DataFrame({"series_id": key, "h": h, "point": point, "lower": point - half, "upper": point + half})

    return sums.filter((F.col("n") >= least) & (F.col("n") > m)).mapInPandas(solve, "series_id string, h int, point double, lower double, upper double")
