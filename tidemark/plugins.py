"""Models and metrics of one's own, used like the built-in ones.

A model is a function (values, horizon) -> points; a metric is a function (actuals, points) -> number. Both get arrays of
one series and run in tasks, series spread over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import arrays

MODELS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {}
METRICS: dict[str, Callable[[np.ndarray, np.ndarray], float]] = {}


def model(name: str):
    def add(f):
        if name in MODELS:
            raise ValueError(f"there is a model {name} already")
        MODELS[name] = f
        return f

    return add


def metric(name: str):
    def add(f):
        if name in METRICS:
            raise ValueError(f"there is a metric {name} already")
        METRICS[name] = f
        return f

    return add


@model("mean_with_slope")
def mean_with_slope(values: np.ndarray, horizon: int) -> np.ndarray:
    """Mean plus a tenth of the least-squares slope for each step."""
    slope = np.polyfit(np.arange(len(values)), values, 1)[0] if len(values) > 1 else 0.0
    return values.mean() + 0.1 * slope * np.arange(1, horizon + 1)


def forecast_with(points: DataFrame, name: str, horizon: int) -> DataFrame:
    """(series_id, h, point) of a registered model."""
    run = MODELS[name]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, y in zip(batch["series_id"], batch["y"], strict=True):
                yield pd.DataFrame({"series_id": key, "h": np.arange(1, horizon + 1), "point": np.asarray(run(np.asarray(y, float), horizon), float)})

    return arrays(points).select("series_id", "y").mapInPandas(fit, "series_id string, h int, point double")


def score_with(pairs: DataFrame, name: str) -> DataFrame:
    """(series_id, score) of a registered metric over (series_id, h, value, point)."""
    run = METRICS[name]

    def score(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("h")
        return pd.DataFrame({"series_id": [g["series_id"].iloc[0]], "score": [float(run(g["value"].to_numpy(), g["point"].to_numpy()))]})

    return pairs.select("series_id", "h", F.col("value").cast("double"), F.col("point").cast("double")).groupBy("series_id").applyInPandas(score, "series_id string, score double")
