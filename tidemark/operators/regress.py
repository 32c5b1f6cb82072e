"""Regressions of each series: harmonics from sums, and a line that outliers don't bend, for which a series is one row with its values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.operators.transforms import harmonic_regression
from tidemark.sources.tables import arrays


def harmonic_forecast(points: DataFrame, season: int, harmonics: int, horizon: int, interval: int = 80) -> DataFrame:
    """(series_id, h, point, lower, upper): ``harmonic_regression`` on one season."""
    return harmonic_regression(points, (season,), harmonics, horizon, interval)


def robust_line(points: DataFrame, delta: float = 1.35, rounds: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """(series_id, intercept, slope, rounds): Huber's line by weighted least squares, weights from residuals over their deviation."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, y in zip(batch["series_id"], batch["y"], strict=True):
                x = np.column_stack([np.ones(len(y)), np.arange(len(y))])
                w, beta = np.ones(len(y)), np.zeros(2)
                for k in range(1, rounds + 1):
                    before, beta = beta, np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
                    r = y - x @ beta
                    scale = 1.4826 * np.median(np.abs(r - np.median(r))) or 1.0
                    w = np.minimum(1.0, delta / np.maximum(np.abs(r) / scale, 1e-12))
                    if np.abs(beta - before).max() < tolerance:
                        break
                yield pd.DataFrame({"series_id": [key], "intercept": beta[0], "slope": beta[1], "rounds": k})

    return arrays(points).filter("n >= 3").select("series_id", "y").mapInPandas(fit, "series_id string, intercept double, slope double, rounds int")
