"""Forecasts as a table function: ``SELECT * FROM forecast(TABLE(points) PARTITION BY series_id ORDER BY (t), 7)``.

Rows of a series stream through the function in the order of time. What is kept of a series is sums, one season and, for Holt, a
level and a trend for each point of the grid: its length doesn't matter.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SelectedColumn, UserDefinedTableFunction

from tidemark.functions.stats import INTERVAL_Z
from tidemark.operators.models import DAMPING, FINE, LEAST_POINTS

METHODS = ("naive", "mean", "drift", "linear", "snaive", "holt", "holt_damped")


class Smoothing:
    """Holt's method for a whole grid at once, one value after another."""

    def __init__(self, damped: bool):
        self.alpha, self.beta, self.phi = np.array([(a, b, p) for a in FINE for b in FINE for p in (DAMPING if damped else [1.0])]).T
        self.n, self.used, self.first = 0, 3 if damped else 2, 0.0

    def add(self, v: float) -> None:
        self.n += 1
        if self.n == 1:
            self.first = v
            return
        if self.n == 2:
            self.level, self.trend, self.sse = np.full(len(self.alpha), self.first), np.full(len(self.alpha), v - self.first), np.zeros(len(self.alpha))
        ahead, was = self.level + self.phi * self.trend, self.level
        self.level = self.alpha * v + (1 - self.alpha) * ahead
        self.trend = self.beta * (self.level - was) + (1 - self.beta) * self.phi * self.trend
        self.sse = self.sse + (v - ahead) ** 2

    def best(self, h: np.ndarray) -> tuple[np.ndarray, float]:
        """Points of the steps ``h``, and sigma, of the grid point of least error."""
        k = int(np.argmin(self.sse))
        phi = self.phi[k]
        far = h if phi >= 1 else phi * (1 - phi**h) / (1 - phi)
        return self.level[k] + self.trend[k] * far, float(np.sqrt(self.sse[k] / max(self.n - 1 - self.used, 1)))


class RunningFits:
    """The closed-form methods of one series from running sums; values are taken relative to the first, so that sums lose no digits."""

    def __init__(self, methods: tuple[str, ...], season: int | None):
        self.methods, self.season = methods, season
        self.n, self.first, self.last = 0, 0.0, 0.0
        self.s1 = self.s2 = self.si = self.steps = self.turns = 0.0
        self.ring: deque[float] = deque(maxlen=season or 1)
        self.holt = {m: Smoothing(m == "holt_damped") for m in methods if m.startswith("holt")}

    def add(self, v: float) -> None:
        if self.n == 0:
            self.first = v
        else:
            self.steps += (v - self.last) ** 2
        if self.season and self.n >= self.season:
            self.turns += (v - self.ring[0]) ** 2
        d = v - self.first
        self.s1, self.s2, self.si = self.s1 + d, self.s2 + d * d, self.si + self.n * d
        self.ring.append(v)
        self.last, self.n = v, self.n + 1
        for s in self.holt.values():
            s.add(v)

    def fit(self, method: str, h: np.ndarray) -> tuple[np.ndarray, float] | None:
        """(points of the steps, sigma), or None if there are too few values."""
        n, ones = self.n, np.ones(len(h))
        if n < max(2, LEAST_POINTS[method]) or method == "snaive" and (not self.season or n <= self.season):
            return None
        mid, spread = (n - 1) / 2, n * (n * n - 1.0) / 12
        if method == "naive":
            return self.last * ones, np.sqrt(self.steps / max(n - 1, 1))
        if method == "mean":
            return (self.first + self.s1 / n) * ones, np.sqrt(max(self.s2 - self.s1**2 / n, 0.0) / max(n - 1, 1))
        if method == "drift":
            b = (self.last - self.first) / (n - 1)
            squares = (n - 1) * n * (2 * n - 1) / 6
            return self.last + b * h, np.sqrt(max(self.s2 - 2 * b * self.si + b * b * squares, 0.0) / max(n - 1, 1))
        if method == "linear":
            slope = (self.si - mid * self.s1) / spread
            level = self.first + self.s1 / n - slope * mid
            return level + slope * (n - 1 + h), np.sqrt(max(self.s2 - self.s1**2 / n - slope * slope * spread, 0.0) / max(n - 2, 1))
        if method == "snaive":
            return np.array([self.ring[(k - 1) % self.season] for k in h.astype(int)]), np.sqrt(self.turns / max(n - self.season, 1))
        return self.holt[method].best(h)


def _names(text: str | None) -> tuple[str, ...]:
    names = tuple(x.strip() for x in (text or "naive,mean,drift,linear").split(",") if x.strip())
    if unknown := [x for x in names if x not in METHODS]:
        raise ValueError(f"no method {unknown[0]}; there are {', '.join(METHODS)}")
    return names


class Forecast:
    """Table function: (points with series_id, t and value; horizon; methods, comma-separated; interval; season)."""

    def __init__(self):
        self.fits: RunningFits | None = None
        self.key = self.asked = self.before = None

    @staticmethod
    def analyze(points: AnalyzeArgument, horizon: AnalyzeArgument, methods: AnalyzeArgument = None, interval: AnalyzeArgument = None, season: AnalyzeArgument = None) -> AnalyzeResult:
        if not points.isTable:
            raise ValueError("the first argument is a table: TABLE(points) PARTITION BY series_id ORDER BY (t)")
        fields = {f.name: f.dataType for f in points.dataType.fields}
        if missing := [c for c in ("series_id", "t", "value") if c not in fields]:
            raise ValueError(f"the table has no column {missing[0]}; there are {', '.join(fields)}")
        if horizon.isTable or horizon.value is None or horizon.value < 1:
            raise ValueError("the horizon is a constant of at least 1")
        _names(methods.value if methods else None)
        if interval and interval.value not in INTERVAL_Z:
            raise ValueError(f"the interval is one of {', '.join(map(str, INTERVAL_Z))}")
        kind = fields["series_id"]
        schema = T.StructType().add("series_id", kind).add("method", T.StringType()).add("h", T.IntegerType()).add("point", T.DoubleType()).add("lower", T.DoubleType()).add("upper", T.DoubleType())
        return AnalyzeResult(schema, select=[SelectedColumn("series_id"), SelectedColumn("t"), SelectedColumn("value")])

    def eval(self, points: Row, horizon: int, methods: str = None, interval: int = 80, season: int = None) -> None:
        key, t, value = points["series_id"], points["t"], points["value"]
        if self.fits is None:
            self.key, self.asked = key, (horizon, interval)
            self.fits = RunningFits(_names(methods), season)
        elif key != self.key:
            raise ValueError("several series come together: PARTITION BY series_id ORDER BY (t) is needed")
        if self.before is not None and t is not None and t < self.before:
            raise ValueError("points come out of order: PARTITION BY series_id ORDER BY (t) is needed")
        self.before = self.before if t is None else t
        if value is not None:
            self.fits.add(float(value))

    def terminate(self) -> Iterator[tuple]:
        if self.fits is None:
            return
        horizon, interval = self.asked
        h = np.arange(1, horizon + 1, dtype=float)
        for method in self.fits.methods:
            got = self.fits.fit(method, h)
            if got is None:
                continue
            point, half = got[0], INTERVAL_Z[interval] * got[1] * np.sqrt(h)
            for k in range(horizon):
                yield self.key, method, k + 1, float(point[k]), float(point[k] - half[k]), float(point[k] + half[k])


def forecast_function() -> UserDefinedTableFunction:
    """For DataFrames: ``forecast_function()(points.asTable().partitionBy("series_id").orderBy("t"), F.lit(7))``."""
    return udtf(Forecast)


def register(spark: SparkSession, name: str = "forecast") -> None:
    """Makes the function known to SQL under ``name``."""
    spark.udtf.register(name, forecast_function())
