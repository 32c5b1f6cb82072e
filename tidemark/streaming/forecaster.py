"""A forecaster for each series of a stream, with its state in Spark's state store.

Of each point it tells whether the held forecast was made again, why, by which method, and the step ahead. State of a series is
bounded and comes back after a restart: running moments and counts (value state), the last ``window`` values (list state), and the times
of those values (map state), by which repeats are dropped. History can be given as initial state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.stats import INTERVAL_Z
from tidemark.operators.table_functions import RunningFits

#: State and timers of ``transformWithStateInPandas`` need this store.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

UPDATES = "series_id string, t timestamp, points long, reason string, recomputed boolean, reselected boolean, method string, refreshes long, z double, next double, lower double, upper double, kept long, dropped long"

#: Counters and moments of a series, in one row of value state.
_FIELDS = "points long, mean double, m2 double, since long, refreshes long, dirty boolean, method string, next double, lower double, upper double, first long, settings string"


@dataclass(frozen=True)
class Settings:
    """What a forecaster may be told; a change makes the next refresh necessary."""

    methods: tuple[str, ...] = ("naive", "mean", "drift", "linear")
    season: int | None = None
    interval: int = 80
    window: int = 2000
    every: int = 1
    drift_window: int = 30
    drift_threshold: float = 3.0
    reselect_every: int = 10
    test: int | None = None
    least: int = 10


def default_test(n: int) -> int:
    """Points held out for a choice of method: a fifth, 365 at most."""
    return max(1, min(365, int(n / 5 + 0.5)))


def select_method(values: np.ndarray, s: Settings) -> str | None:
    """The method of least squared error on the last values; the first of equals."""
    test = s.test or default_test(len(values))
    if len(values) - test < 2:
        return None
    fits = RunningFits(s.methods, s.season)
    for v in values[:-test]:
        fits.add(v)
    h, best = np.arange(1, test + 1, dtype=float), None
    for method in s.methods:
        got = fits.fit(method, h)
        if got is not None:
            rmse = round(float(np.sqrt(np.mean((got[0] - values[-test:]) ** 2))), 6)
            best = min(best or (rmse, method), (rmse, method), key=lambda x: x[0])
    return best[1] if best else None


class Series:
    """The forecaster of one series, as it is between batches and while points come in."""

    def __init__(self, settings: Settings, row: tuple | None = None, values: list[float] = (), times: dict[int, int] | None = None):
        self.settings = settings
        told = json.dumps(asdict(settings), sort_keys=True)
        self.points, self.mean, self.m2, self.since, self.refreshes, self.dirty, self.method, self.next, self.lower, self.upper, self.first, was = row or (0, 0.0, 0.0, 0, 0, True, None, None, None, None, 0, told)
        self.dirty = self.dirty or was != told
        self.settings_text = told
        self.values, self.times = list(values), times if times is not None else {}

    def row(self) -> tuple:
        return self.points, self.mean, self.m2, self.since, self.refreshes, self.dirty, self.method, self.next, self.lower, self.upper, self.first, self.settings_text

    def append(self, t: int, v: float) -> tuple[bool, list[int]]:
        """Takes a point unless its time is among those held; (taken, times that left the window)."""
        if t in self.times:
            return False, []
        self.points, self.since, self.dirty = self.points + 1, self.since + 1, True
        step = v - self.mean
        self.mean += step / self.points
        self.m2 += step * (v - self.mean)
        self.times[t] = self.points
        self.values.append(v)
        gone = []
        if len(self.values) > self.settings.window:
            self.values.pop(0)
            oldest = next(iter(self.times))
            del self.times[oldest]
            gone.append(oldest)
        return True, gone

    def drift(self) -> float | None:
        """Distance of the late values' mean from that of all, in deviations; None before 20 points."""
        late = self.values[-self.settings.drift_window :]
        sd = np.sqrt(self.m2 / (self.points - 1)) if self.points > 1 else 0.0
        return float(abs(np.mean(late) - self.mean) / sd) if min(self.points, 2 * self.settings.drift_window) >= 10 and self.points >= 20 and sd > 0 else None

    def refresh(self) -> dict:
        """Makes the forecast again if need be; what happened."""
        s, z, reselected = self.settings, None, False
        if self.method is None:
            reason = "no-fit"
        elif not self.dirty:
            reason = "clean"
        elif self.since < s.every:
            reason = "below-threshold"
        else:
            z = self.drift()
            reason = "drift" if z is not None and round(z, 9) > s.drift_threshold else "new-points"
        again = reason in ("no-fit", "drift", "new-points")
        if again and len(self.values) < s.least:
            again, reason = False, "insufficient-data"
        if again:
            values = np.asarray(self.values)
            if self.method is None or reason == "drift" or self.refreshes % s.reselect_every == 0:
                reselected, self.method = True, select_method(values, s) or s.methods[0]
            fits = RunningFits((self.method,), s.season)
            for v in values:
                fits.add(v)
            got = fits.fit(self.method, np.array([1.0]))
            self.next = float(got[0][0])
            half = float(INTERVAL_Z[s.interval] * got[1])
            self.lower, self.upper = self.next - half, self.next + half
            self.refreshes, self.since, self.dirty = self.refreshes + 1, 0, False
        return {"reason": reason, "recomputed": again, "reselected": reselected, "method": self.method, "refreshes": self.refreshes, "z": z, "next": self.next, "lower": self.lower, "upper": self.upper}


class Forecaster(StatefulProcessor):
    """The processor of ``transformWithStateInPandas``, grouped by series_id; input series_id, t, value."""

    def __init__(self, settings: Settings, expire_ms: int | None = None, per_point: bool = True):
        self.settings, self.expire_ms, self.per_point = settings, expire_ms, per_point

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = {"ttlDurationMs": self.expire_ms} if self.expire_ms else {}
        self.moments = handle.getValueState("moments", _FIELDS, **ttl)
        self.values = handle.getListState("values", "value double", **ttl)
        self.times = handle.getMapState("times", "t long", "place long", **ttl)

    def _held(self) -> Series:
        if not self.moments.exists():
            return Series(self.settings)
        times = sorted(((k[0], v[0]) for k, v in self.times.iterator()), key=lambda x: x[1])
        return Series(self.settings, self.moments.get(), [v[0] for v in self.values.get()], dict(times))

    def _points(self, frames: Iterator[pd.DataFrame]) -> list[tuple[int, float]]:
        """Points of a batch in the order of time; those without a time or a finite value are left out."""
        out = []
        for f in frames:
            ok = f["t"].notna() & np.isfinite(f["value"].astype(float))
            out += list(zip(f["t"][ok].astype("datetime64[us]").astype("int64"), f["value"][ok].astype(float), strict=True))
        return sorted((int(t), float(v)) for t, v in out)

    def _store(self, series: Series, added: dict[int, int], gone: list[int]) -> None:
        self.moments.update(series.row())
        self.values.put([(v,) for v in series.values])
        for t in gone:
            if t not in added:
                self.times.removeKey((t,))
        for t, place in added.items():
            if t in series.times:
                self.times.updateValue((t,), (place,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        series, added, gone, out = self._held(), {}, [], []
        points = self._points(rows)
        for k, (t, v) in enumerate(points):
            taken, left = series.append(t, v)
            gone += left
            if taken:
                added[t] = series.times[t]
            if self.per_point and taken or not self.per_point and k == len(points) - 1:
                done = series.refresh()
                out.append((key[0], t, series.points, done["reason"], done["recomputed"], done["reselected"], done["method"], done["refreshes"], done["z"], done["next"], done["lower"], done["upper"], len(series.values), len(left)))
        if points:
            self._store(series, added, gone)
        if out:
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in UPDATES.split(", ")])
            frame["t"] = pd.to_datetime(frame["t"], unit="us")
            yield frame

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """History: taken in silently, then fitted once."""
        series, added, gone = self._held(), {}, []
        for t, v in self._points(iter([initialState])):
            taken, left = series.append(t, v)
            gone += left
            if taken:
                added[t] = series.times[t]
        if series.points:
            series.refresh()
            self._store(series, added, gone)

    def close(self) -> None:
        pass


def forecast_stream(points: DataFrame, settings: Settings = Settings(), history: DataFrame | None = None, expire_ms: int | None = None, per_point: bool = True) -> DataFrame:  # noqa: B008
    """Updates (``UPDATES``) of a stream of points (series_id, t, value): one for each point taken, or with ``per_point`` false one for each series and batch.

    Points of a batch are taken in the order of time. A point whose time is held already is dropped; the oldest values and times leave a
    window that is full. ``history``, points as well, is each series' initial state; it is read when the stream first begins. ``expire_ms``
    forgets a series so long after its last point. The session needs the store ``ROCKS``."""
    columns = ["series_id", F.col("t").cast("timestamp").alias("t"), F.col("value").cast("double").alias("value")]
    seed = history.select(*columns).groupBy("series_id") if history is not None else None
    grouped = points.select(*columns).groupBy("series_id")
    return grouped.transformWithStateInPandas(Forecaster(settings, expire_ms, per_point), UPDATES, "append", "processingTime" if expire_ms else "none", seed)


def fold(points: list[tuple[int, float]], settings: Settings = Settings()) -> list[dict]:  # noqa: B008
    """What the stream gives for one series whose points come in this order."""
    series = Series(settings)
    return [series.refresh() | {"points": series.points, "kept": len(series.values)} for t, v in points if series.append(t, v)[0]]
