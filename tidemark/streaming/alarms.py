"""Alerts, silences and schedules of series in a stream, on the points' own clock.

Points wait in state until the watermark passes their time, when an event-time timer of theirs goes off; then they are taken in the order of
time. What is told therefore depends neither on batches nor on the order within the watermark's delay. A point whose time is known
already, or lies before what was taken, is dropped. A point without a value only moves the clock.
"""

from __future__ import annotations

import calendar
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ALARMS = "series_id string, t timestamp, kind string, rule string, level string, hits long, escalated boolean, suppressed long, value double"
_NAMES = [c.split()[0] for c in ALARMS.split(", ")]
DAY = 86_400_000


@dataclass(frozen=True)
class Rule:
    """A condition on each point: threshold (``op`` gt, gte, lt or lte of ``limit``), anomaly (``limit`` deviations from the last ``window`` values' mean), drift (the last
    ``window`` values' mean that many deviations from all values' mean) or break (a cumulated sum of standardised values beyond ``limit``).

    A hit raises the level after ``escalate`` hits in a row to warn, after twice as many to critical. A new level is always told, else
    what lies ``cooldown_ms`` after the last one told."""

    id: str
    kind: str
    limit: float
    op: str = "gt"
    window: int = 30
    cooldown_ms: int = 60_000
    escalate: int = 3


@dataclass(frozen=True)
class Schedule:
    """An action that comes due daily, weekly or monthly (on the same day, or a shorter month's last) after the first point of a series."""

    id: str
    every: str
    action: str = "refit"

    def after(self, ms: int, first: int, k: int) -> int:
        """The ``k``-th run of a series that began at ``first``."""
        if self.every == "monthly":
            t = datetime.fromtimestamp(first / 1000, timezone.utc)
            year, month = divmod(t.year * 12 + t.month - 1 + k, 12)
            day = min(t.day, calendar.monthrange(year, month + 1)[1])
            return round(t.replace(year=year, month=month + 1, day=day).timestamp() * 1000)
        return ms + {"daily": DAY, "weekly": 7 * DAY}[self.every]


class Alarms(StatefulProcessor):
    """The processor of ``transformWithStateInPandas`` in event time, grouped by series_id; input series_id, t, value."""

    def __init__(self, rules: tuple[Rule, ...], schedules: tuple[Schedule, ...] = (), silence_ms: int | None = None):
        for r in rules:
            if r.kind not in ("threshold", "anomaly", "drift", "break") or r.op not in ("gt", "gte", "lt", "lte"):
                raise ValueError(f"rule {r.id}: no kind {r.kind} or op {r.op}")
        for s in schedules:
            if s.every not in ("daily", "weekly", "monthly"):
                raise ValueError(f"schedule {s.id}: every is daily, weekly or monthly")
        self.rules, self.schedules, self.silence_ms = rules, schedules, silence_ms
        self.window = max((r.window for r in rules), default=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "t long", "value double")
        self.clock = handle.getValueState("clock", "first long, last long, told long, n long, mean double, m2 double, high double, low double")
        self.recent = handle.getListState("recent", "value double")
        self.hits = handle.getMapState("hits", "rule string", "hits long, level string, fired long, suppressed long")
        self.due = handle.getMapState("due", "schedule string", "next long, runs long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.clock.get()[1] if self.clock.exists() else None
        for frame in rows:
            ok = frame["t"].notna() & np.isfinite(frame["value"].astype(float))
            for t, v in zip(frame["t"][ok].astype("datetime64[ms]").astype("int64"), frame["value"][ok].astype(float), strict=True):
                t = int(t)
                if (last is None or t > last) and not self.pending.containsKey((t,)):
                    self.pending.updateValue((t,), (float(v),))
                    self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all up to the watermark is final; a timer set now would not go off in this batch
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        waiting = sorted((k[0], v[0]) for k, v in self.pending.iterator() if k[0] <= until)
        out: list[tuple] = []
        for t, v in waiting:
            self.pending.removeKey((t,))
            out += self._until(key, t - 1) if self.clock.exists() else []
            out += self._point(key, t, v)
        if self.clock.exists():
            out += self._until(key, until)
        if out:
            frame = pd.DataFrame(out, columns=_NAMES)
            frame["t"] = pd.to_datetime(frame["t"], unit="ms")
            yield frame

    def _until(self, key, until: int) -> list[tuple]:
        """Runs and silences that come due up to a time, in the order of time."""
        out = []
        first, last, told, *rest = self.clock.get()
        for s in self.schedules:
            at, runs = self.due.getValue((s.id,))
            while at <= until:
                out.append((key[0], at, "run", s.id, s.action, runs, False, 0, None))
                at, runs = s.after(at, first, runs + 1), runs + 1
                self.handle.registerTimer(at)
            self.due.updateValue((s.id,), (at, runs))
        if self.silence_ms and told != last and last + self.silence_ms <= until:
            out.append((key[0], last + self.silence_ms, "silent", None, "warn", 1, False, 0, None))
            self.clock.update((first, last, last, *rest))
        return sorted(out, key=lambda r: (r[1], r[2], r[3] or ""))

    def _point(self, key, t: int, v: float) -> list[tuple]:
        if not self.clock.exists():
            self.clock.update((t, t, t - 1, 0, 0.0, 0.0, 0.0, 0.0))
            for s in self.schedules:
                at = s.after(t, t, 1)
                self.due.updateValue((s.id,), (at, 1))
                self.handle.registerTimer(at)
        first, last, told, n, mean, m2, high, low = self.clock.get()
        if n and t <= last:
            return []
        values = [x[0] for x in self.recent.get()] if self.recent.exists() else []
        sd = float(np.sqrt(m2 / (n - 1))) if n > 1 else 0.0
        z = (v - mean) / sd if n >= 5 and sd > 0 else 0.0
        high, low = max(0.0, high + z - 0.5), min(0.0, low + z + 0.5)
        out = [row for rule in self.rules if (row := self._rule(key, rule, t, v, values, n, mean, sd, high, low))]
        n += 1
        step = v - mean
        mean += step / n
        m2 += step * (v - mean)
        self.recent.put([(x,) for x in [*values, v][-self.window :]])
        self.clock.update((first, t, told, n, mean, m2, high, low))
        if self.silence_ms:
            self.handle.registerTimer(t + self.silence_ms)
        return out

    def _hit(self, rule: Rule, v: float, values: list[float], n: int, mean: float, sd: float, high: float, low: float) -> bool:
        late = values[-rule.window :]
        if rule.kind == "threshold":
            return {"gt": v > rule.limit, "gte": v >= rule.limit, "lt": v < rule.limit, "lte": v <= rule.limit}[rule.op]
        if rule.kind == "anomaly":
            spread = float(np.std(late, ddof=1)) if len(late) >= 5 else 0.0
            return spread > 0 and abs(v - float(np.mean(late))) > rule.limit * spread
        if rule.kind == "drift":
            return n >= 20 and len(late) >= 10 and sd > 0 and abs(float(np.mean(late)) - mean) > rule.limit * sd
        return max(high, -low) > rule.limit

    def _rule(self, key, rule: Rule, t: int, v: float, *held) -> tuple | None:
        hits, level, fired, suppressed = self.hits.getValue((rule.id,)) if self.hits.containsKey((rule.id,)) else (0, "info", None, 0)
        if not self._hit(rule, v, *held):
            if hits:
                self.hits.updateValue((rule.id,), (0, "info", fired, suppressed))
            return None
        hits += 1
        target = "critical" if hits >= 2 * rule.escalate else "warn" if hits >= rule.escalate else "info"
        escalated = target != level
        if fired is not None and t - fired < rule.cooldown_ms and not escalated:
            self.hits.updateValue((rule.id,), (hits, target, fired, suppressed + 1))
            return None
        self.hits.updateValue((rule.id,), (hits, target, t, 0))
        return key[0], t, rule.kind, rule.id, target, hits, escalated, suppressed, v

    def close(self) -> None:
        pass


def alarm_stream(points: DataFrame, rules: tuple[Rule, ...], schedules: tuple[Schedule, ...] = (), silence_ms: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """What is told (``ALARMS``) of a stream of points (series_id, t, value). ``kind`` is a rule's, run (a schedule's action, in ``level``) or silent (no point for ``silence_ms``).

    Points later than ``delay`` behind the largest time seen are lost. The session needs the store ``forecaster.ROCKS``."""
    timed = points.select("series_id", F.col("t").cast("timestamp").alias("t"), F.col("value").cast("double").alias("value")).withWatermark("t", delay)
    return timed.groupBy("series_id").transformWithStateInPandas(Alarms(rules, schedules, silence_ms), ALARMS, "append", "eventTime")
