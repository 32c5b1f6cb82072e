"""Forecasters and alarms with state, against folds and plain computations."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.streaming import alarms, forecaster, replays
from tidemark.streaming.forecaster import Settings


def frame(spark, rows):
    return spark.createDataFrame(rows, "series_id string, t timestamp, value double")


def hour(k):
    return datetime(2024, 1, 1) + timedelta(hours=k)


def micros(k):
    return k * 3_600_000_000


def test_forecaster_numbers():
    """Window, drift and refreshes: the cases and figures are given by the engine that users come from."""
    wave = lambda n, base=10.0, at=0: [(micros(at + i), base + np.sin(i / 3)) for i in range(n)]
    s = forecaster.Series(Settings(methods=("naive",), window=50))
    assert sum(s.append(*p)[0] for p in wave(40)) == 40
    done = [s.append(*p) for p in [*wave(40)[:10], *wave(20, at=40)]]
    assert sum(d[0] for d in done) == 20 and sum(len(d[1]) for d in done) == 10
    assert len(s.values) == 50 == len(s.times) and s.points == 60
    assert (s.mean, s.m2 / 59) == pytest.approx((np.mean([v for _, v in wave(40) + wave(20)]), np.var([v for _, v in wave(40) + wave(20)], ddof=1)))
    assert s.refresh()["reason"] == "no-fit" and s.refresh() | {"z": None} == s.refresh() and s.refresh()["reason"] == "clean"
    s = forecaster.Series(Settings(methods=("mean",), every=2))
    reasons = []
    for p in [*wave(20), *wave(2, at=20)]:
        s.append(*p)
        reasons.append(s.refresh()["reason"])
    assert reasons[:10] == ["insufficient-data"] * 9 + ["no-fit"] and reasons[10:12] == ["below-threshold", "new-points"]
    s = forecaster.Series(Settings(methods=("naive",), drift_window=10, drift_threshold=1.5))
    for p in wave(60):
        s.append(*p)
    s.refresh()
    for p in wave(15, 100.0, 60):
        s.append(*p)
    told = s.refresh()
    assert told["reason"] == "drift" and told["z"] > 1.5 and told["recomputed"] and told["reselected"]
    assert not forecaster.Series(Settings(methods=("naive",), drift_window=10, drift_threshold=1.5), s.row(), s.values, s.times).dirty
    assert forecaster.Series(Settings(methods=("mean",)), s.row(), s.values, s.times).dirty
    assert [forecaster.default_test(n) for n in (1, 7, 8, 100, 5000)] == [1, 1, 2, 20, 365]


def test_stream_equals_the_fold(spark):
    rng = np.random.default_rng(5)
    settings = Settings(methods=("naive", "mean", "drift", "linear", "holt"), window=40, every=3, drift_window=12, drift_threshold=0.8, reselect_every=4)
    held = {"a": np.cumsum(rng.normal(0, 1, 90)), "b": np.r_[rng.normal(5, 1, 50), rng.normal(30, 1, 40)], "few": rng.normal(0, 1, 7)}
    rows = [(k, hour(i), float(v)) for k, y in held.items() for i, v in enumerate(y)]
    parts = [frame(spark, [r for r in rows if lo <= r[1] < hi] + [r for r in rows if r[1] == hour(lo.hour)] + [("a", None, 1.0), ("a", hour(4), float("nan"))]) for lo, hi in ((hour(0), hour(35)), (hour(35), hour(36)), (hour(36), hour(99)))]
    out, marks = replays.replay_parts(parts, lambda s: forecaster.forecast_stream(s, settings))
    got = {}
    for r in out.collect():
        got.setdefault(r["series_id"], {})[r["points"]] = r
    for k, y in held.items():
        points = [(micros(i), float(v)) for i, v in enumerate(y)]
        want = forecaster.fold(points, settings)
        for w in want:
            r = got[k][w["points"]]
            assert all(r[c] == w[c] or r[c] == pytest.approx(w[c]) for c in ("reason", "recomputed", "reselected", "method", "refreshes", "z", "next", "lower", "upper", "kept")), (k, w, r)
        assert len(got[k]) == len(want)
    state = {r["series_id"]: r for r in replays.snapshots(spark, marks).collect()}
    assert state["a"]["points"] == 90 and state["a"]["values"] == pytest.approx(list(held["a"][-40:])) and state["b"]["sd"] == pytest.approx(np.std(held["b"], ddof=1))


def test_history_is_the_initial_state(spark):
    y = [10 + (i % 7) for i in range(60)]
    history = frame(spark, [("a", hour(i), float(v)) for i, v in enumerate(y[:40])] + [("quiet", hour(1), 1.0)])
    late = frame(spark, [("a", hour(i), float(v)) for i, v in enumerate(y) if i >= 35])
    out, marks = replays.replay_parts([late], lambda s: forecaster.forecast_stream(s, Settings(), history))
    rows = sorted(out.collect(), key=lambda r: r["points"])
    assert [r["points"] for r in rows] == list(range(41, 61)) and rows[0]["reason"] == "new-points" and rows[0]["refreshes"] == 2
    assert {r["series_id"] for r in replays.snapshots(spark, marks).collect()} == {"a", "quiet"}


def test_one_update_a_batch(spark):
    parts = [frame(spark, [("a", hour(i), float(i)) for i in range(12)]), frame(spark, [("a", hour(5), 5.0)])]
    out, _ = replays.replay_parts(parts, lambda s: forecaster.forecast_stream(s, Settings(), per_point=False))
    assert sorted((r["reason"], r["points"]) for r in out.collect()) == [("clean", 12), ("no-fit", 12)]


def alarmed(spark, parts, *args, **kw):
    out, _ = replays.replay_parts([frame(spark, p) for p in parts], lambda s: alarms.alarm_stream(s, *args, **kw))
    return sorted(out.collect(), key=lambda r: (r["series_id"], r["t"], r["kind"], r["rule"] or ""))


def test_alarms_in_order_whatever_the_batches(spark):
    """Late and repeated points, escalation after 3 and 6 in a row, cooldown across runs."""
    values = [0, 9, 9, 9, 9, 0, 9, 9, 9, 9, 9, 9, 9, 0, 9]
    points = [("a", hour(i), float(v)) for i, v in enumerate(values)]
    tick = [("clock", hour(900), None)]
    rule = alarms.Rule("high", "threshold", 5.0, cooldown_ms=2 * 3_600_000)
    want, hits, level, fired = [], 0, "info", None
    for i, v in enumerate(values):
        hits = hits + 1 if v > 5 else 0
        target = "critical" if hits >= 6 else "warn" if hits >= 3 else "info"
        if v > 5 and (target != level or fired is None or i - fired >= 2):
            want.append((hour(i), target, hits))
            fired = i
        level = target
    shuffled = [[points[k] for k in (2, 0, 1, 4)], [points[k] for k in (3, 1, 6, 5)], [points[k] for k in (7, 8, 10, 9)], [*points[11:], ("a", hour(0), 99.0)], tick]
    for parts, delay in (([points, tick], "0 seconds"), (shuffled, "5 hours")):
        got = [r for r in alarmed(spark, parts, (rule,), delay=delay) if r["series_id"] == "a"]
        assert [(r["t"], r["level"], r["hits"]) for r in got] == want
    assert sum(r["escalated"] for r in got) == 3 and any(r["suppressed"] for r in got)


def test_schedules_and_silence(spark):
    start = datetime(2024, 1, 31, 6)
    points = [("a", start, 1.0), ("a", start + timedelta(days=1, hours=1), 2.0), ("a", start + timedelta(days=9), 3.0)]
    schedules = (alarms.Schedule("d", "daily"), alarms.Schedule("w", "weekly", "validate"), alarms.Schedule("m", "monthly", "export"))
    got = alarmed(spark, [points[:2], points[2:], [("clock", start + timedelta(days=61), None)]], (), schedules, 3 * alarms.DAY)
    of = lambda kind, rule: [r["t"] for r in got if r["kind"] == kind and r["rule"] == rule]
    assert of("run", "d") == [start + timedelta(days=k) for k in range(1, 62)]
    assert of("run", "w") == [start + timedelta(days=7 * k) for k in range(1, 9)]
    assert of("run", "m") == [datetime(2024, 2, 29, 6), datetime(2024, 3, 31, 6)]
    assert of("silent", None) == [points[1][1] + timedelta(days=3), points[2][1] + timedelta(days=3)]
    with pytest.raises(ValueError, match="daily, weekly or monthly"):
        alarms.Alarms((), (alarms.Schedule("x", "hourly"),))


def test_kinds_of_rules(spark):
    rng = np.random.default_rng(1)
    y = [*rng.normal(0, 1, 40), 12.0, *rng.normal(6, 1, 40)]
    rules = (alarms.Rule("odd", "anomaly", 5.0), alarms.Rule("moved", "drift", 0.7), alarms.Rule("broken", "break", 8.0), alarms.Rule("low", "threshold", -9.0, "lte"))
    got = alarmed(spark, [[("a", hour(i), float(v)) for i, v in enumerate(y)], [("clock", hour(900), None)]], rules)
    first = {r: min((x["t"] for x in got if x["rule"] == r), default=None) for r in ("odd", "moved", "broken", "low")}
    assert first["odd"] == hour(40) and hour(41) < first["moved"] < hour(70) and hour(40) <= first["broken"] < hour(50) and first["low"] is None
