"""Operators whose work is cut into blocks, brackets or levels, against plain computations."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.operators import causal, features, models, multi, scenarios


def long(spark, series):
    rows = [(k, i, None if v != v else float(v)) for k, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "series_id string, idx int, value double")


def test_lagged_correlation_over_blocks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(multi, "STEPS", 16)
    monkeypatch.setattr(multi, "TILE", 2)
    rng = np.random.default_rng(3)
    series = {k: rng.normal(50, 3, 45) for k in "abcde"}
    series["d"][7] = np.nan
    series["e"][:] = 4.2
    got = {(r["a"], r["b"], r["lag"]): r for r in multi.lagged_correlation(long(spark, series), 3).collect()}
    for a in "abcde":
        for b in "abcde":
            for lag in range(-3, 4):
                if a >= b:
                    assert (a, b, lag) not in got
                    continue
                pairs = [(series[a][t - lag], series[b][t]) for t in range(45) if 0 <= t - lag < 45]
                x, y = np.array([p for p in pairs if not np.isnan(p).any()]).T
                assert got[a, b, lag]["n"] == len(x)
                if b == "e":
                    assert got[a, b, lag]["r"] is None
                else:
                    assert got[a, b, lag]["r"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)


@pytest.mark.parametrize("v", [list(range(500)), [1.0] * 300 + [2.0] * 300, [7.0] * 100, [0.0] * 10 + [5.0] * 200 + list(range(90))])
def test_kth_smallest(spark, v):
    values = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "value double")
    for rank in (0, 9, 50, len(v) // 2, len(v) - 1):
        assert scenarios.kth_smallest(values, rank, few=5) == sorted(v)[rank]


def test_risk_of_nothing(spark):
    row = scenarios.risk(spark.createDataFrame([], "value double")).head()
    assert row["var"] is None and row["cvar"] is None


def test_nearest_over_days(spark):
    start = datetime(2024, 1, 1)
    hours = [0, 5, 30, 31, 200, 201, 500]
    points = spark.createDataFrame([(start + timedelta(hours=h), i) for i, h in enumerate(hours)], "t timestamp, idx int")
    asked = [-50, 0, 4, 17.5, 18, 110, 115.4, 115.5, 116, 199, 351, 900]
    times = spark.createDataFrame([(str(a), start + timedelta(hours=a)) for a in asked], "name string, when timestamp")
    got = {r["name"]: r["idx"] for r in causal.nearest(times, points).collect()}
    assert got == {str(a): min(range(len(hours)), key=lambda i: (abs(hours[i] - a), hours[i])) for a in asked}


def test_periodogram_is_the_transform(spark):
    v = np.sin(np.arange(21) * 1.1) + 2
    got = {r["k"]: r["power"] for r in features.periodogram(long(spark, {"a": v, "b": [1.0, 2.0]})).collect()}
    n = np.arange(32)
    padded = np.concatenate([v, np.zeros(11)])
    want = {k: abs((padded * np.exp(-2j * np.pi * k * n / 32)).sum()) ** 2 / 21 for k in range(1, 16)}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("damped", [False, True])
def test_holt_of_many_lengths(spark, damped):
    rng = np.random.default_rng(1)
    series = {f"s{k}": rng.normal(0, 1, 4 + k).cumsum() for k in range(40)}
    got = {r["series_id"]: r for r in models.holt_fits(long(spark, series), damped).collect()}
    assert len(got) == 40
    for key in ("s0", "s17", "s39"):
        y, best = series[key], None
        for a in models.FINE:
            for b in models.FINE:
                for p in models.DAMPING if damped else [1.0]:
                    level, trend, sse = y[0], y[1] - y[0], 0.0
                    for v in y[1:]:
                        ahead = level + p * trend
                        new = a * v + (1 - a) * ahead
                        level, trend, sse = new, b * (new - level) + (1 - b) * p * trend, sse + (v - ahead) ** 2
                    if best is None or sse < best[0]:
                        best = sse, a, b, p, level, trend
        r = got[key]
        assert (r["sse"], r["alpha"], r["beta"], r["phi"], r["level"], r["trend"]) == pytest.approx(best)


def test_forecast_builds_the_asked_methods_only(spark):
    p = long(spark, {"a": [1.0, 2.0, 4.0, 3.0, 5.0]})
    assert {r["method"] for r in models.forecast(p, 2, methods=("drift", "holt")).collect()} == {"drift", "holt"}
    assert {r["method"] for r in models.forecast(p, 2, methods=("holt",)).collect()} == {"holt"}


def test_reconcile_equals_least_squares_on_ten_levels(spark):
    parents = {"1": None} | {str(n): str(n // 2) for n in range(2, 1024)}
    rng = np.random.default_rng(5)
    spread = {n: float(rng.uniform(0.5, 3)) for n in parents}
    y = {n: float(rng.normal(10, 2)) for n in parents}
    base = spark.createDataFrame([(n, h, v + h) for n, v in y.items() for h in (1, 2)] + [(n, 3, v) for n, v in y.items() if n != "1023"] + [(n, 4, v) for n, v in y.items() if n != "5"], "node string, h int, point double")
    rows = multi.reconcile(base, parents, spread).collect()
    nodes, leaves = list(parents), [n for n in parents if int(n) >= 512]
    s = np.array([[float(leaf == n or any(int(leaf) >> d == int(n) for d in range(1, 10))) for leaf in leaves] for n in nodes])

    def fitted(point, used):
        keep = np.array([n in used for n in nodes])
        w = np.array([1 / spread[n] for n in nodes]) * keep
        return dict(zip(nodes, s @ np.linalg.solve(s.T @ (w[:, None] * s), s.T @ (w * np.array([point[n] for n in nodes]))), strict=True))

    for h, want in ((1, fitted({n: v + 1 for n, v in y.items()}, set(nodes))), (4, fitted(y, set(nodes) - {"5"}))):
        assert {r["node"]: r["reconciled"] for r in rows if r["h"] == h} == pytest.approx(want)
    assert all(r["reconciled"] is None for r in rows if r["h"] == 3)


def test_cross_elasticity_of_several_pairs(spark):
    rows = [(k, t, 1.0 + 0.1 * t, (1.0 + 0.1 * t) ** e) for k, e in (("x", 1.0), ("y", -1.0)) for t in range(8)]
    got = {r["pair"]: r["relation"] for r in scenarios.cross_elasticity(spark.createDataFrame(rows, "pair string, t int, price_b double, quantity_a double"), ("pair",)).collect()}
    assert got == {"x": "substitute", "y": "complementary"}
