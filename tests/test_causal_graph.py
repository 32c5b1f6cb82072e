"""Lagged relations against least squares step by step, with blocks and tiles of few steps and series."""

import numpy as np
import pytest

from tidemark.operators import causal_graph, multi


def long(spark, series):
    return spark.createDataFrame([(k, i, None if np.isnan(v) else float(v)) for k, y in series.items() for i, v in enumerate(y)], "series_id string, idx int, value double").repartition(4)


def rss(x, y):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    return float(((y - x @ beta) ** 2).sum())


def test_of(x, y, n, max_lag, ar_lag):
    t = np.arange(n)
    x, y = (v[:n] - np.polyval(np.polyfit(t, v[:n], 1), t) for v in (x, y))
    start = max(max_lag, ar_lag)
    target, lags = y[start:], [x[start - k : n - k] for k in range(max_lag + 1)]
    own = [np.ones(n - start), *(y[start - k : n - k] for k in range(1, ar_lag + 1))]
    r = np.array([np.corrcoef(v, target)[0, 1] for v in lags])
    k = int(np.argmax(np.abs(r)))
    full = rss(np.column_stack([*own, *lags]), target)
    df2 = len(target) - len(own) - len(lags)
    f = (rss(np.column_stack(own), target) - full) / (max_lag + 1) / (full / df2)
    per, agree = len(target) // 4, 0
    for w in range(4 if per >= 8 else 0):
        s = slice(w * per, (w + 1) * per)
        agree += np.sign(np.corrcoef(lags[k][s], target[s])[0, 1]) == np.sign(r[k])
    return k, r[k], r[k] * y.std(ddof=1) / x.std(ddof=1), f, df2, agree / 4, min(1, 0.6 * abs(r[k]) + 0.1 * agree)


test_of.__test__ = False


@pytest.mark.parametrize(("steps", "tile"), [(2048, 256), (37, 2)])
def test_edges_equal_least_squares(spark, monkeypatch, steps, tile):
    for module in (causal_graph, multi):
        monkeypatch.setattr(module, "STEPS", steps)
        monkeypatch.setattr(module, "TILE", tile)
    rng = np.random.default_rng(7)
    n = 150
    a = np.cumsum(rng.normal(0, 0.3, n)) + rng.normal(0, 1, n)
    series = {"a": a, "b": 0.8 * np.r_[0, 0, 0, a[:-3]] + rng.normal(0, 0.5, n) + 0.05 * np.arange(n), "c": rng.normal(5, 2, n + 9), "d": 3 - np.sin(np.arange(n) / 13) * 2 + rng.normal(0, 0.2, n), "e": rng.normal(0, 1, n)}
    got = {(r["a"], r["b"]): r for r in causal_graph.edges(long(spark, series), 6, 4).collect()}
    assert len(got) == 20
    for (x, y), r in got.items():
        k, top, effect, f, df2, stability, confidence = test_of(series[x], series[y], n, 6, 4)
        assert (r["lag"], r["df1"], r["df2"]) == (k, 7, df2)
        assert (r["r"], r["effect"], r["stability"], r["confidence"]) == pytest.approx((top, effect, stability, confidence))
        assert r["f"] == pytest.approx(f, rel=1e-6) and len(r["profile"]) == 7
    assert got["a", "b"]["lag"] == 3 and got["a", "b"]["p"] < 1e-6 and got["a", "b"]["r"] > 0.8


def test_planted_and_unrelated(spark):
    """A lag of 3 is found with confidence; a wave and noise that share nothing are no link."""
    seed = [7]

    def noise():
        seed[0] = seed[0] * 16807 % 2147483647
        return seed[0] / 2147483647 - 0.5

    x = np.array([0.5 * np.sin(t / 31) + 0.3 * noise() for t in range(300)])
    y = np.array([0.8 * x[max(0, t - 3)] + 0.05 * noise() for t in range(300)])
    found = causal_graph.discoveries(causal_graph.edges(long(spark, {"x": x, "y": y}), 8, 4)).collect()
    first = next(r for r in found if r["a"] == "x")
    assert first["lag"] == 3 and first["r"] > 0.8 and first["p"] < 1e-6 and first["confidence"] > 0.8 and first["direction"] in ("forward", "reverse")
    assert sum(r["direction"] == "forward" for r in found) == 1 and all(r["feedback"] == (len(found) == 2) for r in found)
    none = causal_graph.edges(long(spark, {"x": np.sin(np.arange(200) / 13) + 0.2 * np.array([noise() for _ in range(200)]), "z": 5 + 2 * np.array([noise() for _ in range(200)])}), 5, 4).filter("a = 'x'").head()
    assert none["p"] > 0.05 and none["confidence"] < 0.5


def test_false_discoveries_are_held(spark):
    rng = np.random.default_rng(3)
    p = np.r_[rng.uniform(0, 1, 300), rng.uniform(0, 1e-4, 12), 0.0, np.nan]
    rows = [(f"s{k}", f"t{k}", None if np.isnan(v) else float(v), 0.5) for k, v in enumerate(p)]
    df = spark.createDataFrame(rows, "a string, b string, p double, confidence double")
    known = np.sort(p[~np.isnan(p)])
    passed = [v for k, v in enumerate(known, 1) if v * len(known) <= 0.05 * k]
    got = causal_graph.discoveries(df, 0.05, control=True)
    assert got.count() == (known <= max(passed)).sum() < causal_graph.discoveries(df, 0.05).count()


def test_short_gaps_and_constants(spark):
    assert causal_graph.edges(long(spark, {"a": np.arange(20.0), "b": np.arange(20.0)})).count() == 0
    y = np.sin(np.arange(60) / 3)
    holes = y.copy()
    holes[10] = np.nan
    got = causal_graph.edges(long(spark, {"flat": np.full(60, 2.0), "y": y, "holes": holes}), 3, 2).collect()
    assert len(got) == 6 and all(r["r"] is None and r["confidence"] == 0 for r in got if "flat" in (r["a"], r["b"]))
