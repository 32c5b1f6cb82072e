"""Pairs of series by tiles against plain loops."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import inference, pairs

SCHEMA = "series_id string, idx bigint, value double"


def _series(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    base = rng.normal(size=150).cumsum()
    out = {f"s{k}": 1e6 + base * rng.normal() + rng.normal(size=150) * 3 for k in range(7)}
    out["turning"] = np.where(np.arange(150) < 70, base, -base)
    out["constant"] = np.full(150, 4.0)
    out["late"] = np.where(np.arange(150) < 61, np.nan, base)
    out["short"] = np.where(np.arange(150) < 12, base, np.nan)
    out["holes"] = np.where(rng.random(150) < 0.3, np.nan, base + rng.normal(size=150))
    return out


def _frame(spark, series):
    rows = [(name, k, float(v)) for name, y in series.items() for k, v in enumerate(y) if not np.isnan(v)]
    return spark.createDataFrame([*rows, ("s0", 200, None)], SCHEMA)


def _plain(series, windows, least):
    out = {}
    for a in series:
        for b in series:
            if a >= b:
                continue
            at = np.flatnonzero(~np.isnan(series[a]) & ~np.isnan(series[b]))
            if not len(at):
                continue
            r = lambda ks: np.corrcoef(series[a][ks], series[b][ks])[0, 1] if len(ks) > 1 and np.ptp(series[a][ks]) and np.ptp(series[b][ks]) else np.nan  # noqa: B023, E731
            whole, size = r(at), len(at) // windows
            parts = [r(at[(at - at[0]) // size == w]) for w in range(windows)] if size >= least else []
            parts = [np.sign(x) == np.sign(whole) for x in parts if not np.isnan(x)]
            out[a, b] = (len(at), whole, np.mean(parts) if parts else 0.0)
    return out


@pytest.mark.parametrize(("steps", "tile"), [(2048, 256), (32, 3)])
def test_pairs_equal_plain_loops(spark, monkeypatch, steps, tile):
    monkeypatch.setattr(pairs, "STEPS", steps)
    monkeypatch.setattr(pairs, "TILE", tile)
    series = _series()
    points, want = _frame(spark, series), _plain(series, 3, 8)
    got = {(r["a"], r["b"]): r for r in pairs.pair_correlations(points).collect()}
    assert set(got) == set(want)
    signs = {(r["a"], r["b"]): r for r in pairs.stable_signs(points, 3, 8).collect()}
    assert set(signs) == set(want)
    for key, (n, r, stability) in want.items():
        assert got[key]["n"] == n
        for told in (got[key]["r"], signs[key]["r"]):
            assert told is None if np.isnan(r) else told == pytest.approx(r, abs=1e-9)
        assert signs[key]["stability"] == pytest.approx(stability, abs=1e-12), key


def test_pairs_of_no_series(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pairs.pair_correlations(empty).count() == 0
    assert pairs.stable_signs(empty).count() == 0


def test_clusters_are_numbered_by_kind(spark):
    rows = [("a", "b", 50, 0.9), ("a", "c", 50, 0.8), ("b", "c", 50, -0.9), ("c", "d", 50, 0.75), ("d", "e", 50, None)]
    got = inference.correlated_pairs(spark.createDataFrame(pd.DataFrame(rows, columns=["a", "b", "n", "r"])), 0.7).orderBy("a", "b").collect()
    assert [(r["a"], r["b"], r["relation"], r["cluster"]) for r in got] == [("a", "b", "positive", 1), ("a", "c", "positive", 1), ("b", "c", "negative", 1), ("c", "d", "positive", 2), ("d", "e", "weak", None)]
