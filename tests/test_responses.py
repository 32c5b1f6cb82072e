"""Responses against planted coefficients, interventions and paths against their formulas, reports on small cases."""

import math

import numpy as np
import pytest

from tidemark.operators import responses


def points(spark, series):
    return spark.createDataFrame([(s, k, float(v)) for s, vs in series.items() for k, v in enumerate(vs)], "series_id string, idx int, value double")


@pytest.fixture(scope="module")
def planted(spark):
    r = np.random.default_rng(21)
    x = 10 + 3 * r.standard_normal(300)
    y = 50 + 0.4 * np.roll(x, 1) + 0.2 * np.roll(x, 2) + 0.3 * r.standard_normal(300)
    return points(spark, {"x": x, "y": y, "other": x[:50]})


def test_lag_response(spark, planted):
    got = {r["lag"]: r for r in responses.lag_response(planted, "x", "y", 3).collect()}
    assert [got[k]["coefficient"] for k in range(4)] == pytest.approx([0, 0.4, 0.2, 0], abs=0.05)
    assert got[0]["n"] == 297 and got[0]["r2"] > 0.8 and got[0]["sigma"] == pytest.approx(0.3, abs=0.05)
    assert responses.lag_response(planted, "x", "absent", 3).count() == 0


def test_intervention(spark, planted):
    response = spark.createDataFrame([(0, 0.5, 0.1), (1, 0.25, 0.1)], "lag int, coefficient double, sigma double")
    got = responses.intervention(planted, response, "y", 4.0, start=1, duration=2, horizon=5).orderBy("h").collect()
    assert [r["delta"] for r in got] == pytest.approx([0, 2, 3, 1, 0]) and got[-1]["cumulative"] == pytest.approx(6)
    v = [r["value"] for r in planted.filter("series_id = 'y'").orderBy("idx").collect()]
    assert got[2]["baseline"] == pytest.approx(v[-1] + 3 * (v[-1] - v[-76]) / 75)
    half = 1.28 * np.std(v, ddof=1) + 0.1 * math.sqrt(2)
    assert (got[2]["lower"], got[2]["upper"]) == pytest.approx((got[2]["counterfactual"] - half, got[2]["counterfactual"] + half))
    late = responses.intervention(planted, response, "y", 4.0, start=9, horizon=5).collect()
    assert len(late) == 5 and all(r["delta"] == 0 for r in late)


def test_sums_of_paths(spark):
    rows = [("a", p, s, float(p * s)) for p in range(1, 11) for s in range(1, 5)]
    got = responses.cumulative_intervals(spark.createDataFrame(rows, "series_id string, path int, step int, value double"), 2, 0.75).collect()
    assert [(r["paths"], r["estimate"], r["lower"], r["upper"]) for r in got] == [(10, 16.5, 6.0, 30.0)]


def test_random_paths(spark):
    at = lambda kind, v, **k: np.array([r["value"] for r in responses.random_paths(spark, kind, 100.0, v, 8, sims=20_000, **k).filter("step = 8").collect()])
    a = at("autoregressive", 2.0)
    assert a.mean() == pytest.approx(100 * 0.95**8, abs=0.1) and a.var() == pytest.approx(4 * sum(0.95 ** (2 * k) for k in range(8)), rel=0.05)
    g = np.log(at("geometric", 0.3, drift=0.1) / 100)
    assert g.mean() == pytest.approx((0.1 - 0.045) * 8 / 252, abs=1e-3) and g.std() == pytest.approx(0.3 * math.sqrt(8 / 252), rel=0.03)
    m = np.log(at("multiplicative", 0.02) / 100)
    assert abs(m.mean()) < 2e-3 and m.std() == pytest.approx(0.02 * math.sqrt(8), rel=0.03)
    few = spark.createDataFrame([(k, 1, float(k)) for k in range(10)], "path int, step int, value double")
    assert tuple(responses.path_percentiles(few).first()) == (1, 0.0, 5.0, 9.0)
    with pytest.raises(ValueError):
        responses.random_paths(spark, "other", 1.0, 1.0, 1)


def test_light_additive_and_report(spark):
    v = [5.0, 7.0] * 10 + [5.0]
    got = responses.light_additive(points(spark, {"a": v, "one": [3.0]}), 2, 26)
    rows = {(r["series_id"], r["h"]): r for r in got.collect()}
    assert rows["a", 1]["point"] == pytest.approx(6 + 0.1 * -2 * 3 + 5) and rows["a", 2]["upper"] - rows["a", 2]["point"] == pytest.approx(1.96 * 2)
    assert rows["one", 1]["point"] == 3
    text = {r["series_id"]: r["report"] for r in responses.markdown_reports(got).collect()}
    assert text["one"].startswith("# one\n\n| Step | Forecast |") and text["one"].count("\n| ") == 25 and text["one"].endswith("\n\nShowing the first 24 of 26 steps.")
    assert "Showing" not in responses.markdown_reports(got.filter("h <= 3")).first()["report"]
