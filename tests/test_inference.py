"""Test statistics against known values, least squares against numpy, panels, reports and scenarios on small cases."""

import math

import numpy as np
import pytest

from tidemark.functions.significance import f_p_value, incomplete_beta, t_p_value
from tidemark.operators import inference, panel, report, shocks


def test_p_values(spark):
    rows = spark.createDataFrame([(2.0, 10.0), (2.947, 15.0), (0.0, 5.0), (None, 5.0), (1.0, 0.0)], "t double, v double")
    got = [r[0] for r in rows.select(t_p_value(rows["t"], rows["v"])).collect()]
    assert got[:3] == pytest.approx([0.0734, 0.01, 1.0], abs=1e-3) and all(x is None or math.isnan(x) for x in got[3:])
    rows = spark.createDataFrame([(4.0, 1.0, 10.0), (1.0, 2.0, 20.0)], "f double, a double, b double")
    assert [r[0] for r in rows.select(f_p_value(rows["f"], rows["a"], rows["b"])).collect()] == pytest.approx([0.0734, 0.3855], abs=1e-3)
    assert incomplete_beta(2, 3, 0.0) == 0 and incomplete_beta(2, 3, 1.0) == 1 and incomplete_beta(1, 1, 0.3) == pytest.approx(0.3)


def test_least_squares(spark):
    r = np.random.default_rng(3)
    x1, x2, e = r.standard_normal(100), r.standard_normal(100), r.standard_normal(100)
    rows = [("noisy", float(a), float(b), float(3 + 2 * a - 4 * b + c)) for a, b, c in zip(x1, x2, e)]
    rows += [("exact", float(a), float(b), float(3 + 2 * a - 4 * b)) for a, b in zip(x1, x2)]
    rows += [("collinear", float(k), float(2 * k), float(k)) for k in range(10)] + [("short", 1.0, 2.0, 3.0)] * 4 + [("noisy", None, 1.0, 1.0)]
    got = {(g["series_id"], g["term"]): g for g in inference.ols(spark.createDataFrame(rows, "series_id string, x1 double, x2 double, y double"), "y", ("x1", "x2")).collect()}
    m = np.column_stack([np.ones(100), x1, x2])
    y = m @ [3, 2, -4] + e
    beta = np.linalg.solve(m.T @ m, m.T @ y)
    sigma = np.sqrt(((y - m @ beta) ** 2).sum() / 97 * np.diag(np.linalg.inv(m.T @ m)))
    for k, term in enumerate(("intercept", "x1", "x2")):
        g = got["noisy", term]
        assert (g["n"], g["beta"], g["se"], g["t"]) == pytest.approx((100, beta[k], sigma[k], beta[k] / sigma[k])) and g["p"] < 1e-6 and not g["degenerate"]
        assert got["exact", term]["beta"] == pytest.approx((3, 2, -4)[k]) and got["exact", term]["degenerate"] and got["exact", term]["se"] is None
        assert got["collinear", term]["regularised"] and ("short", term) not in got


def points(spark, series):
    return spark.createDataFrame([(s, k, float(v)) for s, vs in series.items() for k, v in enumerate(vs)], "series_id string, idx int, value double")


def test_panel_and_report(spark):
    line = [10 + 2 * k for k in range(30)]
    p = points(spark, {"line": line, "flat": [5] * 30, "few": [1, 2, 3]})
    f = panel.panel_forecasts(p, 5)
    assert {r["series_id"] for r in f.collect()} == {"line", "flat"}
    errors = {(r["method"], r["category"]): r["rmse"] for r in panel.compare_methods(f, "series_id").collect()}
    assert errors["drift", "line"] == pytest.approx(0, abs=1e-9) and errors["linear", "line"] == pytest.approx(0, abs=1e-9) and errors["naive", "line"] > 1
    assert all(errors[m, "flat"] == pytest.approx(0, abs=1e-9) for m in panel.METHODS)
    spiked = [100 + k % 7 for k in range(100)]
    spiked[50] = 10_000
    found = report.anomaly_union(points(spark, {"s": spiked, "flat": [5] * 30, "few": [1, 9, 1]})).collect()
    assert [(r["idx"], r["severity"], r["methods"]) for r in found] == [(50, 3, "mad,iqr,zscore")]
    base = {r["h"]: r["point"] for r in report.naive_baseline(points(spark, {"line": line}), 3).collect()}
    assert base == pytest.approx({1: 70, 2: 72, 3: 74})
    kept = report.thinned_peaks(spark.createDataFrame([("s", 1, 5.0), ("s", 3, 7.0), ("s", 4, 6.0), ("s", 9, 1.0)], "series_id string, idx int, height double"), 4)
    assert sorted(r["idx"] for r in kept.collect()) == [3, 9]
    weights = report.scenario_weights(spark.createDataFrame([("a", 0.0), ("b", 0.0)], "name string, p double"))
    assert [r["p"] for r in weights.collect()] == [0.5, 0.5]


def test_empty_and_tied(spark):
    none = points(spark, {"s": [1]}).limit(0)
    for out in (report.anomaly_union(none), report.top_points(none), report.naive_baseline(none, 2, 7), panel.panel_forecasts(none, 3), shocks.dynamic_price(none), shocks.risks(none), inference.ols(none, "value", ("idx",))):
        assert out.count() == 0
    tied = report.top_points(points(spark, {"s": [1, 1, 1, 1, 9, 9]}), 2).collect()
    assert [(r["rank"], r["idx"]) for r in tied] == [(1, 4), (2, 5)]


def test_wide_csv(spark, tmp_path):
    from tidemark.sources import tables

    (tmp_path / "w.csv").write_text("when,a,b\n2024-01-03,3,30\n2024-01-01,1,10\n2024-01-02,,20\n\n2024-01-04,4,\n")
    rows, left_out = tables.read_wide_csv(spark, str(tmp_path / "w.csv"))
    assert [(r["a"], r["b"]) for r in rows.collect()] == [(1.0, 10.0), (3.0, 30.0)] and left_out == 2
    rows, left_out = tables.read_wide_csv(spark, str(tmp_path / "w.csv"), value_columns=["a"])
    assert rows.columns == ["t", "a"] and rows.count() == 3 and left_out == 1
    (tmp_path / "x.csv").write_text("t,a\n2024-01-01,one\n")
    with pytest.raises(ValueError, match="bad row"):
        tables.read_wide_csv(spark, str(tmp_path / "x.csv"))
    with pytest.raises(ValueError, match="no column"):
        tables.read_wide_csv(spark, str(tmp_path / "x.csv"), "nope")
