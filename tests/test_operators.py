"""Operators on planted truths and textbook values."""

import math

import pytest

from tidemark.functions import stats
from tidemark.operators import causal, evaluate, features, models, multi, prepare, quality, scenarios
from tidemark.sources import tables


def series(spark, values, name="s"):
    rows = [(name, k, None if v is None else float(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, idx int, value double")


def test_missing_runs_and_coverage(spark):
    values = [None if k in (10, 11, 12, 40) else 50 + k for k in range(60)]
    p = series(spark, values)
    kinds = {(r["first"], r["duration"]): r["kind"] for r in quality.missing_runs(p).collect()}
    assert kinds == {(10, 3): "complete_time_gap", (40, 1): "scattered_hole"}
    assert quality.coverage(p).head()["coverage"] == pytest.approx(93.33)


def test_imputation(spark):
    p = series(spark, [None if k == 10 else k for k in range(20)])
    assert {r["idx"]: r["value"] for r in quality.impute(p).collect()}[10] == 10
    p = series(spark, [None, 1, None, None, 4, None])
    assert [r["value"] for r in quality.impute(p).orderBy("idx").collect()] == [1, 1, 2.5, 2.5, 4, 4]


def test_outliers(spark):
    p = series(spark, [10000 if k == 50 else 100 + k % 7 for k in range(100)])
    assert [r["idx"] for r in quality.zscore_outliers(p).collect()] == [50]
    assert 50 in [r["idx"] for r in quality.hampel_outliers(p).collect()]


def test_level_shift(spark):
    p = series(spark, [(10 if k < 60 else 60) + 2 * math.sin(k) for k in range(120)])
    assert max(r["magnitude"] for r in quality.trend_shifts(p).collect()) > 40


def test_lag_is_recovered(spark):
    x = [math.sin(k / 31) + 0.3 * ((k * 16807) % 127) / 127 for k in range(300)]
    y = [0.8 * x[k - 3] if k >= 3 else 0.0 for k in range(300)]
    p = series(spark, x, "a").union(series(spark, y, "b"))
    best = multi.best_lags(multi.lagged_correlation(p, 6)).head()
    assert (best["lag"], round(best["r"], 2)) == (3, 1.0)
    edge = causal.granger_edges(p, 4, 2).filter("a = 'a'").head()
    assert edge["lag"] == 3 and edge["r"] > 0.9


def test_shift_of_forecasts(spark):
    """Values moved by a constant move forecasts by it."""
    v = [5 + 0.7 * k + (k * 37) % 11 for k in range(40)]
    methods = ("naive", "mean", "drift", "linear", "holt")
    a = {(r["method"], r["h"]): r["point"] for r in models.forecast(series(spark, v), 5, methods=methods).collect()}
    b = {(r["method"], r["h"]): r["point"] for r in models.forecast(series(spark, [x + 100 for x in v]), 5, methods=methods).collect()}
    assert all(b[k] == pytest.approx(a[k] + 100, abs=1e-6) for k in a)


def test_season_is_continued(spark):
    v = [10 * math.sin(2 * math.pi * k / 7) + 100 for k in range(70)]
    got = [r["point"] for r in models.holt_winters(series(spark, v), 7, 14).orderBy("h").collect()]
    assert got == pytest.approx([10 * math.sin(2 * math.pi * k / 7) + 100 for k in range(70, 84)], abs=0.5)
    assert 7 in [r["lag"] for r in features.seasonal_lags(series(spark, v), 20).collect()]


def test_reconciled_sums(spark):
    base = spark.createDataFrame([("t", 1, 10.0), ("a", 1, 4.0), ("b", 1, 5.0)], "node string, h int, point double")
    got = {r["node"]: r["reconciled"] for r in multi.reconcile(base, {"t": None, "a": "t", "b": "t"}).collect()}
    assert got["t"] == pytest.approx(got["a"] + got["b"])


def test_paths_are_seeded(spark):
    a = scenarios.simulate_paths(spark, 0.0, 0.0, 1.0, 5, 500, seed=3)
    b = scenarios.simulate_paths(spark, 0.0, 0.0, 1.0, 5, 500, seed=3).repartition(7)
    assert sorted(a.collect()) == sorted(b.collect())
    assert abs(a.filter("h = 1").agg({"value": "avg"}).head()[0]) < 0.2


def test_normal_distribution(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(stats.norm_cdf(F.lit(1.96)).alias("a"), stats.norm_cdf(F.lit(-1.0)).alias("b")).head()
    assert got["a"] == pytest.approx(0.975, abs=1e-4) and got["b"] == pytest.approx(0.15866, abs=1e-4)


def test_effect_of_event(spark):
    treated = [120 + 0.3 * k + (30 if k >= 100 else 0) + (k * 31) % 7 for k in range(200)]
    control = [90 + 0.3 * k + (k * 17) % 7 for k in range(200)]
    p = series(spark, treated, "t").union(series(spark, control, "c"))
    got = causal.diff_in_diff(p, "t", 100, 40, 40).head()
    assert abs(got["effect"] - 30) < 3 and got["t"] > 10


def test_csv(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('Date,"Value"\n2024-01-02,2\n\n2024-01-01,"1"\n2024-01-03,\n1704412800,4\n1704499200000,5\n')
    points, skipped = tables.read_series_csv(spark, str(f))
    assert [r["value"] for r in points.orderBy("idx").collect()] == [1, 2, 4, 5]
    assert skipped.count() == 1
    f.write_text("date,value\n2024-01-01,x\n")
    with pytest.raises(ValueError, match="bad row"):
        tables.read_series_csv(spark, str(f))


def test_ties_of_steps(spark):
    rows = [("s", k, t) for k, t in enumerate([0, 1, 3, 4, 6])]
    p = spark.createDataFrame(rows, "series_id string, idx int, s int").selectExpr("series_id", "idx", "timestamp_seconds(s) as t", "0.0D as value")
    assert prepare.dominant_step(p).head()["step_ms"] == 1000


def test_metrics_with_zeros(spark):
    p = spark.createDataFrame([("s", 1, 0.0, 0.0), ("s", 2, 0.0, 1.0), ("s", 3, 2.0, 1.0)], "series_id string, h int, value double, point double")
    got = p.groupBy("series_id").agg(*evaluate.metric_columns(p["value"], p["point"])).head()
    assert got["mape"] == pytest.approx(50) and got["smape"] == pytest.approx(100 * (0 + 2 + 2 / 3) / 3)
