"""Guidance and intermittent demand against plain computations and defined cases."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import guidance, models
from tidemark.plans import registry


def series(spark, held):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(hours=i), i, None if v is None else float(v)) for k, y in held.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "series_id string, t timestamp, idx int, value double")


def test_croston_equals_the_fold(spark):
    rng = np.random.default_rng(2)
    held = {"a": (rng.random(60) < 0.3) * rng.integers(1, 9, 60), "none": [0, 0, 0], "first": [4, 0, 0, 2], "null": [3, None, 0, 5]}
    got = {r["series_id"]: r for r in models.croston(series(spark, held)).collect()}
    for key, y in held.items():
        q = tq = float(y[0])
        p = 0.5
        for v in y:
            v = 0 if v is None else v
            if v > 0:
                q, tq = 0.5 * v + 0.5 * q, 0.2 * v + 0.8 * tq
            p = 0.2 * (v > 0) + 0.8 * p
        assert (got[key]["demand"], got[key]["tsb"]) == pytest.approx((q, p * tq))


def test_croston_needs_no_rows_without_demand(spark):
    held = {"a": [3, 0, 0, 5, 0, None, 1], "once": [2], "tail": [0, 0, 4, 0]}
    full = series(spark, held)
    ends = {k: {0, len(y) - 1} for k, y in held.items()}
    rows = [(k, 9000 + i, None if v is None else float(v)) for k, y in held.items() for i, v in enumerate(y) if v or i in ends[k]]
    got = {r["series_id"]: (r["demand"], r["tsb"]) for r in models.croston(spark.createDataFrame(rows, "series_id string, idx int, value double")).collect()}
    want = {r["series_id"]: (r["demand"], r["tsb"]) for r in models.croston(full).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_demand_grows_with_the_lines_not_with_the_days(spark, tmp_path):
    rows = [(1, 5.0, "1970-01-02"), (1, 2.0, "2169-12-30"), (1, 1.0, "2169-12-30"), (2, None, "2000-01-01"), (2, 7.0, "2000-01-09"), (None, 4.0, "2000-01-01"), (3, 1.0, None), (4, -2.0, "2000-01-01"), (4, 3.0, "2000-01-02")]
    lines = spark.createDataFrame(rows, "l_partkey bigint, l_quantity double, l_shipdate string").withColumn("l_shipdate", F.to_timestamp("l_shipdate"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert registry._demand(spark, str(tmp_path)).count() == 7
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    got = registry.queries()["croston"](spark, str(tmp_path)).select("series_id", "demand", "tsb").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(registry.oracle_sql()["croston"]).fetchall()))
    assert len(got) == 4


def test_recommendation_by_kind_of_series(spark):
    rng = np.random.default_rng(4)
    t = np.arange(120)
    held = {"sparse": np.where(t % 4 == 0, 5, 0), "noise": rng.normal(100, 1, 120), "slow": 10 * np.sin(t / 9) + 0.3 * t, "short": [1, 2], "flat": [3.0] * 20}
    got = {r["series_id"]: r for r in guidance.recommendation(guidance.traits(series(spark, held))).collect()}
    assert {k: r["method"] for k, r in got.items()} == {"sparse": "croston", "noise": "mean", "slow": "holt", "flat": "mean"}
    assert "stl" in got["slow"]["alternatives"] and 0.4 <= got["slow"]["confidence"] <= 0.95
    weights = {r["series_id"]: r for r in guidance.starting_weights(guidance.traits(series(spark, held))).collect()}
    assert weights["noise"]["alpha"] == pytest.approx(0.21) and weights["slow"]["gamma"] > 0.3


def test_seasons_without_multiples(spark):
    t = np.arange(140)
    got = guidance.auto_seasons(series(spark, {"a": np.sin(2 * np.pi * t / 7)}), 22).collect()
    assert {r["season"] for r in got} == {7, 21}
    assert {r["season"] for r in guidance.auto_seasons(series(spark, {"a": np.sin(2 * np.pi * t / 7)}), 22, harmonics=3).collect()} == {7}
    rows = spark.createDataFrame([("a", 7, 0.9), ("b", 24, 0.85), ("c", 7, 0.3), ("c", 30, 0.4)], "series_id string, season int, acf double")
    methods = {r["series_id"]: r["methods"] for r in guidance.seasonal_methods(rows).collect()}
    assert methods == {"a": "naive,theta,seasonal_naive,holt_winters,stl", "b": "naive,theta,seasonal_naive,holt_winters,snaive,stl", "c": "naive,theta,stl,ms_holt_winters,fourier_arima"}


def test_refresh_decisions_and_alerts(spark):
    y = [1.0, 1.1] * 10 + [9.0] * 10
    reasons = [r["reason"] for r in guidance.refresh_decisions(series(spark, {"a": y}), every=5, recent=5, threshold=0.5).orderBy("idx").collect()]
    assert reasons[:10] == ["insufficient-data"] * 9 + ["no-fit"]
    assert reasons[14] == "new-points" and reasons[15] == "below-threshold" and reasons[24] == "drift"
    want = [i for i in range(5, 30) if abs(y[i] - np.mean(y[:i])) > 4 * np.std(y[:i], ddof=1)]
    got = guidance.anomaly_alerts(series(spark, {"a": y, "b": [2.0] * 8}), 4.0).collect()
    assert 20 in want and sorted(r["idx"] for r in got if r["series_id"] == "a") == want and {r["series_id"] for r in got} == {"a"}


def test_future_steps_of_hours(spark):
    rows = guidance.future_steps(series(spark, {"a": [1, 2, 3]}), 2).orderBy("h").collect()
    assert [r["label"] for r in rows] == ["2024-01-01 03:00", "2024-01-01 04:00"]


def test_nothing_in_nothing_out(spark):
    empty = series(spark, {"a": [1.0]}).filter("false")
    for out in (guidance.recommendation(guidance.traits(empty)), guidance.auto_seasons(empty, 5), guidance.refresh_decisions(empty), guidance.anomaly_alerts(empty), guidance.future_steps(empty, 3), models.croston(empty)):
        assert out.count() == 0
