"""Planted truths for what SQL can't express, and for edge cases of anomalies, cascades, feeds and reports."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import anomalies, tuning
from tidemark.sources import reports, tables
from tidemark.streaming import feeds


def series(spark, **values):
    return spark.createDataFrame([(s, i, float(v)) for s, vs in values.items() for i, v in enumerate(vs)], "series_id string, idx int, value double")


def test_isolation_finds_the_planted_point(spark):
    points = series(spark, a=[100 + i % 7 for i in range(60)] + [900], flat=[5] * 20, one=[1])
    got = anomalies.isolation_scores(points).collect()
    a = sorted((r for r in got if r["series_id"] == "a"), key=lambda r: -r["score"])
    assert a[0]["idx"] == 60 and a[0]["score"] > 0.6 > a[1]["score"]
    again = anomalies.isolation_scores(points.repartition(3)).collect()
    assert {(r["series_id"], r["idx"]): r["score"] for r in got} == {(r["series_id"], r["idx"]): r["score"] for r in again}


def test_equal_trends_of_many_prices_are_no_reversal(spark, tmp_path):
    """Days of 1,000 prices with cents rise by 100 a day, so that the slopes on either side of the peak are equal."""
    rows = spark.range(40_000).withColumn("day", (F.col("id") % 40).cast("int"))
    price = F.round(1100.1 + F.col("day") * 0.1 + F.when(F.col("day") == 20, 100).otherwise(0), 1)
    rows.select(price.alias("o_totalprice"), F.expr("timestamp_seconds(day * 86400)").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    days = tables.daily_orders(spark, str(tmp_path))
    assert [r["value"] for r in days.orderBy("idx").collect()] == [1100100.0 + 100 * k + 100000 * (k == 20) for k in range(40)]
    got = anomalies.anomaly_patterns(days).collect()
    assert [(r["idx"], r["before"], r["after"], r["pattern"]) for r in got] == [(20, 100.0, 100.0, "extreme_outlier")]


def test_cusum_restarts(spark):
    got = anomalies.cusum(series(spark, a=[0] * 20 + [10] * 5 + [0] * 20, flat=[3] * 4), threshold=4.0).collect()
    assert {r["idx"] for r in got if r["series_id"] == "a" and r["detected"]} & set(range(21, 26))
    assert not any(r["detected"] for r in got if r["series_id"] == "flat") and all(r["up"] >= 0 >= r["down"] for r in got)


def test_cascade_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 4, 0.0), (2, 2, 1.0)], "src bigint, dst bigint, p double")
    got = {r["node"]: r["round"] for r in tuning.cascade(edges, spark.createDataFrame([(1,)], "node bigint")).collect()}
    assert got == {1: 0, 2: 1, 3: 2}
    assert tuning.cascade(edges, spark.createDataFrame([], "node bigint")).count() == 0


def test_feed_lines(spark):
    lines = ['{"value": 1, "t": 1704067200}', '{"series": "s", "value": "2.5", "time": "2024-01-01T00:00:00Z"}', '{"seriesId": "x", "value": null}', "broken", '{"value": 3, "date": 1704067200000}', '{"value": "NaN", "t": 1}']
    got = feeds.points_from_json(spark.createDataFrame([(x,) for x in lines], "line string")).select("series_id", F.unix_millis("t").alias("ms"), "value").collect()
    assert sorted(tuple(r) for r in got) == [("default", 1704067200000, 1.0), ("default", 1704067200000, 3.0), ("s", 1704067200000, 2.5)]


def test_reports(spark, tmp_path):
    points = series(spark, a=range(40)).withColumn("t", F.expr("timestamp_seconds(idx * 86400)"))
    (row,) = reports.json_reports(points, 5, 3).collect()
    report = json.loads(row["report"])
    # a line: drift and linear are both exact
    assert report["backtest"][0]["rmse"] == pytest.approx(0, abs=1e-6) and [s["h"] for s in report["forecast"]] == [1, 2, 3]
    assert report["forecast"][2]["point"] == pytest.approx(42)
    f = spark.createDataFrame([("a", "naive", 1, 2.0, 1.0, 3.0)], "series_id string, method string, h int, point double, lower double, upper double")
    reports.write_forecast_csv(f, f"file://{tmp_path}/csv")
    assert spark.read.csv(f"file://{tmp_path}/csv", header=True).columns == ["method", "step", "point", "lower_80pct", "upper_80pct", "series_id"]
