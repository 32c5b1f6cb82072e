"""Routed repairs with their way back, and parameters by successive halving."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import routing, tuning
from tidemark.sources.snapshots import Snapshots


def points(spark, held):
    rows = [(k, i, None if v is None or np.isnan(v) else float(v)) for k, y in held.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "series_id string, idx int, value double").repartition(3)


def with_holes(n, *at):
    y = 10 + np.arange(n) % 7.0
    y[list(at)] = np.nan
    return y


HELD = {"clean": with_holes(42), "dots": with_holes(42, 0, 20, 41), "gap": with_holes(70, 30, 31, 32), "two": with_holes(200, 5, 6, 7, 50, 51, 52), "thin": with_holes(42, *range(0, 42, 3)), "short": [1.0, 2.0], "wild": np.r_[np.ones(15), 900.0], "none": [None] * 12}


def test_each_series_by_its_gates(spark):
    done = routing.routed(points(spark, HELD), routing.Gates(coverage=90.0))
    got = {r["series_id"]: r for r in routing.routes(done).collect()}
    assert {k: (r["route"], r["reasons"]) for k, r in got.items()} == {
        "clean": ("clean", ""), "dots": ("linear", ""), "gap": ("seasonal", ""), "two": ("rejected", "gaps"), "thin": ("rejected", "coverage"), "short": ("rejected", "too_short"), "wild": ("rejected", "outliers"), "none": ("rejected", "coverage")
    }
    assert got["dots"]["repaired"] == 3 and got["gap"]["repaired"] == 3 and got["thin"]["repaired"] == 0
    value = {(r["series_id"], r["idx"]): r["value"] for r in done.collect()}
    assert [value["gap", i] for i in (30, 31, 32)] == [10 + i % 7 for i in (30, 31, 32)]
    assert (value["dots", 0], value["dots", 20], value["dots", 41]) == (11, (15 + 10) / 2, 15) and value["thin", 0] is None
    plan = routing.routed(points(spark, HELD))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    off = routing.routes(routing.routed(points(spark, HELD), routing.Gates(coverage=90.0, fix=False))).filter("series_id = 'gap'").head()
    assert off["route"] == "unrepaired" and off["repaired"] == 0
    assert routing.routed(points(spark, HELD).filter("false")).count() == 0


def test_hand_over_and_way_back(spark, tmp_path):
    snaps = Snapshots(spark, f"file://{tmp_path}/s")
    run = routing.Pipeline(snaps, routing.Gates(coverage=90.0))
    came = points(spark, HELD)
    report, left = run.run(came, "all")
    assert report["ok"] and (report["before"], report["after"]) == (1, 2) and report["rows"] == came.count() and report["filled"] == 6 and report["open"] == 0 == report["lost"]
    assert {r["series_id"] for r in left.select("series_id").distinct().collect()} == {"clean", "dots", "gap"} and left.filter("value is null").count() == 0 and left.columns == came.columns
    for damage, told in ((lambda df: df.withColumn("value", F.col("value") + 1), "known values changed"), (lambda df: df.limit(50), "rows differ"), (lambda df: df.withColumn("value", F.when(F.col("original").isNotNull(), F.col("value"))), "values are open")):
        report, left = run.run(came, "all", damage)
        assert not report["ok"] and told in report["failed"] and report["after"] is None
        assert sorted(map(str, left.collect())) == sorted(map(str, came.collect()))


def test_halving_reaches_the_grid(spark):
    rng = np.random.default_rng(6)
    held = {f"s{k}": 50 + np.cumsum(rng.normal(0.2 * (k % 3), 1, 60)) + rng.normal(0, k % 4, 60) for k in range(12)} | {"short": np.arange(10.0)}
    p = points(spark, held)
    grid = {r["series_id"]: r for r in tuning.tuned_holt(p, 3, 5).collect()}
    got = {r["series_id"]: r for r in tuning.halved_holt(p, 3, 5).collect()}
    assert got.keys() == grid.keys() and all(3 * r["fits"] <= 81 * 3 for r in got.values())
    ratio = np.array([got[k]["rmse"] / grid[k]["rmse"] for k in grid])
    assert np.median(ratio) <= 1.01 and ratio.mean() < 1.05
    again = {r["series_id"]: r for r in tuning.halved_holt(p.repartition(7), 3, 5).collect()}
    assert all(again[k]["alpha"] == pytest.approx(got[k]["alpha"]) for k in got)
