"""Feature configurations, windows and quality reports on planted series."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import design

DAY0 = dt.date(2024, 1, 1)


def series(spark, values, name="a"):
    rows = [(name, DAY0 + dt.timedelta(days=i), i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, t date, idx int, value double")


@pytest.mark.parametrize(
    "config",
    [
        {},
        {"furier": {}},
        {"fourier": {"season": [7]}},
        {"fourier": {"seasons": [1]}},
        {"fourier": {"seasons": [7], "harmonics": 4}},
        {"fourier": {"seasons": [7, 30], "harmonics": [1]}},
        {"fourier": {"seasons": [7], "auto": True}},
        {"lags": [0]},
    ],
)
def test_configurations_that_are_refused(config):
    with pytest.raises(ValueError):
        design.parse_config(config)


def test_terms_of_history_go_on_in_the_future(spark):
    config = design.parse_config({"fourier": {"seasons": [7, 12], "harmonics": [2, 1]}, "weekdays": True, "lags": [2]})
    points = series(spark, [float(i) for i in range(20)])
    past = {r["idx"]: r for r in design.feature_matrix(points, config).collect()}
    assert all(len(r["terms"]) == 4 + 2 + 6 for r in past.values()) and past[0]["terms"][6:] == [0.0] * 6 and past[1]["terms"][6] == 1.0
    assert past[5]["lagged"] == [3.0] and past[1]["lagged"] == [None]
    assert past[3]["terms"][:2] == pytest.approx([math.sin(6 * math.pi / 7), math.cos(6 * math.pi / 7)])
    longer = {r["idx"]: r["terms"] for r in design.feature_matrix(series(spark, [0.0] * 30), config).collect()}
    coming = design.future_matrix(points, config, 10).collect()
    assert len(coming) == 10 and all(r["terms"] == pytest.approx(longer[r["idx"]]) for r in coming)


def test_found_seasons_without_their_multiples(spark):
    config = design.parse_config({"fourier": {"auto": True, "harmonics": 2}})
    points = series(spark, [math.sin(2 * math.pi * i / 8) for i in range(160)]).unionByName(series(spark, [float(i % 2 == 0 and i) for i in range(4)], "short"))
    m = design.feature_matrix(points, config)
    rows = {(r["series_id"], r["idx"]): r for r in m.collect()}
    assert rows["a", 0]["seasons"][0] == 8 and 16 not in rows["a", 0]["seasons"] and rows["short", 0]["terms"] == []
    assert design.matrix_faults(m).count() == 0
    broken = m.withColumn("terms", F.when(F.col("idx") == 3, F.array(F.lit(None).cast("double"))).otherwise(F.col("terms")))
    assert {(r["series_id"], r["widths"], r["unusable"]) for r in design.matrix_faults(broken).collect()} == {("a", 2, 1), ("short", 2, 1)}


def test_windows(spark):
    p = series(spark, [float(i) for i in range(100)]).filter("idx % 2 = 0")
    n = lambda *a: design.window_of(p, *a).count()
    assert n(7) == 7 and n("last_3_weeks") == 21 and n("last_1_month") == 30 and n("last_9") == 9
    assert n("last_10_days", "time") == 5 and n("last_48_hours", "time") == 1
    for bad in (("last_days",), ("last_0_days",), ("last_3_years",), ("last_3_months", "space")):
        with pytest.raises(ValueError):
            design.window_of(p, *bad)


def test_findings_of_planted_faults(spark):
    values = [10.0 + (i % 7) for i in range(70)]
    values[20] = values[21] = None
    values[30:35] = [None] * 5
    values[50], values[51] = 500.0, 480.0
    p = series(spark, values).unionByName(series(spark, [5.0] * 40, "flat"))
    seen = p.select("series_id", "t").unionByName(p.filter("series_id = 'a' and idx < 3").select("series_id", "t"))
    found = [tuple(r) for r in design.findings(p, 7, seen).collect()]
    assert {("a", "hole", "warning", 20, 21, 2), ("a", "gap", "error", 30, 34, 5), ("a", "outlier", "warning", 50, 50, 1), ("a", "outlier_cluster", "warning", 50, 51, 2), ("a", "duplicate", "error", None, None, 3)} <= set(found)
    assert not [f for f in found if f[0] == "flat"]
    rows = {r["series_id"]: r for r in design.quality_profile(p, 7, seen).collect()}
    assert rows["flat"]["health"] == 100 and rows["flat"]["issues"] == "" and rows["a"]["missing"] == 7 and rows["a"]["errors"] == 2
    assert rows["a"]["health"] == round(100 * (1 - 9 / 15), 1) and "gap:1" in rows["a"]["issues"]
    assert design.findings(p.limit(0)).count() == 0 and design.quality_profile(p.limit(0)).count() == 0
