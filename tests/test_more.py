"""Holidays, snapshots, plugins, alerts, decomposition, regressions and streams."""

import datetime
import math

import numpy as np
import pytest

from tidemark import plugins
from tidemark.functions import holidays
from tidemark.operators import decompose, quality, regress
from tidemark.sources.snapshots import Snapshots, content_hash
from tidemark.streaming import alerts
from tidemark.streaming.engine import IncrementalState


def series(spark, values, name="s"):
    return spark.createDataFrame([(name, k, None if v is None else float(v)) for k, v in enumerate(values)], "series_id string, idx int, value double")


def test_easter():
    # published dates
    assert [str(holidays.easter(y)) for y in (1961, 1981, 2000, 2008, 2011, 2024, 2025, 2038)] == ["1961-04-02", "1981-04-19", "2000-04-23", "2008-03-23", "2011-04-24", "2024-03-31", "2025-04-20", "2038-04-25"]


def test_holidays(spark):
    got = {r["name"]: r["start"] for r in holidays.holidays(spark, 2024, 2024).collect()}
    day = datetime.date
    assert got["memorial-day-2024"] == day(2024, 5, 27) and got["thanksgiving-2024"] == day(2024, 11, 28) and got["cyber-monday-2024"] == day(2024, 12, 2) and got["easter-monday-2024"] == day(2024, 4, 1)
    with pytest.raises(ValueError, match="before"):
        holidays.holidays(spark, 2025, 2024)


def test_snapshots(spark, tmp_path):
    p = series(spark, range(20))
    assert content_hash(p) == content_hash(p.repartition(7)) != content_hash(p.filter("idx > 0"))
    s = Snapshots(spark, f"file://{tmp_path}/snaps")
    assert s.create(p, "a") == 1 and s.create(p.filter("idx < 5"), "a") == 2
    assert [r["version"] for r in s.list("a").collect()] == [2, 1]
    assert s.restore("a", 1).count() == 20 and s.restore("a", 2).count() == 5
    with pytest.raises(ValueError, match="no version"):
        s.restore("a", 9)


def test_plugins(spark):
    @plugins.model("last_again")
    def last_again(values, horizon):
        return np.repeat(values[-1], horizon)

    @plugins.metric("worst")
    def worst(actual, point):
        return np.abs(actual - point).max()

    got = plugins.forecast_with(series(spark, [1, 2, 5]), "last_again", 2).collect()
    assert [r["point"] for r in got] == [5, 5]
    pairs = spark.createDataFrame([("s", 1, 1.0, 2.0), ("s", 2, 1.0, 4.0)], "series_id string, h int, value double, point double")
    assert plugins.score_with(pairs, "worst").head()["score"] == 3
    with pytest.raises(ValueError, match="already"):
        plugins.model("last_again")(last_again)


def test_alerts(spark):
    values = [1, 9, 9, 9, 9, 9, 9, 1, 9]
    p = series(spark, values).selectExpr("series_id", "timestamp_seconds(idx * 10) as t", "value")
    got = [(r["hits"], r["level"]) for r in alerts.threshold_alerts(p, 5.0).orderBy("t").collect()]
    assert got == [(1, "info"), (3, "warning"), (6, "critical"), (1, "info")]


def test_decomposition(spark):
    v = [100 + 0.5 * k + 8 * math.sin(2 * math.pi * k / 7) for k in range(70)]
    rows = decompose.decomposed(series(spark, v), 7, textbook=True).filter("idx between 10 and 55").collect()
    assert max(abs(r["remainder"]) for r in rows) < 1.5
    assert decompose.decomposed(series(spark, v[:10]), 7).count() == 0


def test_regressions(spark):
    v = [50 + 3 * math.sin(2 * math.pi * k / 12) for k in range(60)]
    got = [r["point"] for r in regress.harmonic_forecast(series(spark, v), 12, 2, 12).orderBy("h").collect()]
    assert got == pytest.approx([50 + 3 * math.sin(2 * math.pi * k / 12) for k in range(60, 72)], abs=1e-3)
    bent = [2 * k + (500 if k in (5, 17) else 0) + (k % 3) * 0.1 for k in range(40)]
    line = regress.robust_line(series(spark, bent)).head()
    assert line["slope"] == pytest.approx(2, abs=0.02)


def test_unit_mismatch(spark):
    kinds = {r["kind"] for r in quality.human_errors(series(spark, [5000 if k == 25 else 101.123 + k for k in range(50)])).collect()}
    assert kinds == {"potential_unit_mismatch"}


def test_incremental_state():
    s = IncrementalState(window=50)
    assert [s.add(k, 10 + math.sin(k / 3)) for k in range(40)].count(True) == 40
    assert [s.add(k, 0.0) for k in range(30, 40)].count(True) == 0
    assert [s.add(k, 10.0) for k in range(40, 60)].count(True) == 20
    assert (s.n, s.dropped, len(s.values)) == (60, 10, 50)
    w = IncrementalState()
    for k, v in enumerate([2, 4, 4, 4, 5, 5, 7, 9]):
        w.add(k, v)
    assert w.mean == 5 and w.sd() == pytest.approx(np.std([2, 4, 4, 4, 5, 5, 7, 9], ddof=1))
    d = IncrementalState()
    for k in range(75):
        d.add(k, 10.0 + 0.1 * (k % 2) if k < 60 else 100.0)
    assert d.drifted(10, 1.5)


def test_multiplicative_season(spark):
    from tidemark.operators import models

    v = [(100 + k) * (1 + 0.3 * math.sin(2 * math.pi * k / 7)) for k in range(84)]
    got = [r["point"] for r in models.holt_winters(series(spark, v), 7, 7, multiplicative=True).orderBy("h").collect()]
    want = [(100 + k) * (1 + 0.3 * math.sin(2 * math.pi * k / 7)) for k in range(84, 91)]
    assert got == pytest.approx(want, rel=0.02)
    assert models.holt_winters(series(spark, [-1.0] * 20), 7, 7, multiplicative=True).count() == 0


def test_box_cox_of_shifted(spark):
    from tidemark.operators import models

    rows = models.box_cox_forecast(series(spark, [k * k - 5.0 for k in range(30)]), 3).orderBy("h").collect()
    assert all(r["lower"] <= r["point"] <= r["upper"] for r in rows)
    assert rows[0]["point"] == pytest.approx(30 * 30 - 5, rel=0.05)


def test_human_errors_of_all_parts(spark, tmp_path):
    from tidemark.plans import registry

    rows = [(p, f"1995-01-{k + 1:02d}", 500.0 if k == 3 else 11.0 + k / 7) for p in (7, 31, 5000) for k in range(8)]
    line = spark.createDataFrame(rows, "l_partkey bigint, l_shipdate string, l_quantity double").selectExpr("l_partkey", "cast(l_shipdate as date) l_shipdate", "l_quantity")
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["human_errors"](spark, str(tmp_path)).filter("kind = 'potential_unit_mismatch'")
    assert sorted(r["series_id"] for r in got.collect()) == ["31", "5000", "7"]


def test_holes_of_all_events(spark, tmp_path):
    """Hours 0 to 9 without 4 and 5; every third event_id counts as well."""
    from tidemark.plans import registry

    rows = [(k, "a", datetime.datetime(2024, 1, 1, h, 30), float(h)) for k, h in enumerate([0, 1, 2, 3, 6, 7, 8, 9])]
    spark.createDataFrame(rows, "event_id bigint, event_type string, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    assert [(r["first"], r["last"], r["duration"]) for r in run("missing_runs")] == [(4, 5, 2)]
    assert [(r["missing"], r["coverage"]) for r in run("coverage")] == [(2, 80.0)]
    assert sorted((r["idx"], r["value"]) for r in run("impute_linear")) == [(h, 4.5 if h in (4, 5) else float(h)) for h in range(10)]
    assert {r["idx"]: r["value"] for r in run("impute_seasonal") if r["idx"] not in (4, 5)} == {h: float(h) for h in (0, 1, 2, 3, 6, 7, 8, 9)}
