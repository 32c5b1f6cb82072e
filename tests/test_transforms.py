"""Forecasts on other scales, harmonic regressions and reports of folds against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate, models, transforms

SCHEMA = "series_id string, idx bigint, value double"


def frame(spark, series):
    return spark.createDataFrame([(name, k, None if v is None else float(v)) for name, y in series.items() for k, v in enumerate(y)], SCHEMA)


def planted():
    rng = np.random.default_rng(3)
    t = np.arange(84)
    calm = 500 + 20 * np.sin(2 * np.pi * t / 7) + rng.normal(size=84)
    growing = np.exp(0.03 * t) * (2 + np.sin(2 * np.pi * t / 7)) * np.exp(rng.normal(size=84) / 5)
    return {"calm": calm, "growing": growing, "zeros": np.where(t % 11 == 0, 0.0, growing), "short": growing[:10], "equal": np.full(84, 5.0), "holes": [None if k % 9 == 4 else v for k, v in enumerate(growing)]}


def likely(y, textbook=True):
    """The lambda of the largest likelihood, by a plain loop."""
    best, top = None, -np.inf
    for k in range(-20, 21):
        lam = k / 10
        x = np.log(y) if k == 0 else (y**lam - 1) / lam
        score = round(-len(y) / 2 * np.log(np.var(x)) + (lam - 1 if textbook else 1) * np.log(y).sum(), 6)
        if score > top:
            best, top = lam, score
    return best


@pytest.mark.parametrize("textbook", [True, False])
def test_kinds_and_scales(spark, textbook):
    series = planted()
    got = {r["series_id"]: r for r in transforms.auto_transform(frame(spark, series), 7, textbook=textbook).collect()}
    assert {k: r["kind"] for k, r in got.items()} == {"calm": "additive", "growing": "multiplicative", "zeros": "multiplicative", "short": "additive", "equal": "additive", "holes": "multiplicative"}
    assert {k for k, r in got.items() if r["transform"]} == {"growing", "zeros", "holes"}
    assert got["growing"]["lambda"] == pytest.approx(likely(series["growing"], textbook)) and got["growing"]["shift"] == 0
    assert got["zeros"]["lambda"] == pytest.approx(likely(series["zeros"] + 1, textbook)) and got["zeros"]["shift"] == 1
    assert got["holes"]["lambda"] == pytest.approx(likely(np.array([v for v in series["holes"] if v is not None]), textbook))
    assert got["calm"]["lambda"] is None and got["calm"]["shift"] == 0


def test_kind_may_be_said(spark):
    points = frame(spark, planted())
    assert {r["transform"] for r in transforms.auto_transform(points, 7, "additive").collect()} == {False}
    assert {r["series_id"]: r["transform"] for r in transforms.auto_transform(points, None, "multiplicative").collect()}["equal"] is False
    assert {r["kind"] for r in transforms.auto_transform(points, 1).collect()} == {"additive"}
    with pytest.raises(ValueError, match="kind is one of"):
        transforms.auto_transform(points, 7, "none")


def test_forecasts_come_back(spark):
    series = {k: v for k, v in planted().items() if k != "holes"}
    fit = lambda p: models.forecast(p, 5, methods=("drift",))
    scales = {r["series_id"]: r for r in transforms.auto_transform(frame(spark, series), 7).collect()}
    points = frame(spark, series).withColumn("lambda", F.lit("clash")).withColumn("shift", F.lit("clash"))
    got = {(r["series_id"], r["h"]): r for r in transforms.auto_forecast(points, 7, fit).collect()}
    assert len(got) == 5 * len(series)
    for name, y in series.items():
        lam, shift = scales[name]["lambda"], scales[name]["shift"]
        x = np.asarray(y, float) if lam is None else np.log(y + shift) if lam == 0 else ((y + shift) ** lam - 1) / lam
        slope = (x[-1] - x[0]) / (len(x) - 1)
        sigma = np.sqrt(((x - x[0] - slope * np.arange(len(x))) ** 2).sum() / (len(x) - 1))
        back = lambda v: v if lam is None else (np.exp(v) if lam == 0 else max(lam * v + 1, 0) ** (1 / lam)) - shift  # noqa: B023, E731
        for h in range(1, 6):
            at, half = x[-1] + h * slope, 1.2816 * sigma * np.sqrt(h)
            for c, v in (("point", at), ("lower", at - half), ("upper", at + half)):
                assert got[name, h][c] == pytest.approx(back(v), rel=1e-9, abs=1e-9), (name, h, c)


def test_beyond_the_range_of_a_transform(spark):
    points = frame(spark, {"a": [1.0, 2.0, 3.0], "unscaled": [1.0, 2.0], "below": [-1.0, 4.0]})
    scales = spark.createDataFrame([("a", -1.0, 0.5), ("below", 0.5, 0.0)], "series_id string, lambda double, shift double")
    seen = {}

    def fit(p):
        seen.update({(r["series_id"], r["idx"]): r["value"] for r in p.collect()})
        return p.groupBy("series_id").agg(F.lit(4.0).alias("point"), F.lit(None).cast("double").alias("lower"), F.lit("kept").alias("more"))

    got = {r["series_id"]: r for r in transforms.transformed_forecast(points, scales, fit).collect()}
    assert seen["a", 0] == pytest.approx((1.5**-1 - 1) / -1) and seen["below", 0] is None and seen["unscaled", 1] == 2.0
    assert (got["a"]["point"], got["a"]["lower"], got["a"]["more"]) == (-0.5, None, "kept")
    assert got["below"]["point"] == 9.0 and got["unscaled"]["point"] == 4.0


def test_harmonics_equal_least_squares(spark):
    rng = np.random.default_rng(8)
    t = np.arange(120)
    y = 1e7 + 300 * np.sin(2 * np.pi * t / 7) - 90 * np.cos(4 * np.pi * t / 30) + rng.normal(size=120)
    series = {"whole": y, "holes": [None if k % 10 == 3 else v for k, v in enumerate(y)], "few": y[:9], "tight": y[:12]}
    got = {(r["series_id"], r["h"]): r for r in transforms.harmonic_regression(frame(spark, series), (7, 30), 2, 6).collect()}
    assert {k for k, _ in got} == {"whole", "holes", "tight"}
    design = lambda at: np.column_stack([np.ones(len(at)), *(f(2 * np.pi * k * at / s) for s in (7, 30) for k in (1, 2) for f in (np.sin, np.cos))])
    for name in ("whole", "holes"):
        at = np.array([k for k, v in enumerate(series[name]) if v is not None])
        v = np.array([series[name][k] for k in at], float)
        x = design(at)
        g = x.T @ x
        beta = np.linalg.solve(g + np.diag(1e-8 * np.diag(g)), x.T @ v)
        variance = ((v - x @ beta) ** 2).sum() / (len(v) - 9)
        for h in range(1, 7):
            point = (design(np.array([119 + h])) @ beta)[0]
            assert got[name, h]["point"] == pytest.approx(point, rel=1e-11)
            assert got[name, h]["upper"] - got[name, h]["point"] == pytest.approx(1.2816 * np.sqrt(variance * (1 + h / len(v))), rel=1e-6)


def test_seasons_that_make_each_other(spark):
    t = np.arange(70)
    y = 5 + np.sin(2 * np.pi * t / 7)
    got = transforms.harmonic_regression(frame(spark, {"a": y, "equal": np.full(70, 3.0)}), (7, 14), 2, 7).collect()
    for r in got:
        want = 3.0 if r["series_id"] == "equal" else 5 + np.sin(2 * np.pi * (69 + r["h"]) / 7)
        assert r["point"] == pytest.approx(want, abs=1e-5)


def test_report_of_folds(spark):
    rng = np.random.default_rng(4)
    series = {"a": np.cumsum(rng.normal(size=25)) + 50, "flat": [3.0] * 10 + list(rng.normal(size=15)), "zero": [1.0, 2.0, 4.0, 3.0, 5.0] + [0.0] * 20}
    got = {(r["series_id"], r["method"]): r for r in evaluate.fold_report(frame(spark, series), 4, 5, ("naive", "mean")).collect()}
    for name, y in series.items():
        y, per = np.array(y), {"naive": [], "mean": []}
        for cut in range(5, 25, 5):
            train, test = y[:cut], y[cut : cut + 5]
            scale = np.abs(np.diff(train)).mean()
            for method, point, sigma in (("naive", train[-1], np.sqrt((np.diff(train) ** 2).sum() / (cut - 1))), ("mean", train.mean(), train.std(ddof=1))):
                e = np.abs(test - point)
                half = 1.2816 * sigma * np.sqrt(np.arange(1, 6))
                known = test != 0
                per[method].append((np.sqrt((e**2).mean()), e.mean(), 100 * (e[known] / np.abs(test[known])).mean() if known.any() else np.nan, e.mean() / scale if scale > 0 else np.nan, 100 * (np.abs(test - point) <= half).mean()))
        for method, rows in per.items():
            m, r = np.array(rows), got[name, method]
            want = {"rmse": m[:, 0].mean(), "rmse_sd": m[:, 0].std(ddof=1), "mae": m[:, 1].mean(), "mae_sd": m[:, 1].std(ddof=1), "coverage": m[:, 4].mean()}
            for c, k in (("mape", 2), ("mase", 3)):
                want[c] = np.nanmean(m[:, k]) if not np.isnan(m[:, k]).all() else None
            for c, v in want.items():
                assert r[c] == pytest.approx(v), (name, method, c)
            assert (r["folds"], r["promised"]) == (4, 80.0)
        ranked = sorted(("naive", "mean"), key=lambda k: (round(np.mean([x[0] for x in per[k]]), 6), k != "naive"))  # noqa: B023
        assert [got[name, k]["rank"] for k in ranked] == [1, 2]


def test_a_single_fold_has_no_spread(spark):
    rows = evaluate.fold_report(frame(spark, {"a": np.arange(10.0)}), 1, 5).collect()
    assert {(r["folds"], r["rmse_sd"], r["mae_sd"]) for r in rows} == {(1, 0.0, 0.0)}
