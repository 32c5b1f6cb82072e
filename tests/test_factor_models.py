"""External and common factors against numpy and planted effects."""

from datetime import date, timedelta

import numpy as np
import pytest

from tidemark.operators import factor_models as fm

DAY = date(2024, 1, 1)


def points(spark, series, **more):
    rows = [(k, i, DAY + timedelta(days=i), None if np.isnan(v) else float(v), *(float(c[i]) if not np.isnan(c[i]) else None for c in more.values())) for k, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "series_id string, idx int, t date, value double" + "".join(f", {c} double" for c in more)).repartition(3)


def kernel(kind, n, start, duration):
    at, tau, mid = np.arange(n) - start, max(duration / 3, 0.5), duration / 2
    inside = (at >= 0) & (at < duration)
    return {"box": inside * 1.0, "exponential": np.where(at >= 0, np.exp(-np.maximum(at, 0) / tau), 0), "gaussian": np.exp(-0.5 * ((at - mid) / max(duration / 4, 0.5)) ** 2)}[kind]


def events(spark, rows):
    return spark.createDataFrame([(n, DAY + timedelta(days=s), d, k) for n, s, d, k in rows], "name string, start date, duration int, decay string")


def test_planted_effects(spark):
    rng = np.random.default_rng(4)
    n = 200
    t = np.arange(n)
    warm = rng.normal(20, 5, n)
    asked = [("promo", 31, 14, "box"), ("promo", 120, 10, "box"), ("storm", 70, 9, "exponential"), ("fair", 150, 8, "gaussian"), ("past", -5, 3, "box"), ("later", 900, 3, "box"), ("twin", 31, 14, "box"), ("twin", 120, 10, "odd")]
    promo = kernel("box", n, 31, 14) + kernel("box", n, 120, 10)
    storm, fair = kernel("exponential", n, 70, 9), kernel("gaussian", n, 150, 8)
    clean = 50 + 0.2 * t + 4 * np.sin(2 * np.pi * t / 7) + 34 * promo - 12 * storm + 8 * fair + 1.5 * warm
    y = clean + rng.normal(0, 1, n)
    y[5] = np.nan
    p = points(spark, {"a": y, "short": y[:6]}, warm=warm)
    design = fm.Design(p, events(spark, asked), season=7, harmonics=2, covariates=("warm",))
    fit = fm.factor_fit(design)
    got = {r["factor"]: r for r in fit.collect() if r["series_id"] == "a"}
    assert set(got) == set(design.names) and fit.filter("series_id = 'short'").count() == 0
    x = np.column_stack([np.ones(n), t, *(f(2 * np.pi * k * t / 7) for k in (1, 2) for f in (np.sin, np.cos)), warm, fair, promo, storm])
    ok = ~np.isnan(y)
    beta, *_ = np.linalg.lstsq(x[ok], y[ok], rcond=None)
    resid = y[ok] - x[ok] @ beta
    df = ok.sum() - x.shape[1]
    se = np.sqrt(resid @ resid / df * np.diag(np.linalg.inv(x[ok].T @ x[ok])))
    names = ["(intercept)", "(trend)", "(sin 1)", "(cos 1)", "(sin 2)", "(cos 2)", "warm", "fair", "promo", "storm"]
    for j, name in enumerate(names):
        r = got[name]
        assert (r["status"], r["df"]) == ("kept", df)
        assert (r["coefficient"], r["std_error"], r["t"]) == pytest.approx((beta[j], se[j], beta[j] / se[j]), rel=1e-6)
        assert r["impact"] == pytest.approx(abs(beta[j]) * x[ok][:, j].std(ddof=1), rel=1e-6, abs=1e-6)
    assert abs(got["promo"]["coefficient"] - 34) < 1 and abs(got["storm"]["coefficient"] + 12) < 2 and got["promo"]["p"] < 1e-6
    assert got["past"]["status"] == got["later"]["status"] == "constant" and (got["twin"]["status"], got["twin"]["depends"]) == ("collinear", "promo")
    ranks = [r["factor"] for r in fm.ranked_factors(fit).orderBy("rank").collect()]
    assert ranks[:2] == ["promo", "warm"] and set(ranks[-3:]) == {"past", "later", "twin"}
    fitted = {r["idx"]: r["fitted"] for r in fm.factor_predict(design, fit, 5).filter("series_id = 'a'").collect()}
    assert len(fitted) == n + 5 and np.allclose([fitted[i] for i in np.flatnonzero(ok)], x[ok] @ beta)
    base = spark.createDataFrame([("a", h, 100.0) for h in range(5)] + [("b", 0, 1.0)], "series_id string, h int, point double")
    moved = {(r["series_id"], r["h"]): r["adjusted"] for r in fm.apply_factor(base, fit, "promo", 2, 2).collect()}
    assert [moved["a", h] for h in range(5)] == pytest.approx([100, 100, 100 + beta[8], 100 + beta[8], 100]) and moved["b", 0] == 1.0


def test_places_between_points(spark):
    """Events fall on the next point at or after their start, also over gaps."""
    rows = [("a", 0, DAY, 1.0), ("a", 1, DAY + timedelta(days=3), 1.0), ("a", 2, DAY + timedelta(days=10), 1.0)]
    p = spark.createDataFrame(rows, "series_id string, idx int, t date, value double")
    got = {r["name"]: r["start"] for r in fm.event_places(p, events(spark, [(str(k), k, 1, "box") for k in range(-1, 12)])).collect()}
    assert got == {"-1": None, "0": 0, "1": 1, "2": 1, "3": 1, **{str(k): 2 for k in range(4, 11)}, "11": None}
    with pytest.raises(ValueError, match="more than"):
        fm.Design(p, events(spark, [(f"e{k}", k, 1, "box") for k in range(60)]))


@pytest.mark.parametrize("many", [6, 40])
def test_common_factors_equal_eigenvectors(spark, many):
    rng = np.random.default_rng(many)
    n, k = 120, 3
    hidden = rng.normal(0, 1, (n, k)) * [3, 2, 1.2]
    x = hidden @ rng.normal(0, 1, (k, many)) + 0.3 * rng.normal(0, 1, (n, many))
    series = {f"s{j:02}": x[:, j] * 10 + j for j in range(many)} | {"flat": np.full(n, 4.0)}
    loadings, scores = fm.common_factors(points(spark, series), k, rounds=12)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    values, vectors = np.linalg.eigh(z.T @ z / (n - 1))
    got = {(r["factor"], r["series_id"]): r for r in loadings.collect()}
    steps = {(r["factor"], r["idx"]): r["score"] for r in scores.collect()}
    assert len(got) == k * many and len(steps) == k * n
    for f in range(k):
        v = vectors[:, -1 - f]
        v = v * np.sign(v[np.argmax(np.abs(v))])
        assert [got[f + 1, f"s{j:02}"]["loading"] for j in range(many)] == pytest.approx(list(v), abs=1e-5)
        assert got[f + 1, "s00"]["share"] == pytest.approx(values[-1 - f] / many)
        assert [steps[f + 1, i] for i in range(n)] == pytest.approx(list(z @ v), abs=1e-4)
    # the planted factors span what was found
    q, _ = np.linalg.qr(np.column_stack([[steps[f + 1, i] for i in range(n)] for f in range(k)]))
    assert np.linalg.norm(q.T @ np.linalg.qr(hidden - hidden.mean(0))[0]) ** 2 > 0.97 * k
    empty = points(spark, {"a": [1.0]}).filter("false")
    assert [d.count() for d in fm.common_factors(empty, 2)] == [0, 0]
