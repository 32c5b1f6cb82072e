"""Vector autoregression against least squares on whole rows."""

import numpy as np
import pytest

from tidemark.operators import multi

SCHEMA = "series_id string, idx bigint, value double"


def plain(y, order, horizon):
    """Rows whose value or lags are unknown teach nothing; forecasts go on from the last whole lags."""
    n, k = y.shape
    padded = np.vstack([y, np.full((order, k), np.nan)])
    rows = [(t, np.concatenate([[1.0], *(padded[t - lag] for lag in range(1, order + 1))]), padded[t]) for t in range(order, n + order) if t - order < n]
    rows = [r for r in rows if not np.isnan(r[1]).any()]
    taught = [r for r in rows if not np.isnan(r[2]).any()]
    x, z = np.array([r[1] for r in taught]), np.array([r[2] for r in taught])
    g = x.T @ x
    beta = np.linalg.solve(g + 1e-8 * np.trace(g) / len(g) * np.eye(len(g)), x.T @ z)
    state, out = rows[-1][1][1:], []
    for _ in range(horizon):
        now = np.concatenate([[1.0], state]) @ beta
        out.append(now)
        state = np.concatenate([now, state])[: k * order]
    return np.array(out)


@pytest.mark.parametrize(("order", "holes"), [(1, ()), (2, ()), (2, (17, 40)), (1, (79,))])
def test_equals_least_squares(spark, order, holes):
    rng = np.random.default_rng(2)
    y = np.zeros((80, 2))
    for t in range(1, 80):
        y[t] = [0.6 * y[t - 1, 0] + 0.3 * y[t - 1, 1] + 1, 0.5 * y[t - 1, 1] - 0.2 * y[t - 1, 0] + 2] + rng.normal(size=2)
    for t in holes:
        y[t, 1] = np.nan
    rows = [(n, t, None if np.isnan(v) else float(v)) for t in range(80) for n, v in zip("ab", y[t], strict=True)]
    points = spark.createDataFrame([*rows, ("other", 3, 1.0)], SCHEMA)
    got = {(r["series_id"], r["h"]): r["point"] for r in multi.var_forecast(points, ["a", "b"], order, 4).collect()}
    want = plain(y, order, 4)
    assert len(got) == 8
    for h in range(4):
        for i, n in enumerate("ab"):
            assert got[n, h + 1] == pytest.approx(want[h, i], rel=1e-8)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    single = spark.createDataFrame([("a", 0, 1.0), ("b", 5, 1.0)], SCHEMA)
    assert multi.var_forecast(empty, ["a"], 1, 3).count() == 0
    assert multi.var_forecast(single, ["a", "b"], 1, 3).count() == 0
    assert multi.var_forecast(single, [], 1, 3).count() == 0


def test_no_sort_or_window_over_all(spark, capsys):
    points = spark.createDataFrame([("a", t, float(t % 5)) for t in range(20)], SCHEMA)
    multi._wide(points, ["a"]).explain()
    assert "Window" not in (plan := capsys.readouterr().out) and "Exchange rangepartitioning" not in plan
