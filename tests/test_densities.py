"""Densities against integrals and round trips; tables compared by their trees."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import densities as d
from tidemark.functions.significance import incomplete_beta
from tidemark.sources import merkle


def test_incomplete_beta_of_arrays():
    a, b, x = np.array([2.0, 3.0, 10.0, 0.5, 1.0, 2.0]), np.array([3.0, 2.0, 2.0, 0.5, 1.0, 2.0]), np.array([0.3, 0.9, 0.8, 0.25, 0.4, np.nan])
    want = [sum(math.comb(4, j) * 0.3**j * 0.7 ** (4 - j) for j in range(2, 5)), sum(math.comb(4, j) * 0.9**j * 0.1 ** (4 - j) for j in range(3, 5)), 11 * 0.8**10 * 0.2 + 0.8**11, 2 / math.pi * math.asin(0.5), 0.4]
    got = incomplete_beta(a, b, x)
    assert got[:5] == pytest.approx(want, rel=1e-13) and np.isnan(got[5])
    assert list(incomplete_beta(2.0, 2.0, np.array([-1.0, 0.0, 1.0, 2.0]))) == [0, 0, 1, 1]


def test_known_quantiles():
    # published tables of Student's t
    for p, df, x in ((0.975, 10, 2.228139), (0.95, 5, 2.015048), (0.995, 30, 2.749996), (0.9, 1, 3.077684), (0.975, 2, 4.302653)):
        assert d.t_quantile(np.array(p), np.array(float(df))) == pytest.approx(x, abs=1e-6)


@pytest.mark.parametrize("df", [1.0, 2.5, 4.0, 10.0, 200.0, 1e7])
def test_quantile_undoes_probability(df):
    x = np.r_[-np.geomspace(30, 1e-6, 60), 0, np.geomspace(1e-6, 30, 60)]
    for skew in (0.0, 0.4, -0.9):
        p = d.skewed("cdf", x, np.full_like(x, df), np.full_like(x, skew))
        ok = (p > 1e-12) & (p < 1 - 1e-7)
        back = d.skewed("quantile", p, np.full_like(x, df), np.full_like(x, skew))
        assert np.all(np.diff(p) >= 0) and back[ok] == pytest.approx(x[ok], abs=1e-8, rel=1e-8)
        # the density is the slope of the probability, and sums to one
        grid = np.linspace(-40, 40, 160_001)
        f = d.skewed("pdf", grid, np.full_like(grid, df), np.full_like(grid, skew))
        c = d.skewed("cdf", grid[[0, -1]], np.full(2, df), np.full(2, skew))
        assert ((f[1:] + f[:-1]) / 2).sum() * (grid[1] - grid[0]) == pytest.approx(c[1] - c[0], abs=1e-6)


def test_fitted_densities(spark):
    rng = np.random.default_rng(2)
    t = rng.standard_t(7, 60_000)
    p = rng.uniform(1e-6, 1 - 1e-6, 60_000)
    bent = 3 * d.skewed("quantile", p, np.full_like(p, 9.0), np.full_like(p, 0.3))
    held = {"t": 2 * t, "bent": bent, "normal": rng.normal(0, 5, 60_000), "few": [1.0, 2.0], "flat": [0.0] * 9}
    rows = spark.createDataFrame([(k, float(v)) for k, y in held.items() for v in y], "series_id string, value double")
    got = {r["series_id"]: r for r in d.fit_densities(rows).collect()}
    assert set(got) == {"t", "bent", "normal"}
    assert 5 < got["t"]["df"] < 10 and got["t"]["sigma"] == pytest.approx(2, rel=0.08) and abs(got["t"]["skew"]) < 0.03
    assert got["bent"]["skew"] == pytest.approx(0.3, abs=0.05) and got["bent"]["sigma"] == pytest.approx(3, rel=0.15)
    assert got["normal"]["df"] > 60 and got["normal"]["sigma"] == pytest.approx(5, rel=0.05)
    base = spark.createDataFrame([(k, h, 10.0) for k in got for h in (1, 4)], "series_id string, h int, point double")
    bands = {(r["series_id"], r["h"]): r for r in d.density_bands(base, d.fit_densities(rows), 0.8).collect()}
    for k, y in held.items():
        if k in got:
            lower, upper = np.quantile(y, [0.1, 0.9])
            assert (bands[k, 1]["lower"] - 10, bands[k, 1]["upper"] - 10) == pytest.approx((lower, upper), rel=0.06)
            assert bands[k, 4]["upper"] - 10 == pytest.approx(2 * (bands[k, 1]["upper"] - 10))
    cols = [F.lit(x) for x in (12.0, 10.0, 2.0, 5.0)]
    one = spark.range(1).select(d.density(*cols).alias("f"), d.probability(*cols).alias("p"), d.quantile(F.lit(None), *cols[1:]).alias("none")).head()
    assert one["f"] == pytest.approx(d.t_density(np.array(1.0), np.array(5.0)) / 2) and one["p"] == pytest.approx(0.8183913) and one["none"] is None or math.isnan(one["none"])


def test_one_changed_row_is_located(spark, tmp_path):
    schema = "series_id string, idx int, value double"
    rows = [(f"s{k % 7}", k, float(k)) for k in range(4000)] + [("null", None, None)] * 2
    a = spark.createDataFrame(rows, schema)
    changed = [(s, k, v + 1e-12 if k == 1234 else v) for s, k, v in rows if k != 77] + [("s0", 9999, 0.0)]
    b = spark.createDataFrame(changed, schema).repartition(7)
    x, y, z = (f"file://{tmp_path}/{n}" for n in "xyz")
    first, second, third = (merkle.write_hashed(df, p, ("series_id", "idx"), 2) for df, p in ((a, x), (b, y), (a.repartition(3), z)))
    assert first == third != second
    assert merkle.differing(spark, x, z, 2) == [] and 1 <= len(merkle.differing(spark, x, y, 2)) <= 3
    got = {(r["idx"], r["change"]) for r in merkle.located_changes(spark, x, y, schema, ("series_id", "idx"), 2).collect()}
    assert got == {(1234, "changed"), (77, "removed"), (9999, "added")}
    assert merkle.located_changes(spark, x, z, schema, ("series_id", "idx"), 2).count() == 0
    read = [len(f.inputFiles()) for f in (spark.read.parquet(f"{x}/rows"),)]
    assert read[0] > 100
    empty = merkle.write_hashed(a.limit(0), f"file://{tmp_path}/e", ("series_id", "idx"), 2)
    assert empty is None and len(merkle.differing(spark, x, f"file://{tmp_path}/e", 2)) > 100


def test_reproduced(spark):
    schema = "series_id string, h int, point double, upper double"
    report = spark.createDataFrame([("a", 1, 1.0, None), ("a", 2, 5e6, 6e6), ("b", 1, 2.0, 3.0), ("c", 1, 2.0, 3.0)], schema)
    again = spark.createDataFrame([("a", 1, 1.0 + 1e-12, None), ("a", 2, 5e6, 6e6 + 1e-6), ("b", 1, 2.0, 3.0 + 1e-9), ("d", 1, 0.0, 0.0)], schema)
    got = {(r["series_id"], r["h"]): r["status"] for r in merkle.reproduced(report, again, ("series_id", "h"), ("point", "upper")).collect()}
    assert got == {("a", 1): "same", ("a", 2): "same", ("b", 1): "changed", ("c", 1): "missing", ("d", 1): "new"}
