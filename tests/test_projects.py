"""Project files, settings and loading."""

import json

import pytest

from tidemark.sources import projects

CSV = "when,sold\n2024-01-01 00:00:00,1\n2024-01-01 01:00:00,2.5\n2024-01-01 02:00:00,\n2024-01-01 03:00:00,4\n2024-01-01 04:00:00,8\n2024-01-01 04:00:00,9\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sold.csv").write_text(CSV)
    return tmp_path


def test_round_trip_and_defaults(spark, folder):
    path = f"{folder}/shop.forecast.json"
    made = projects.default_project("Läden", "sold.csv")
    projects.write_project(spark, path, made)
    projects.write_project(spark, path, made | {"horizon": 12})
    for at in (path, f"file://{path}", str(folder), f"{folder}/"):
        project, where = projects.read_project(spark, at)
        assert project == made | {"horizon": 12} and where.rstrip("/").endswith(str(folder))
    assert json.loads((folder / "shop.forecast.json").read_text())["name"] == "Läden"


def test_loading(spark, folder):
    path = f"{folder}/shop.forecast.json"
    projects.write_project(spark, path, {"data": "sold.csv", "timeColumn": "when", "valueColumn": "sold", "seasonLength": 24, "unit": "pieces"})
    got = projects.load(spark, path, horizon=3, interval="95")
    assert {k: got.config[k] for k in ("name", "unit", "seasonLength", "horizon", "interval", "agg", "method")} == {"name": "sold.csv", "unit": "pieces", "seasonLength": 24, "horizon": 3, "interval": 95, "agg": "mean", "method": "auto"}
    assert [(r["idx"], r["value"]) for r in got.points.orderBy("idx").collect()] == [(0, 1.0), (1, 2.5), (2, 4.0), (3, 8.0), (4, 9.0)]
    assert [r["reason"] for r in got.skipped.collect()] == ["empty value"] and got.step_ms is None
    assert [(r["check"], r["size"]) for r in got.findings().filter("check = 'duplicate'").collect()] == [("duplicate", 1)]


@pytest.mark.parametrize(("agg", "want"), [("mean", [1.75, 4.0, 8.5]), ("sum", [3.5, 4.0, 17.0]), ("last", [2.5, 4.0, 9.0]), ("max", [2.5, 4.0, 9.0])])
def test_resampling(spark, folder, agg, want):
    got = projects.load(spark, data=f"{folder}/sold.csv", timeColumn="when", valueColumn="sold", resample=True, agg=agg, step=7_200_000)
    rows = got.points.orderBy("idx").collect()
    assert [r["value"] for r in rows] == want and [r["t"].hour for r in rows] == [0, 2, 4] and got.step_ms == 7_200_000


def test_most_common_step(spark, folder):
    got = projects.load(spark, data=f"{folder}/sold.csv", timeColumn="when", valueColumn="sold", resample=True)
    assert got.step_ms == 3_600_000 and [r["value"] for r in got.points.orderBy("idx").collect()] == [1.0, 2.5, 4.0, 8.5]


def test_one_point_has_no_step(spark, tmp_path):
    (tmp_path / "one.csv").write_text("date,value\n2024-01-01,5\n")
    got = projects.load(spark, data=f"{tmp_path}/one.csv", resample=True)
    assert got.step_ms is None and [r["value"] for r in got.points.collect()] == [5.0]


def test_digest_is_of_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,value\n1,2\n3,4\n3,4\n")
    for name, rows in (("b", ["date,value", "3,4", "1,2", "3,4"]), ("c", ["date,value", "1,2", "3,4"])):
        spark.createDataFrame([(r,) for r in rows], "value string").repartition(3).write.text(f"{tmp_path}/{name}")
    a, b, c = (projects.text_digest(spark, f"{tmp_path}/{x}") for x in ("a.csv", "b", "c"))
    assert a == b != c


def test_faulty_projects(spark, folder):
    with pytest.raises(ValueError, match="holds no project"):
        projects.read_project(spark, str(folder))
    for text, told in (("{", "is no JSON"), ("[]", "names no data"), ('{"name": "x"}', "names no data"), ('{"data": "a.csv", "requiresVersion": "^9.0"}', "requires version")):
        (folder / "x.json").write_text(text)
        with pytest.raises(ValueError, match=told):
            projects.read_project(spark, f"{folder}/x.json")
    for name in "ab":
        (folder / f"{name}.forecast.json").write_text('{"data": "sold.csv"}')
    with pytest.raises(ValueError, match="more than one"):
        projects.read_project(spark, str(folder))
    with pytest.raises(ValueError, match="no data"):
        projects.load(spark)


def test_settings():
    got = projects.settings({"data": "a", "damped": True, "horizon": 5, "interval": None, "extra": 1}, {"damped": False, "horizon": "7", "methods": "naive, holt,,"})
    assert (got["damped"], got["horizon"], got["interval"], got["methods"]) == (True, 7, 80, ["naive", "holt"]) and "extra" not in got
    assert projects.settings({"horizon": ""}, {})["horizon"] == 24 and projects.settings({"horizon": 3.0}, {})["horizon"] == 3
    for bad in ({"horizon": 0}, {"horizon": -1}, {"horizon": 2.5}, {"horizon": True}, {"interval": 85}, {"agg": "median"}, {"seasonality": "none"}, {"step": 0}, {"colour": 1}):
        with pytest.raises(ValueError):
            projects.settings({}, bad)


def test_versions():
    assert [projects.compare_versions(a, b) for a, b in (("1.2", "1.2.0"), ("1.10", "1.9"), ("0.9.9", "1"))] == [0, 1, -1]
    cases = {(None, True), ("*", True), ("0.3.0", True), ("0.3", False), ("^0.2", True), ("^0.4", False), ("^1.0", False), ("^7", True)}
    assert all(projects.satisfies("0.3.0", wanted) is good for wanted, good in cases)
    with pytest.raises(ValueError, match="not a version"):
        projects.compare_versions("1.x", "1")
