"""Table functions and sources that go on where they stopped."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, table_functions
from tidemark.sources import cursors


def series(spark, held):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(hours=i), i, None if v is None else float(v)) for k, y in held.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "series_id string, t timestamp, idx int, value double").repartition(3)


def test_table_function_equals_forecast(spark):
    rng = np.random.default_rng(3)
    held = {"walk": 1e6 + np.cumsum(rng.normal(0, 1, 90)), "season": 20 + 5 * np.sin(np.arange(60) * 2 * np.pi / 7) + 0.1 * np.arange(60), "short": [3, 4], "one": [5], "flat": [2.0] * 12, "none": [None, None]}
    points = series(spark, held)
    table_functions.register(spark)
    points.createOrReplaceTempView("udtf_points")
    got = spark.sql("SELECT * FROM forecast(TABLE(udtf_points) PARTITION BY series_id ORDER BY (t), 9, 'naive,mean,drift,linear,snaive,holt,holt_damped', 90, 7)")
    want = models.forecast(points.filter("value is not null"), 9, 90, 7)
    key = lambda r: (r["series_id"], r["method"], r["h"])
    a, b = ({key(r): (r["point"], r["lower"], r["upper"]) for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and len(a) > 100
    for k, v in b.items():
        assert a[k] == pytest.approx(v, rel=1e-6, abs=1e-6), k
    again = table_functions.forecast_function()(points.asTable().partitionBy("series_id").orderBy("t"), F.lit(2), F.lit("naive"))
    assert {(r["series_id"], r["h"]) for r in again.collect()} == {(k, h) for k in held if k not in ("one", "none") for h in (1, 2)}


def test_table_function_refuses(spark):
    table_functions.register(spark)
    series(spark, {"a": [1, 2, 3], "b": [4, 5]}).coalesce(1).createOrReplaceTempView("udtf_points")
    for call, told in (
        ("forecast(TABLE(udtf_points), 3)", "PARTITION BY"),
        ("forecast(TABLE(udtf_points) PARTITION BY series_id ORDER BY (t DESC), 3)", "ORDER BY"),
        ("forecast(TABLE(udtf_points) PARTITION BY series_id ORDER BY (t), 3, 'guess')", "no method guess"),
        ("forecast(TABLE(udtf_points) PARTITION BY series_id ORDER BY (t), 0)", "horizon"),
        ("forecast(TABLE(SELECT 1 AS x) PARTITION BY (x), 3)", "no column series_id"),
    ):
        with pytest.raises(Exception, match=told):
            spark.sql(f"SELECT * FROM {call}").collect()


def run(stream, out, marks):
    """Runs what there is; returns its progress."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    return cursors.feed_status(query)


def test_lines_are_read_once(spark, tmp_path):
    cursors.register(spark)
    folder, out, marks = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/marks"
    folder.mkdir()
    stream = lambda: spark.readStream.format("line_tail").option("path", str(folder)).option("split_bytes", 37).load()
    lines = lambda: sorted((r["file"].rsplit("/", 1)[1], r["line"]) for r in spark.read.parquet(out).collect())
    a, b = folder / "a.csv", folder / "b.csv"
    text = [f"row {k} é" * (k % 5) for k in range(60)]
    a.write_text("\n".join(text) + "\nunfinished")
    status = run(stream(), out, marks)
    assert lines() == sorted(("a.csv", x) for x in text) and status["points"] == 60 and not status["error"]
    with a.open("a") as f:
        f.write(" line\r\nmore\n")
    b.write_text("only\n")
    run(stream(), out, marks)
    want = [("a.csv", x) for x in [*text, "unfinished line", "more"]] + [("b.csv", "only")]
    assert lines() == sorted(want)
    run(stream(), out, marks)
    assert lines() == sorted(want)
    a.write_text("new\n")  # shorter
    b.write_text("other, and longer\n")  # longer, but not what it was
    run(stream(), out, marks)
    assert lines() == sorted([*want, ("a.csv", "new"), ("b.csv", "other, and longer")])
    batch = spark.read.format("line_tail").option("path", str(folder)).option("split_bytes", 3).load()
    assert {(r["at"], r["line"]) for r in batch.collect()} == {(0, "new"), (0, "other, and longer")}


def test_only_what_is_added(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("time,value\n2024-01-01,1\n")
    out, marks = f"file://{tmp_path}/out", f"file://{tmp_path}/marks"
    stream = lambda: cursors.feed(spark, {"kind": "csv", "path": str(path), "from_start": "false", "series_id": "s"})
    run(stream(), out, marks)
    with path.open("a") as f:
        f.write('1704153600,2.5\n\nnonsense,3\n"2024-01-03",x\n2024-01-04,"4"\n1,2,3\n')
    run(stream(), out, marks)
    got = sorted((r["series_id"], r["t"].isoformat(), r["value"]) for r in spark.read.parquet(out).collect())
    assert got == [("s", "2024-01-02T00:00:00", 2.5), ("s", "2024-01-04T00:00:00", 4.0)]
    told = cursors.csv_points(spark.read.format("line_tail").option("path", str(path)).load(), "time,value")
    assert sorted(r["problem"] for r in told.filter("problem is not null").collect()) == ["fields", "time", "value"]
    with pytest.raises(ValueError, match="no feed"):
        cursors.feed(spark, {"kind": "pigeon"})


def test_json_lines_and_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, marks = f"file://{tmp_path}/out", f"file://{tmp_path}/marks"
    stream = lambda: cursors.feed(spark, {"kind": "json", "path": str(tmp_path / "in")})
    run(stream(), out, marks)
    (tmp_path / "in" / "a.jsonl").write_text('{"seriesId": "a", "t": 1704067200, "value": 1}\n{"value": "x"}\n{"series": "b", "time": "2024-01-02", "value": 2.5}\n')
    run(stream(), out, marks)
    assert sorted((r["series_id"], r["value"]) for r in spark.read.parquet(out).collect()) == [("a", 1.0), ("b", 2.5)]


@pytest.mark.parametrize("parts", [1, 5])
def test_table_by_time_survives_a_restart(spark, tmp_path, parts):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=7 * (k // 3)), f"s{k % 4}", float(k)) for k in range(900)]
    table = pa.table({"at": pa.array([r[0] for r in rows], pa.timestamp("us")), "name": [r[1] for r in rows], "v": [r[2] for r in rows]})
    pq.write_table(table, tmp_path / "x.parquet", row_group_size=100)
    out, marks = f"file://{tmp_path}/out", f"file://{tmp_path}/marks"
    micros = lambda t: int(t.replace(tzinfo=timezone.utc).timestamp() * 1_000_000)
    for until in (rows[400][0], rows[400][0], rows[700][0], start + timedelta(days=900)):
        spec = {"kind": "table", "path": str(tmp_path / "x.parquet"), "time": "at", "series": "name", "value": "v", "parts": parts, "least_cursor": micros(start), "until": micros(until)}
        run(cursors.feed(spark, spec), out, marks)
        got = sorted(r["value"] for r in spark.read.parquet(out).collect())
        assert got == [r[2] for r in rows if r[0] <= until]


def test_polling_of_ones_own(spark, tmp_path):
    newest = lambda options: int(options["now"]) or None
    fetch = lambda low, high, options: ((f"s{k % 2}", datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(hours=k), float(k)) for k in range((low or 0) + 1, high + 1))
    spark.dataSource.register(cursors.polling_source("counter", "series_id string, t timestamp, value double", newest, fetch))
    out, marks = f"file://{tmp_path}/out", f"file://{tmp_path}/marks"
    for now in (0, 5, 5, 12):
        run(cursors.feed(spark, {"kind": "poll", "format": "counter", "now": now, "parts": 3, "least_cursor": 0}), out, marks)
    assert sorted(r["value"] for r in spark.read.parquet(out).collect()) == [float(k) for k in range(1, 13)]
