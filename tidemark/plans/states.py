"""Queries of table functions, of sources that go on where they stopped, of operators with state, of densities and of compared tables, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import densities
from tidemark.operators import models, table_functions
from tidemark.plans.more import DAILY, longs, rounded
from tidemark.sources import cursors, merkle, tables
from tidemark.sources.snapshots import Snapshots
from tidemark.streaming import alarms, forecaster, replays
from tidemark.streaming.engine import _folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_FITS = """
d AS (SELECT *, value - lag(value) OVER (PARTITION BY series_id ORDER BY idx) AS step, value - lag(value, 7) OVER (PARTITION BY series_id ORDER BY idx) AS turn FROM p),
g AS (SELECT series_id, any_value(n) AS n, arg_max(value, idx) AS last, arg_min(value, idx) AS first, avg(value) AS mean, stddev_samp(value) AS sd, regr_slope(value, idx) AS slope, regr_intercept(value, idx) AS level, regr_syy(value, idx) - pow(regr_sxy(value, idx), 2) / regr_sxx(value, idx) AS rest,
sqrt(avg(step * step)) AS walk, sqrt(avg(turn * turn)) AS season FROM d GROUP BY 1),
e AS (SELECT g.series_id, sqrt(sum(pow(value - first - idx * (last - first) / (g.n - 1), 2)) / (any_value(g.n) - 1)) AS s FROM g JOIN p USING (series_id) GROUP BY 1),
f AS (SELECT series_id, h, m.method, CASE m.method WHEN 'naive' THEN last WHEN 'mean' THEN mean WHEN 'drift' THEN last + h * (last - first) / (n - 1) WHEN 'linear' THEN level + slope * (n - 1 + h) ELSE (SELECT value FROM p WHERE p.series_id = g.series_id AND p.idx = g.n - 7 + (h - 1) % 7) END AS point,
CASE m.method WHEN 'naive' THEN walk WHEN 'mean' THEN sd WHEN 'drift' THEN e.s WHEN 'linear' THEN sqrt(rest / (n - 2)) ELSE season END AS s FROM g JOIN e USING (series_id), range(1, 15) r(h), (VALUES ('naive'), ('mean'), ('drift'), ('linear'), ('snaive')) m(method))"""


@query("table_forecast", f"WITH {DAILY}, {_FITS} SELECT series_id, method, h, round(point, 4) AS point, round(point - 1.96 * s * sqrt(h), 4) AS lower, round(point + 1.96 * s * sqrt(h), 4) AS upper FROM f")
def table_forecast(spark, d):
    table_functions.register(spark)
    call = "SELECT * FROM forecast(TABLE({points}) PARTITION BY series_id ORDER BY (t), 14, 'naive,mean,drift,linear,snaive', 95, 7)"
    return longs(rounded(spark.sql(call, points=tables.daily_events(spark, d).select("series_id", "t", "value"))), "h")


@query("cursor_daily", "SELECT event_type AS series_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS t, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def cursor_daily(spark, d):
    """Events by the cursor of their time: half of them, then, after a restart, the rest. pyarrow must reach the tables' folder."""
    low, high = tables.table(spark, d, "events").agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).head()
    base = _folder(spark, "cursor")
    for until in ((low + high) // 2, high):
        spec = {"kind": "table", "path": f"{d}/events.parquet", "time": "ts", "series": "event_type", "value": "value", "least_cursor": low, "until": until, "parts": 4}
        replays.run_once(cursors.feed(spark, spec), f"{base}/out", f"{base}/marks")
    points = spark.read.parquet(f"{base}/out")
    return rounded(points.groupBy("series_id", F.to_date("t").cast("string").alias("t")).agg(F.count("*").alias("n"), F.sum("value").alias("value")), 2)


@query("tailed_hours", "SELECT event_type AS series_id, count(DISTINCT date_trunc('hour', ts)) AS hours, round(sum(value), 2) AS value FROM events GROUP BY 1")
def tailed_hours(spark, d):
    """Hourly totals as CSV files that grow in number; the tail reads the first, and after a restart the others."""
    events = tables.table(spark, d, "events")
    hourly = events.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("t")).agg(F.sum("value").alias("value"))
    base = _folder(spark, "tail")
    cursors.register(spark)
    lines = hourly.select(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "value", "series_id")
    for k in range(2):
        lines.filter(F.pmod(F.xxhash64("series_id"), F.lit(2)) == k).repartition(2).write.mode("append").option("header", True).csv(f"{base}/in")
        tail = spark.readStream.format("line_tail").option("path", f"{base}/in").option("split_bytes", 8192).load()
        replays.run_once(tail, f"{base}/out", f"{base}/marks")
    rows = spark.read.parquet(f"{base}/out")
    points = cursors.csv_points(rows, "timestamp,value,series_id").filter("problem is null")
    named = rows.select("file", "at", F.element_at(F.split("line", ","), -1).alias("name"))
    return rounded(points.join(named, ["file", "at"]).groupBy(F.col("name").alias("series_id")).agg(F.count_distinct("t").alias("hours"), F.sum("value").alias("value")), 2)


_HOURLY = """
ev AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS t, sum(value) AS value FROM events GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS idx FROM ev)"""
#: Refreshes at 10, 14, 18 ... points: means of cents over these counts never end on the edge of four digits.
_SETTINGS = forecaster.Settings(every=4, drift_window=30, drift_threshold=0.3, reselect_every=4)


def _hourly(spark, d):
    return tables.table(spark, d, "events").groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("t")).agg(F.sum("value").alias("value"))


@query(
    "stream_forecaster",
    f"""WITH {_HOURLY}, s AS (SELECT *, idx + 1 AS n, first_value(value) OVER w AS first, avg(value) OVER w AS mean, regr_slope(value, idx) OVER w AS slope, regr_intercept(value, idx) OVER w AS level,
abs(avg(value) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM p WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, CASE WHEN idx < 9 THEN 'insufficient-data' WHEN idx = 9 THEN 'no-fit' WHEN (idx - 9) % 4 <> 0 THEN 'below-threshold' WHEN n >= 20 AND round(z, 9) > 0.3 THEN 'drift' ELSE 'new-points' END AS reason, (idx - 9) // 4 AS k FROM s),
c AS (SELECT *, reason IN ('no-fit', 'drift', 'new-points') AS recomputed, reason = 'no-fit' OR reason = 'drift' OR (reason = 'new-points' AND k % 4 = 0) AS reselected, greatest(1, least(365, floor(n / 5.0 + 0.5)))::BIGINT AS test FROM r),
a AS (SELECT c.series_id, c.idx, m.method, m.place, sqrt(avg(pow(v.value - CASE m.method WHEN 'naive' THEN b.value WHEN 'mean' THEN b.mean WHEN 'drift' THEN b.value + (v.idx - b.idx) * (b.value - b.first) / (b.n - 1) ELSE b.level + b.slope * v.idx END, 2))) AS rmse
FROM c JOIN s b ON b.series_id = c.series_id AND b.idx = c.idx - c.test JOIN p v ON v.series_id = c.series_id AND v.idx > c.idx - c.test AND v.idx <= c.idx, (VALUES ('naive', 0), ('mean', 1), ('drift', 2), ('linear', 3)) m(method, place) WHERE reselected GROUP BY ALL),
w AS (SELECT series_id, idx, method FROM a QUALIFY row_number() OVER (PARTITION BY series_id, idx ORDER BY round(rmse, 6), place) = 1),
x AS (SELECT c.*, last_value(w.method IGNORE NULLS) OVER (PARTITION BY c.series_id ORDER BY c.idx ROWS UNBOUNDED PRECEDING) AS method FROM c LEFT JOIN w USING (series_id, idx)),
y AS (SELECT *, CASE WHEN recomputed THEN CASE method WHEN 'naive' THEN value WHEN 'mean' THEN mean WHEN 'drift' THEN value + (value - first) / (n - 1) ELSE level + slope * n END END AS made FROM x)
SELECT series_id, n AS points, reason, recomputed, reselected, method, CASE WHEN idx < 9 THEN 0 ELSE k + 1 END AS refreshes, CASE WHEN recomputed AND n >= 20 THEN round(z, 4) END AS z, round(last_value(made IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 4) AS next FROM y""",
)
def stream_forecaster(spark, d):
    """Hourly totals through forecasters with state, in three runs of the stream."""
    out, _ = replays.replay_parts(replays.by_time(_hourly(spark, d), 3), lambda s: forecaster.forecast_stream(s, _SETTINGS))
    return rounded(out.select("series_id", "points", "reason", "recomputed", "reselected", "method", "refreshes", "z", "next"))


@query(
    "stream_snapshot",
    f"WITH {_HOURLY} SELECT series_id, count(*) AS points, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, (count(*) - 10) // 4 + 1 AS refreshes, count(*) AS kept, round(sum(value), 2) AS total FROM p GROUP BY 1",
)
def stream_snapshot(spark, d):
    """What the forecasters' state holds after all hourly totals, read from the checkpoint."""
    _, marks = replays.replay_parts(replays.by_time(_hourly(spark, d), 2), lambda s: forecaster.forecast_stream(s, _SETTINGS))
    out = replays.snapshots(spark, marks)
    total = F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 2)
    return rounded(out.select("series_id", "points", "mean", "sd", "refreshes", F.size("values").cast("bigint").alias("kept"), total.alias("total")))


@query(
    "stream_alarms",
    f"""WITH RECURSIVE {DAILY}, s AS (SELECT series_id, idx, t::TIMESTAMP AS t, value, n FROM p),
f AS (SELECT series_id, 0::BIGINT AS idx, CASE WHEN value > 3300 THEN 1 ELSE 0 END::BIGINT AS hits, 'info' AS level, CASE WHEN value > 3300 THEN t END AS fired, 0::BIGINT AS muted, 0::BIGINT AS before, value > 3300 AS told, false AS escalated FROM s WHERE idx = 0
UNION ALL SELECT series_id, idx, hits, target, CASE WHEN tell THEN t ELSE fired END, CASE WHEN tell THEN 0 WHEN hits > 0 THEN muted + 1 ELSE muted END, muted, tell, hits > 0 AND target <> level FROM (
SELECT *, hits > 0 AND (target <> level OR fired IS NULL OR t - fired >= INTERVAL 2 DAY) AS tell FROM (
SELECT s.series_id, s.idx, s.t, CASE WHEN value > 3300 THEN hits + 1 ELSE 0 END AS hits, CASE WHEN value > 3300 THEN level ELSE 'info' END AS level, CASE WHEN value <= 3300 THEN 'info' WHEN hits + 1 >= 6 THEN 'critical' WHEN hits + 1 >= 3 THEN 'warn' ELSE 'info' END AS target, fired, muted FROM f JOIN s ON s.series_id = f.series_id AND s.idx = f.idx + 1))),
e AS (SELECT series_id, min(t) AS first, max(t) AS last FROM s GROUP BY 1), k AS (SELECT max(t) + INTERVAL 40 DAY AS clock FROM s),
told AS (SELECT series_id, t, 'threshold' AS kind, 'high' AS rule, level, hits, escalated, before AS suppressed, value FROM f JOIN s USING (series_id, idx) WHERE told
UNION ALL SELECT series_id, first + h * INTERVAL 1 WEEK, 'run', 'weekly', 'refit', h, false, 0, NULL FROM e, k, range(1, 60) r(h) WHERE first + h * INTERVAL 1 WEEK <= clock
UNION ALL SELECT series_id, first + h * INTERVAL 1 MONTH, 'run', 'monthly', 'validate', h, false, 0, NULL FROM e, k, range(1, 60) r(h) WHERE first + h * INTERVAL 1 MONTH <= clock
UNION ALL SELECT series_id, t + INTERVAL 3 DAY, 'silent', NULL, 'warn', 1, false, 0, NULL FROM (SELECT *, lead(t) OVER (PARTITION BY series_id ORDER BY idx) AS after FROM s), k WHERE t + INTERVAL 3 DAY < coalesce(after, clock))
SELECT series_id, strftime(t, '%Y-%m-%d') AS t, kind, rule, level, hits, escalated, suppressed, round(value, 4) AS value FROM told""",
)
def stream_alarms(spark, d):
    """Daily totals through alerts, schedules and silences, in three runs; at last only the clock goes on, by 40 days and a second."""
    daily = tables.daily_events(spark, d).select("series_id", F.col("t").cast("timestamp").alias("t"), "value")
    clock = daily.agg(F.lit("clock").alias("series_id"), (F.max("t") + F.expr("INTERVAL 40 DAY 1 SECOND")).alias("t"), F.lit(None).cast("double").alias("value"))
    rules = (alarms.Rule("high", "threshold", 3300.0, cooldown_ms=2 * alarms.DAY),)
    schedules = (alarms.Schedule("weekly", "weekly"), alarms.Schedule("monthly", "monthly", "validate"))
    out, _ = replays.replay_parts([*replays.by_time(daily, 3), clock], lambda s: alarms.alarm_stream(s, rules, schedules, 3 * alarms.DAY))
    return rounded(out.withColumn("t", F.date_format("t", "yyyy-MM-dd")))


_STEPS = f"{DAILY}, r AS (SELECT series_id, value - lag(value) OVER (PARTITION BY series_id ORDER BY idx) AS e FROM p)"


@query(
    "density_fits",
    f"""WITH {_STEPS}, m AS (SELECT series_id, count(e) AS n, avg(e * e) AS m2, kurtosis_pop(e) AS k, avg(e * e) FILTER (e > 0) / avg(e * e) FILTER (e < 0) AS q FROM r GROUP BY 1),
f AS (SELECT *, CASE WHEN k > 6 / 196.0 THEN 4 + 6 / k ELSE 200.0 END AS df, ln(q) / 4 AS s FROM m)
SELECT series_id, n, round(sqrt(m2 * (df - 2) / df / ((exp(3 * s) + exp(-3 * s)) / (exp(s) + exp(-s)))), 4) AS sigma, round(df, 4) AS df, round(s, 4) AS skew FROM f""",
)
def density_fits(spark, d):
    """A skewed t for each series' daily steps."""
    return rounded(densities.fit_densities(_steps(spark, d)))


def _steps(spark, d):
    by_idx = Window.partitionBy("series_id").orderBy("idx")
    return tables.daily_events(spark, d).withColumn("value", F.col("value") - F.lag("value").over(by_idx)).select("series_id", "value")


@query("density_bands")
def density_bands(spark, d):
    """The last value of each series for a week, with the quantiles of the fitted density."""
    last = tables.daily_events(spark, d).groupBy("series_id").agg(F.max_by("value", "idx").alias("point")).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(7))))
    return rounded(densities.density_bands(last, densities.fit_densities(_steps(spark, d)), 0.9))


@query(
    "located_changes",
    f"WITH {DAILY}, k AS (SELECT series_id, max(idx) FILTER (idx % 9 = 4) AS odd, min(idx) AS low, max(idx) AS high FROM p GROUP BY 1) SELECT series_id, odd AS idx, 'changed' AS change FROM k WHERE series_id = 'click' UNION ALL SELECT series_id, low, 'removed' FROM k WHERE series_id = 'error' UNION ALL SELECT series_id, high + 1, 'added' FROM k WHERE series_id = 'view'",
)
def located_changes(spark, d):
    """Two versions of the daily totals: of click one value changed, of error the first is gone, of view one more day. Their trees lead to these rows."""
    before = tables.daily_events(spark, d).select("series_id", F.col("idx").cast("bigint").alias("idx"), "value")
    ends = before.groupBy("series_id").agg(F.max(F.when(F.col("idx") % 9 == 4, F.col("idx"))).alias("odd"), F.max("idx").alias("high"))
    after = before.join(ends, "series_id").filter("series_id <> 'error' or idx > 0")
    after = after.withColumn("value", F.when((F.col("series_id") == "click") & (F.col("idx") == F.col("odd")), F.col("value") + 1).otherwise(F.col("value")))
    more = ends.filter("series_id = 'view'").select("series_id", (F.col("high") + 1).alias("idx"), F.lit(0.0).alias("value"))
    base = _folder(spark, "versions")
    for name, df in (("a", before), ("b", after.select(*before.columns).unionByName(more))):
        merkle.write_hashed(df, f"{base}/{name}", ("series_id", "idx"), 2)
    return merkle.located_changes(spark, f"{base}/a", f"{base}/b", "series_id string, idx bigint, value double", ("series_id", "idx"), 2).select("series_id", "idx", "change")


@query("reproduced", f"WITH {DAILY} SELECT series_id, m.method, h, 'same' AS status FROM (SELECT DISTINCT series_id FROM p), range(1, 8) r(h), (VALUES ('naive'), ('mean'), ('drift'), ('linear')) m(method)")
def reproduced(spark, d):
    """A forecast's report, stored with the points it was made of; made again from the restored points, and compared."""
    snaps = Snapshots(spark, _folder(spark, "reproduce"))
    points = tables.daily_events(spark, d).select("series_id", "idx", "value")
    version = snaps.create(points, "daily")
    methods = ("naive", "mean", "drift", "linear")
    report = _folder(spark, "report")
    models.forecast(points, 7, methods=methods).write.parquet(report)
    again = models.forecast(snaps.restore("daily", version), 7, methods=methods)
    return longs(merkle.reproduced(spark.read.parquet(report), again, ("series_id", "method", "h"), ("point", "lower", "upper")).drop("difference"), "h")
