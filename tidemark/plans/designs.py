"""Queries of feature matrices, windows and whole quality reports, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import design
from tidemark.plans.guide import ORACLES as GUIDE
from tidemark.plans.more import DAILY, ORDERS, daily, longs
from tidemark.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WEEKLY = {"fourier": {"seasons": [7, 14], "harmonics": [2, 1]}, "weekdays": True, "lags": [1, 7]}
FOUND = {"fourier": {"auto": True, "harmonics": 2, "least": 0.0, "z": 0.5}}

FINDINGS = """
per AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS t, sum(value) AS value FROM events GROUP BY 1, 2),
hours AS (SELECT series_id, unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) AS t FROM per GROUP BY 1),
p AS (SELECT series_id, t, value, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS idx FROM hours LEFT JOIN per USING (series_id, t)),
known AS (SELECT *, row_number() OVER (w ORDER BY idx) - 1 AS j, count(*) OVER w AS n, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd,
  coalesce(value - lag(value) OVER (w ORDER BY idx), 0.0) AS d FROM p WHERE value IS NOT NULL WINDOW w AS (PARTITION BY series_id)),
nulls AS (SELECT series_id, min(idx) AS first, max(idx) AS last, count(*) AS size FROM (SELECT series_id, idx, idx - row_number() OVER (PARTITION BY series_id ORDER BY idx) AS run FROM p WHERE value IS NULL) GROUP BY series_id, run),
far AS (SELECT series_id, idx, idx - row_number() OVER (PARTITION BY series_id ORDER BY idx) AS run FROM known WHERE abs(value - mean) > 2 * sd),
sides AS (SELECT *, CAST(greatest(5, floor(n / 10)) AS BIGINT) AS w FROM known),
shifts AS (SELECT a.series_id, a.idx, any_value(a.sd) AS sd, avg(b.value) FILTER (b.j < a.j) AS before, avg(b.value) FILTER (b.j >= a.j) AS after
  FROM sides a JOIN sides b ON a.series_id = b.series_id AND b.j >= a.j - a.w AND b.j < a.j + a.w WHERE a.j >= a.w AND a.j < a.n - a.w AND a.n >= 3 * a.w GROUP BY 1, 2),
blocks AS (SELECT series_id, idx // 24 AS block, idx % 24 AS phase, value FROM known),
breaks AS (SELECT a.series_id, a.block, corr(a.value, b.value) AS r, count(*) AS n FROM blocks a JOIN blocks b ON a.series_id = b.series_id AND b.block = a.block + 1 AND a.phase = b.phase GROUP BY 1, 2),
found AS (
SELECT series_id, CASE WHEN size <= 2 THEN 'hole' ELSE 'gap' END AS "check", CASE WHEN size <= 2 THEN 'warning' ELSE 'error' END AS severity, first, last, size FROM nulls
UNION ALL SELECT series_id, 'outlier', 'warning', idx, idx, 1 FROM known WHERE abs(value - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END > 2.5
UNION ALL SELECT series_id, 'outlier_cluster', 'warning', min(idx), max(idx), count(*) FROM far GROUP BY series_id, run HAVING count(*) >= 2
UNION ALL SELECT series_id, 'trend_shift', 'info', idx, idx, 1 FROM shifts WHERE abs(after - before) > 0.5 * CASE WHEN sd > 0 THEN sd ELSE 1 END
UNION ALL SELECT series_id, 'season_break', 'info', block * 24, block * 24 + 47, 1 FROM breaks WHERE n = 24 AND r < 0.7
UNION ALL SELECT series_id, 'not_stationary', 'info', min(idx), max(idx), count(*) FROM known GROUP BY 1 HAVING var_pop(value) / greatest(var_pop(d), 0.001) >= 2
UNION ALL SELECT series_id, 'duplicate', 'error', NULL, NULL, CAST(sum(k - 1) AS BIGINT) FROM (SELECT event_type AS series_id, count(*) AS k FROM events GROUP BY event_type, ts) GROUP BY 1 HAVING sum(k - 1) > 0)
"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _hourly(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Hourly sums by event type, null where an hour has no event, and the events' own times."""
    events = tables.table(spark, d, "events").select(F.col("event_type").alias("series_id"), F.col("ts").alias("t"), "value")
    per = events.groupBy("series_id", F.date_trunc("hour", "t").alias("t")).agg(F.sum("value").alias("value"))
    hours = per.groupBy("series_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).select("series_id", F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("t"))
    return tables.indexed(hours.join(per, ["series_id", "t"], "left")), events.select("series_id", "t")


@query("quality_findings", f'WITH {FINDINGS} SELECT series_id, "check", severity, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, CAST(size AS BIGINT) AS size FROM found')
def quality_findings(spark, d):
    points, observed = _hourly(spark, d)
    return design.findings(points, 24, observed)


@query(
    "quality_profile",
    f"""WITH {FINDINGS}, g AS (SELECT series_id, "check", severity, count(*) AS k FROM found GROUP BY ALL),
s AS (SELECT series_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS notes, array_to_string(list_sort(list("check" || ':' || k)), ',') AS issues FROM g GROUP BY 1),
b AS (SELECT series_id, count(*) AS n, count(*) - count(value) AS missing FROM p GROUP BY 1)
SELECT series_id, n, missing, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(notes, 0) AS notes,
CASE WHEN errors + warnings > 0 THEN round(100 * (1 - (3 * errors + warnings) / (3.0::DOUBLE * (errors + warnings))), 1) ELSE 100.0::DOUBLE END AS health, coalesce(issues, '') AS issues FROM b LEFT JOIN s USING (series_id)""",
)
def quality_profile(spark, d):
    points, observed = _hourly(spark, d)
    return design.quality_profile(points, 24, observed)


# adding 0 makes one zero of both
_TERM = "round({}, 4) + 0.0::DOUBLE"


def _long(df: DataFrame, *keys: str) -> DataFrame:
    out = df.select(*keys, F.posexplode("terms").alias("k", "x"))
    return longs(out.select(*keys, "k", (F.round("x", 4) + 0.0).alias("x")), *(c for c in keys if c != "series_id"), "k")


@query(
    "feature_terms",
    f"""WITH {DAILY}, w(k, season, harmonic) AS (VALUES (0, 7, 1), (2, 7, 2), (4, 14, 1))
SELECT series_id, idx, k::BIGINT AS k, {_TERM.format("sin(2 * pi() * harmonic * idx / season)")} AS x FROM p, w
UNION ALL SELECT series_id, idx, k + 1, {_TERM.format("cos(2 * pi() * harmonic * idx / season)")} FROM p, w
UNION ALL SELECT series_id, idx, day + 5, (isodow(t) = day + 1)::INT::DOUBLE FROM p, range(1, 7) d(day)""",
)
def feature_terms(spark, d):
    return _long(design.feature_matrix(daily(spark, d), design.parse_config(WEEKLY)), "series_id", "idx")


@query("lagged_values", f"WITH {DAILY} SELECT series_id, idx, round(lag(value, 1) OVER w, 4) AS lag_1, round(lag(value, 7) OVER w, 4) AS lag_7 FROM p WINDOW w AS (PARTITION BY series_id ORDER BY idx)")
def lagged_values(spark, d):
    m = design.feature_matrix(daily(spark, d), design.parse_config(WEEKLY))
    return longs(m.select("series_id", "idx", F.round(F.col("lagged")[0], 4).alias("lag_1"), F.round(F.col("lagged")[1], 4).alias("lag_7")), "idx")


@query(
    "future_terms",
    GUIDE["auto_seasons"].replace("SELECT 'orders' AS series_id, CAST(season AS INT)", ", kept AS (SELECT 'orders' AS series_id, CAST(season AS INT)")
    + f"""), e AS (SELECT max(idx) AS last FROM p), r AS (SELECT *, row_number() OVER (ORDER BY season) - 1 AS s FROM kept),
w AS (SELECT h, last + h AS idx, season, s, harmonic FROM e, range(1, 15) x(h), r, range(1, 3) y(harmonic))
SELECT 'orders' AS series_id, h, 4 * s + 2 * (harmonic - 1) AS k, {_TERM.format("sin(2 * pi() * harmonic * idx / season)")} AS x FROM w
UNION ALL SELECT 'orders', h, 4 * s + 2 * harmonic - 1, {_TERM.format("cos(2 * pi() * harmonic * idx / season)")} FROM w""",
)
def future_terms(spark, d):
    return _long(design.future_matrix(tables.daily_orders(spark, d), design.parse_config(FOUND), 14), "series_id", "h")


@query(
    "recent_windows",
    f"""WITH {ORDERS}, e AS (SELECT max(t) AS stop, max(idx) AS last FROM p)
SELECT kind, count(*) AS n, min(idx) AS first, round(sum(value), 2) AS total FROM (
SELECT 'last_3_months' AS kind, idx, value FROM p, e WHERE idx > last - 90 UNION ALL SELECT 'last_10_weeks', idx, value FROM p, e WHERE t > stop - 70 UNION ALL SELECT '200', idx, value FROM p, e WHERE idx > last - 200) GROUP BY 1""",
)
def recent_windows(spark, d):
    p = tables.daily_orders(spark, d)
    kinds = {"last_3_months": design.window_of(p, "last_3_months"), "last_10_weeks": design.window_of(p, "last_10_weeks", "time"), "200": design.window_of(p, 200)}
    out = None
    for kind, w in kinds.items():
        w = w.select(F.lit(kind).alias("kind"), "idx", "value")
        out = w if out is None else out.unionByName(w)
    return longs(out.groupBy("kind").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.round(F.sum("value").cast("double"), 2).alias("total")), "first")
