"""Queries of responses, paths, the light additive model and Markdown reports, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import responses, scenarios
from tidemark.plans.more import DAILY, daily, longs, rounded
from tidemark.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RESPONSE = f"""{DAILY},
d AS (SELECT series_id, idx, value - avg(value) OVER s - regr_slope(value, idx) OVER s * (idx - avg(idx) OVER s) AS v FROM p WINDOW s AS (PARTITION BY series_id)),
x AS (SELECT c.v AS y, a.v AS x0, b.v AS x1 FROM d c JOIN d a ON a.idx = c.idx JOIN d b ON b.idx = c.idx - 1 WHERE c.series_id = 'click' AND a.series_id = 'view' AND b.series_id = 'view'),
m AS (SELECT count(*) AS n, covar_pop(y, x0) AS p0, covar_pop(y, x1) AS p1, covar_pop(x0, x1) AS r, var_pop(x0) AS u, var_pop(x1) AS w, var_pop(y) AS vy FROM x),
b AS (SELECT *, (p0 * w - p1 * r) / (u * w - r * r) AS b0, (p1 * u - p0 * r) / (u * w - r * r) AS b1 FROM m),
f AS (SELECT *, (b0 * p0 + b1 * p1) / vy AS r2, sqrt((vy - b0 * p0 - b1 * p1) * n / (n - 3)) AS sigma FROM b),
response AS (SELECT 0 AS lag, b0 AS coefficient, n, r2, sigma FROM f UNION ALL SELECT 1, b1, n, r2, sigma FROM f)"""
LIGHT = f"""{DAILY},
w AS (SELECT *, least(7, n // 10) AS w FROM p),
l AS (SELECT series_id, avg(value) AS base, coalesce(regr_slope(value, idx), 0) AS slope FROM w WHERE w = 0 OR idx >= n - w GROUP BY 1),
s AS (SELECT series_id, idx % 7 AS phase, avg(value) AS seasonal FROM p WHERE idx < n // 7 * 7 GROUP BY 1, 2),
light AS (SELECT l.series_id, h, base + 0.1 * slope * (7 + h) + coalesce(seasonal, 0) AS point, 1.96 * (h * 0.5::DOUBLE + 1) AS half FROM l CROSS JOIN range(1, 31) r(h) LEFT JOIN s ON s.series_id = l.series_id AND phase = (h - 1) % 7)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("lag_response", f"WITH {RESPONSE} SELECT lag, round(coefficient, 4) AS coefficient, n, round(r2, 4) AS r2, round(sigma, 4) AS sigma FROM response")
def lag_response(spark, d):
    return rounded(responses.lag_response(daily(spark, d), "view", "click", 1))


@query("intervention", f"""WITH {RESPONSE},
y AS (SELECT max(value) FILTER (idx = n - 1) AS last, max(value) FILTER (idx = n - 1 - least(n - 1, greatest(3, n // 4))) AS before, max(least(n - 1, greatest(3, n // 4))) AS k, stddev_samp(value) AS sd FROM p WHERE series_id = 'click'),
e AS (SELECT s.h, coalesce(sum(100 * coefficient) FILTER (s.h - lag BETWEEN 3 AND 6), 0) AS delta, count(*) FILTER (s.h - lag BETWEEN 3 AND 6) AS active, max(sigma) AS sigma FROM range(0, 14) s(h), response GROUP BY 1),
z AS (SELECT *, last + (last - before) / k * (h + 1) AS baseline FROM e, y)
SELECT CAST(h + 1 AS INT) AS h, round(baseline, 4) AS baseline, round(baseline + delta, 4) AS counterfactual, round(delta, 4) AS delta, round(sum(delta) OVER (ORDER BY h), 4) AS cumulative,
round(baseline + delta - 1.28 * sd - sigma * sqrt(greatest(active, 1)), 4) AS lower, round(baseline + delta + 1.28 * sd + sigma * sqrt(greatest(active, 1)), 4) AS upper FROM z""")
def intervention(spark, d):
    points = daily(spark, d)
    return rounded(responses.intervention(points, responses.lag_response(points, "view", "click", 1), "click", 100.0, start=3, duration=4, horizon=14))


@query("cumulative_intervals", f"""WITH {DAILY}, s AS (SELECT series_id, idx // 7 AS path, sum(value) AS s FROM p WHERE idx % 7 < 5 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY s) - 1 AS k, count(*) OVER (PARTITION BY series_id) AS n FROM s)
SELECT series_id, count(*) AS paths, round(avg(s), 4) AS estimate, round(min(s) FILTER (k = floor(n * (1 - 0.8::DOUBLE) / 2)), 4) AS lower, round(min(s) FILTER (k = least(ceil(n * (1 + 0.8::DOUBLE) / 2), n - 1)), 4) AS upper FROM k GROUP BY 1""")
def cumulative_intervals(spark, d):
    paths = daily(spark, d).select("series_id", F.floor(F.col("idx") / 7).alias("path"), (F.col("idx") % 7 + 1).alias("step"), "value")
    return rounded(responses.cumulative_intervals(paths, 5, 0.8))


@query("light_additive", f"WITH {LIGHT} SELECT series_id, h, round(point, 4) AS point, round(point - half, 4) AS lower, round(point + half, 4) AS upper FROM light")
def light_additive(spark, d):
    return longs(rounded(responses.light_additive(daily(spark, d), 7, 30)), "h")


@query("markdown_report", f"""WITH {LIGHT} SELECT series_id, '# ' || series_id || chr(10) || chr(10) || '| Step | Forecast | Lower 80% | Upper 80% |' || chr(10) || '|---|---|---|---|' || chr(10)
|| string_agg(printf('| %d | %.2f | %.2f | %.2f |', h, point, point - half, point + half), chr(10) ORDER BY h) FILTER (h <= 24) || chr(10) || chr(10) || 'Showing the first 24 of 30 steps.' AS report FROM light GROUP BY 1""")
def markdown_report(spark, d):
    return responses.markdown_reports(responses.light_additive(daily(spark, d), 7, 30))


@query("path_percentiles")
def path_percentiles(spark, d):
    """Paths of daily revenue from its last value; its relative and log steps give the volatilities."""
    points = tables.daily_orders(spark, d)
    last, _, sd = scenarios.walk_of(points)
    rate = scenarios.walk_of(points.withColumn("value", F.ln("value")))[2]
    kinds = [responses.path_percentiles(responses.random_paths(spark, k, last, v, 20, sims=4000)).withColumn("kind", F.lit(k)) for k, v in (("autoregressive", sd), ("geometric", rate * 252**0.5), ("multiplicative", rate))]
    return rounded(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]))
