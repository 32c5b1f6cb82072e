"""Queries of forecasts on transformed scales and of regressions on harmonics, with their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import models, multi, regress, transforms
from tidemark.plans.more import DAILY, ORDERS, rounded
from tidemark.plans.wider import EVENT_TYPES
from tidemark.sources import projects, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NATIONS = """
od AS (SELECT CAST(c_nationkey AS VARCHAR) AS series_id, CAST(o_orderdate AS DATE) AS t, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM od)"""
SCALES = f"""{NATIONS},
ph AS (SELECT series_id, avg(value) AS mean, stddev_pop(value) AS sd, count(*) AS k FROM p GROUP BY series_id, idx % 7),
kd AS (SELECT series_id, CASE WHEN sum(k) >= 14 AND avg(sd / mean) FILTER (k >= 2 AND mean > 0) > 0.5 THEN 'multiplicative' ELSE 'additive' END AS kind FROM ph GROUP BY 1),
sh AS (SELECT series_id, CASE WHEN min(value) <= 0 THEN 1 - min(value) ELSE 0 END AS shift FROM p GROUP BY 1),
mv AS (SELECT series_id, value + shift AS v FROM p JOIN sh USING (series_id) JOIN kd USING (series_id) WHERE kind = 'multiplicative'),
li AS (SELECT series_id, k, k / 10.0 AS l, -count(*) / 2.0 * ln(var_pop(CASE WHEN k = 0 THEN ln(v) ELSE (pow(v, k / 10.0) - 1) / (k / 10.0) END)) + (k / 10.0 - 1) * sum(ln(v)) AS score FROM mv, range(-20, 21) r(k) GROUP BY 1, 2),
lb AS (SELECT series_id, CAST(l AS DOUBLE) AS lam FROM li QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(score, 6) DESC, k) = 1),
sc AS (SELECT series_id, kind, lam, CASE WHEN lam IS NULL THEN 0.0 ELSE CAST(shift AS DOUBLE) END AS shift FROM kd LEFT JOIN lb USING (series_id) LEFT JOIN sh USING (series_id))"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def daily_nations(spark: SparkSession, d: str) -> DataFrame:
    """Daily revenue by nation of the customer, on the days that have any."""
    o, c = tables.table(spark, d, "orders"), tables.table(spark, d, "customer")
    per = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_nationkey").cast("string").alias("series_id"), F.to_date("o_orderdate").alias("t")).agg(F.sum("o_totalprice").alias("value"))
    return tables.indexed(per)


@query("auto_transforms", f"WITH {SCALES} SELECT series_id, kind, lam IS NOT NULL AS transform, round(lam, 4) AS lambda, CAST(shift AS DOUBLE) AS shift FROM sc")
def auto_transforms(spark, d):
    """Which nations' revenue is forecast on a Box-Cox scale, by the spread within weekdays of trade."""
    return rounded(transforms.auto_transform(daily_nations(spark, d), 7))


_BACK = "CASE WHEN lam IS NULL THEN {0} WHEN abs(lam) < 1e-4 THEN exp({0}) - shift WHEN lam * ({0}) + 1 <= 0 THEN 0.0 - shift ELSE pow(lam * ({0}) + 1, 1 / lam) - shift END"


@query(
    "auto_forecasts",
    f"""WITH {SCALES}, x AS (SELECT series_id, idx, n, CASE WHEN lam IS NULL THEN value WHEN abs(lam) < 1e-4 THEN ln(value + shift) ELSE (pow(value + shift, lam) - 1) / lam END AS x FROM p JOIN sc USING (series_id)),
f AS (SELECT series_id, any_value(n) AS n, arg_max(x, idx) AS last, arg_min(x, idx) AS first, avg(x) AS mean FROM x WHERE n >= 2 GROUP BY 1),
s AS (SELECT series_id, sqrt(sum(pow(x.x - mean, 2)) / greatest(any_value(f.n) - 1, 1)) AS sm, sqrt(sum(pow(x.x - (first + (last - first) / (f.n - 1) * idx), 2)) / greatest(any_value(f.n) - 1, 1)) AS sd FROM x JOIN f USING (series_id) GROUP BY 1),
b AS (SELECT series_id, h, unnest(['mean', 'drift']) AS method, unnest([mean, last + h * (last - first) / (n - 1)]) AS point, unnest([sm, sd]) * 1.2816 * sqrt(h) AS half FROM f JOIN s USING (series_id), range(1, 8) r(h))
SELECT series_id, method, CAST(h AS INT) AS h, round({_BACK.format("point")}, 3) AS point, round({_BACK.format("point - half")}, 3) AS lower, round({_BACK.format("point + half")}, 3) AS upper FROM b JOIN sc USING (series_id)""",
)
def auto_forecasts(spark, d):
    """Two forecasters of each nation's revenue, on its own scale."""
    return rounded(transforms.auto_forecast(daily_nations(spark, d), 7, lambda p: models.forecast(p, 7, methods=("mean", "drift"))), 3)


def harmonic_sql(season: int, harmonics: int, horizon: int) -> str:
    """Normal equations with a ridge of 1e-8, solved by elimination."""
    terms = ["1.0::DOUBLE", *(f"{f}(2 * pi() * {k} * {{0}} / {season})" for k in range(1, harmonics + 1) for f in ("sin", "cos"))]
    m = len(terms) + 1
    gram = ", ".join(f"sum(c{i} * c{j})" + (f" + greatest(1e-8 * sum(c{i} * c{i}), 1e-12)" if i == j < m - 1 else "") for i in range(m) for j in range(m))
    fitted = lambda at: " + ".join(f"g[{k * m + m}] * {t.format(at)}" for k, t in enumerate(terms))
    parts = [
        ORDERS,
        f"x AS (SELECT series_id, {', '.join(f'{t.format("idx")} AS c{k}' for k, t in enumerate(terms))}, value AS c{m - 1} FROM p)",
        f"g0 AS (SELECT series_id, count(*) AS n, [{gram}] AS g FROM x GROUP BY 1)",
        *(f"g{k + 1} AS (SELECT series_id, n, list_transform(range({m * m}), lambda x: CASE WHEN x // {m} = {k} THEN g[x + 1] / g[{k * m + k + 1}] ELSE g[x + 1] - g[(x // {m}) * {m} + {k + 1}] * g[{k * m} + x % {m} + 1] / g[{k * m + k + 1}] END) AS g FROM g{k})" for k in range(m - 1)),
        f"v AS (SELECT p.series_id, sum(pow(value - ({fitted('idx')}), 2)) / greatest(any_value(g.n) - {m - 1}, 1) AS v FROM p JOIN g{m - 1} g USING (series_id) GROUP BY 1)",
        f"f AS (SELECT series_id, h, {fitted('(n - 1 + h)')} AS point, 1.2816 * sqrt(v * (1 + h / n)) AS half FROM g{m - 1} JOIN v USING (series_id), range(1, {horizon + 1}) r(h))",
    ]
    return f"WITH {', '.join(parts)} SELECT series_id, CAST(h AS INT) AS h, round(point, 3) AS point, round(point - half, 3) AS lower, round(point + half, 3) AS upper FROM f"


@query("harmonic_forecast", harmonic_sql(7, 2, 14))
def harmonic_forecast(spark, d):
    return rounded(regress.harmonic_forecast(tables.daily_orders(spark, d), 7, 2, 14), 3)


@query(
    "project_weeks",
    f"""WITH {ORDERS}, b AS (SELECT *, CAST(floor((epoch_ms(t) - min(epoch_ms(t)) OVER ()) / 604800000.0) AS BIGINT) AS bin, min(t) OVER () AS start FROM p)
SELECT row_number() OVER (ORDER BY bin) - 1 AS idx, CAST(any_value(start) + CAST(bin * 7 AS INT) AS DATE) AS day, round(sum(value), 2) AS value FROM b GROUP BY bin""",
)
def project_weeks(spark, d):
    """Daily revenue as CSV files with a project beside them, loaded by the project: seven days each."""
    folder = f"{tables.shared_dir(spark)}/project-{uuid.uuid4().hex}"
    tables.daily_orders(spark, d).select(F.date_format("t", "yyyy-MM-dd").alias("date"), F.col("value").alias("revenue")).write.option("header", True).csv(f"{folder}/days")
    projects.write_project(spark, f"{folder}/revenue.forecast.json", projects.default_project("revenue", "days") | {"valueColumn": "revenue", "resample": True, "agg": "sum", "step": 7 * 86_400_000})
    points = projects.load(spark, folder).points
    return points.select(F.col("idx").cast("bigint").alias("idx"), F.to_date("t").alias("day"), F.round("value", 2).alias("value"))


def vector_sql(names: list[str], horizon: int) -> str:
    """A vector autoregression of order 1: normal equations with a ridge of 1e-8 of their mean diagonal, by elimination, then step by step."""
    k = len(names)
    m, width = k + 1, 2 * k + 1
    value = lambda n: f"max(value) FILTER (series_id = '{n}')"
    columns = [*(f"c{i}" for i in range(m)), *(f"y{i}" for i in range(k))]
    gram = ", ".join(f"sum({a} * {b})" for a in columns for b in columns)
    diagonal = " + ".join(f"g[{i * width + i + 1}]" for i in range(m))
    beta = lambda i, j: f"g[{i * width + m + j + 1}]"
    parts = [
        DAILY,
        f"w AS (SELECT idx, {', '.join(f'{value(n)} AS v{i}' for i, n in enumerate(names))} FROM p GROUP BY 1)",
        f"x AS (SELECT b.idx, 1.0::DOUBLE AS c0, {', '.join(f'a.v{i} AS c{i + 1}' for i in range(k))}, {', '.join(f'b.v{i} AS y{i}' for i in range(k))} FROM w a JOIN w b ON b.idx = a.idx + 1)",
        f"raw AS (SELECT [{gram}] AS g FROM x)",
        f"g0 AS (SELECT list_transform(range({width * width}), lambda x: g[x + 1] + CASE WHEN x // {width} = x % {width} AND x // {width} < {m} THEN 1e-8 * ({diagonal}) / {m} ELSE 0 END) AS g FROM raw)",
        *(f"g{s + 1} AS (SELECT list_transform(range({width * width}), lambda x: CASE WHEN x // {width} = {s} THEN g[x + 1] / g[{s * width + s + 1}] ELSE g[x + 1] - g[(x // {width}) * {width} + {s + 1}] * g[{s * width} + x % {width} + 1] / g[{s * width + s + 1}] END) AS g FROM g{s})" for s in range(m)),
        f"f0 AS (SELECT {', '.join(f'v{i}' for i in range(k))} FROM w ORDER BY idx DESC LIMIT 1)",
    ]
    for h in range(1, horizon + 1):
        ahead = (beta(0, j) + "".join(f" + {beta(i + 1, j)} * v{i}" for i in range(k)) + f" AS v{j}" for j in range(k))
        parts.append(f"f{h} AS (SELECT {', '.join(ahead)} FROM f{h - 1}, g{m})")
    rows = " UNION ALL ".join(f"SELECT '{n}' AS series_id, {h}::INT AS h, round(v{i}, 4) AS point FROM f{h}" for h in range(1, horizon + 1) for i, n in enumerate(names))
    return f"WITH {', '.join(parts)} {rows}"


@query("vector_autoregression", vector_sql(EVENT_TYPES, 5))
def vector_autoregression(spark, d):
    return rounded(multi.var_forecast(tables.daily_events(spark, d), EVENT_TYPES, 1, 5))
