"""Queries of guidance: traits, recommendation, seasons, refits, alerts, coming steps, and further imputations, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import features, guidance
from tidemark.plans.more import DAILY, ORDERS, daily, longs, rounded
from tidemark.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TRAITS = f"""{DAILY},
m AS (SELECT series_id, value AS middle FROM p QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY value) - 1 = floor(n / 2)),
o AS (SELECT series_id, abs(value - middle) AS off, n FROM p JOIN m USING (series_id)),
mad AS (SELECT series_id, off AS mad FROM o QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY off) - 1 = floor(n / 2)),
far AS (SELECT series_id, count(*) FILTER (0.6745::DOUBLE * off / CASE WHEN mad > 0 THEN mad ELSE 1e-10 END > 3.5) AS outliers FROM o JOIN mad USING (series_id) GROUP BY 1),
c AS (SELECT *, value - avg(value) OVER (PARTITION BY series_id) AS d FROM p),
b AS (SELECT *, lag(d) OVER (PARTITION BY series_id ORDER BY idx) AS b FROM c),
traits AS (SELECT series_id, count(*) AS n, abs(regr_slope(value, idx)) / stddev_pop(value) AS trend, sum(d * b) / ((count(*) - 1) * var_pop(value)) AS acf1, avg((abs(value) < 1e-10)::INT) AS zeros, stddev_pop(value) / abs(avg(value)) AS cv, any_value(outliers) AS outliers
FROM b JOIN far USING (series_id) GROUP BY 1 HAVING count(*) >= 5)"""
PEAKS = f"""{ORDERS}, q AS (SELECT value - avg(value) OVER () AS c, idx AS i, n FROM p),
a AS (SELECT l.lag, any_value(a.n) AS n, sum(a.c * b.c) / (any_value(a.n) - l.lag) / any_value(v.v) AS acf FROM q a JOIN range(1, 61) l(lag) ON true JOIN q b ON a.i = b.i + l.lag, (SELECT avg(c * c) AS v FROM q) v GROUP BY 1),
k AS (SELECT *, lag(acf) OVER (ORDER BY lag) AS before, lead(acf) OVER (ORDER BY lag) AS after FROM a),
peaks AS (SELECT lag, acf FROM k WHERE acf > before AND acf > after AND acf > greatest(0.0, 0.5 / sqrt(n)))"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _with_long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in names})


@query("traits", f"WITH {TRAITS} SELECT series_id, n, round(trend, 4) AS trend, round(acf1, 4) AS acf1, round(zeros, 4) AS zeros, round(cv, 4) AS cv, outliers FROM traits")
def traits(spark, d):
    return _with_long(rounded(guidance.traits(daily(spark, d))), "outliers")


@query(
    "recommendation",
    f"""WITH {TRAITS}, s AS (SELECT *, abs(acf1) AS season FROM traits)
SELECT series_id, CASE WHEN zeros > 0.3 THEN 'croston' WHEN season > 0.4 AND trend > 0.2 THEN 'holt_winters' WHEN season > 0.4 AND trend > 0.01 THEN 'holt' WHEN season > 0.4 THEN 'seasonal_naive' WHEN trend > 0.15 THEN 'drift'
WHEN outliers > 0.05 * n THEN 'robust_mean' WHEN cv > 1.5 THEN 'theta' ELSE 'mean' END AS method,
array_to_string(list_filter([CASE WHEN season <= 0.3 AND season > 0.2 THEN 'seasonal_naive' END, CASE WHEN season > 0.3 OR trend > 0.01 THEN 'stl' END, 'theta', 'ensemble', CASE WHEN zeros <= 0.3 AND zeros > 0.1 THEN 'boot_croston' END], lambda x: x IS NOT NULL)[1:3], ',') AS alternatives,
coalesce(nullif(concat_ws(', ', CASE WHEN season > 0.3 THEN 'strong seasonality' END, CASE WHEN trend > 0.15 THEN 'significant trend' END, CASE WHEN zeros > 0.3 THEN 'intermittent demand' END, CASE WHEN n > 100 THEN 'long history' END, CASE WHEN outliers = 0 THEN 'no outliers' END), ''), 'few signals') AS reasons,
round(least(0.95::DOUBLE, greatest(0.4::DOUBLE, 0.6::DOUBLE + CASE WHEN season > 0.5 THEN 0.1 ELSE 0 END + CASE WHEN trend > 0.3 THEN 0.1 ELSE 0 END + CASE WHEN zeros > 0.4 THEN 0.1 ELSE 0 END + CASE WHEN n > 200 THEN 0.05 ELSE 0 END + CASE WHEN n > 500 THEN 0.05 ELSE 0 END
- CASE WHEN outliers > 0.1 * n THEN 0.1 ELSE 0 END - CASE WHEN n < 30 THEN 0.1 ELSE 0 END)), 4) AS confidence FROM s""",
)
def recommendation(spark, d):
    return rounded(guidance.recommendation(guidance.traits(daily(spark, d))))


@query(
    "starting_weights",
    f"""WITH {TRAITS}, w AS (SELECT *, CASE WHEN cv > 1.5 THEN 1.0::DOUBLE ELSE 0.7 END AS calm FROM traits)
SELECT series_id, round(0.3::DOUBLE * calm, 4) AS alpha, round(CASE WHEN trend > 0.3 THEN least(0.5::DOUBLE, 0.13::DOUBLE * calm) ELSE 0.1::DOUBLE * calm END, 4) AS beta, round(CASE WHEN abs(acf1) > 0.3 THEN least(1.0::DOUBLE, 0.3::DOUBLE * (1 + abs(acf1))) ELSE 0.3::DOUBLE END, 4) AS gamma FROM w""",
)
def starting_weights(spark, d):
    return rounded(guidance.starting_weights(guidance.traits(daily(spark, d))))


@query(
    "auto_seasons",
    f"""WITH RECURSIVE {PEAKS}, chain AS (SELECT lag AS season, lag AS at, 1 AS k FROM peaks UNION ALL SELECT season, peaks.lag, k + 1 FROM chain JOIN peaks ON peaks.lag * 2 = chain.at)
SELECT 'orders' AS series_id, CAST(season AS INT) AS season FROM chain GROUP BY season HAVING max(k) % 2 = 1""",
)
def auto_seasons(spark, d):
    return guidance.auto_seasons(tables.daily_orders(spark, d), 60, 2, 0.0, 0.5)


@query(
    "seasonal_methods",
    f"""WITH {PEAKS}, t AS (SELECT count(*) AS k, max(acf) AS acf, arg_max(lag, acf) AS season FROM peaks HAVING count(*) > 0)
SELECT 'orders' AS series_id, concat_ws(',', 'naive', 'theta', CASE WHEN k >= 2 THEN 'stl,ms_holt_winters,fourier_arima' ELSE concat_ws(',', CASE WHEN acf > 0.8 THEN 'seasonal_naive,holt_winters' END, CASE WHEN acf > 0.8 AND season > 20 THEN 'snaive' END, 'stl') END) AS methods FROM t""",
)
def seasonal_methods(spark, d):
    return guidance.seasonal_methods(features.seasonal_lags(tables.daily_orders(spark, d), 60, 0.0, 0.5).withColumnRenamed("lag", "season"))


@query(
    "refresh_reasons",
    f"""WITH {DAILY}, z AS (SELECT *, idx - 9 AS since, abs(avg(value) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) - avg(value) OVER (w ROWS UNBOUNDED PRECEDING)) / nullif(stddev_samp(value) OVER (w ROWS UNBOUNDED PRECEDING), 0) AS z FROM p WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
r AS (SELECT *, CASE WHEN since < 0 THEN 'insufficient-data' WHEN since = 0 THEN 'no-fit' WHEN since % 5 <> 0 THEN 'below-threshold' WHEN idx >= 19 AND round(z, 9) > 0.2 THEN 'drift' ELSE 'new-points' END AS reason FROM z)
SELECT series_id, idx, reason IN ('no-fit', 'drift', 'new-points') AS refresh, reason FROM r""",
)
def refresh_reasons(spark, d):
    return longs(guidance.refresh_decisions(daily(spark, d), every=5, recent=10, threshold=0.2), "idx")


@query(
    "anomaly_alerts",
    f"""WITH {DAILY}, z AS (SELECT *, count(value) OVER w AS seen, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM p WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT series_id, idx, round(value, 4) AS value, round(z, 4) AS z FROM z WHERE seen >= 5 AND abs(z) > 1.5""",
)
def anomaly_alerts(spark, d):
    return longs(rounded(guidance.anomaly_alerts(daily(spark, d), 1.5)), "idx")


@query(
    "future_steps",
    f"""WITH {ORDERS}, s AS (SELECT series_id, epoch_ms(t) - epoch_ms(lag(t) OVER (PARTITION BY series_id ORDER BY idx)) AS d, t FROM p), m AS (SELECT series_id, mode(d) AS step, max(t) AS last FROM s GROUP BY 1)
SELECT series_id, h, epoch_ms(last) + h * step AS t_ms, CASE WHEN step < 43200000 THEN strftime(make_timestamp((epoch_ms(last) + h * step) * 1000), '%Y-%m-%d %H:%M') ELSE strftime(make_timestamp((epoch_ms(last) + h * step) * 1000), '%Y-%m-%d') END AS label FROM m, range(1, 15) r(h)""",
)
def future_steps(spark, d):
    f = guidance.future_steps(tables.daily_orders(spark, d), 14)
    return f.select("series_id", F.col("h").cast("bigint").alias("h"), F.unix_millis("t").alias("t_ms"), "label")
