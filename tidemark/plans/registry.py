"""Registered queries with their DuckDB SQL.

Doubles are rounded on both sides: engines add in different orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluate, guidance, models, prepare, quality
from tidemark.plans import designs, further, graphs, guide, latest, more, scales, states, wider
from tidemark.functions.stats import norm_cdf_sql
from tidemark.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DAILY = """
ev AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS t, sum(value) AS value FROM events GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM ev)
"""
ORDERS = """
od AS (SELECT 'orders' AS series_id, CAST(o_orderdate AS DATE) AS t, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM od)
"""


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """All doubles of ``df`` rounded."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _r(sql: str, digits: int = 4) -> str:
    return f"round({sql}, {digits})"


@query("series_daily", f"WITH {DAILY} SELECT series_id, CAST(t AS VARCHAR) AS t, round(value, 4) AS value, idx FROM p")
def series_daily(spark, d):
    return rounded(tables.daily_events(spark, d).select("series_id", F.col("t").cast("string").alias("t"), "value", F.col("idx").cast("bigint").alias("idx")))


@query(
    "dominant_step",
    """WITH h AS (SELECT DISTINCT event_type AS series_id, date_trunc('hour', ts) AS t FROM events),
s AS (SELECT series_id, t, epoch_ms(t) - epoch_ms(lag(t) OVER (PARTITION BY series_id ORDER BY t)) AS d FROM h),
c AS (SELECT series_id, d, count(*) AS n, min(t) AS first FROM s WHERE d > 0 GROUP BY 1, 2)
SELECT series_id, d AS step_ms FROM c QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY n DESC, first) = 1""",
)
def dominant_step(spark, d):
    hours = tables.table(spark, d, "events").select(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("t")).distinct()
    return prepare.dominant_step(tables.indexed(hours))


@query(
    "resample_weekly",
    f"""WITH {ORDERS}, b AS (SELECT *, CAST(floor((epoch_ms(t) - min(epoch_ms(t)) OVER (PARTITION BY series_id)) / 604800000.0) AS BIGINT) AS bin FROM p)
SELECT series_id, bin, round(avg(value), 4) AS mean, round(sum(value), 4) AS sum, round(arg_min(value, idx), 4) AS first, round(arg_max(value, idx), 4) AS last,
round(min(value), 4) AS min, round(max(value), 4) AS max, count(*) AS n FROM b GROUP BY 1, 2""",
)
def resample_weekly(spark, d):
    return rounded(prepare.resample(tables.daily_orders(spark, d), 7 * 86_400_000))


@query(
    "series_summary",
    f"""WITH {DAILY}, s AS (SELECT *, epoch_ms(t) - epoch_ms(lag(t) OVER (PARTITION BY series_id ORDER BY idx)) AS d FROM p),
c AS (SELECT series_id, d, count(*) AS k, min(idx) AS f FROM s WHERE d > 0 GROUP BY 1, 2),
m AS (SELECT series_id, d AS step_ms FROM c QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY k DESC, f) = 1)
SELECT series_id, count(*) AS n, CAST(min(t) AS VARCHAR) AS first_t, CAST(max(t) AS VARCHAR) AS last_t, round(avg(value), 4) AS mean, round(median(value), 4) AS median,
count(*) FILTER (d <= 0) AS duplicates, any_value(step_ms) AS step_ms, count(*) FILTER (d > 1.5 * step_ms) AS gaps FROM s JOIN m USING (series_id) GROUP BY 1""",
)
def series_summary(spark, d):
    return rounded(prepare.summary(tables.daily_events(spark, d)).withColumns({c: F.col(c).cast("string") for c in ("first_t", "last_t")}))


@query(
    "detrend",
    f"""WITH {DAILY} SELECT series_id, idx, round(value - (avg(value) OVER w + regr_slope(value, idx) OVER w * (idx - avg(idx) OVER w)), 4) AS detrended FROM p WINDOW w AS (PARTITION BY series_id)""",
)
def detrend(spark, d):
    return rounded(prepare.detrended(tables.daily_events(spark, d)).select("series_id", F.col("idx").cast("bigint").alias("idx"), "detrended"))


@query(
    "deseason",
    f"""WITH {DAILY}, d AS (SELECT series_id, idx, value, value - (avg(value) OVER w + regr_slope(value, idx) OVER w * (idx - avg(idx) OVER w)) AS r FROM p WINDOW w AS (PARTITION BY series_id))
SELECT series_id, idx, round(value - (avg(r) OVER (PARTITION BY series_id, idx % 7) - sum(r) OVER (PARTITION BY series_id) / 7), 4) AS deseasonalised FROM d""",
)
def deseason(spark, d):
    return rounded(prepare.deseasonalised(tables.daily_events(spark, d), 7).select("series_id", F.col("idx").cast("bigint").alias("idx"), "deseasonalised"))


@query(
    "decay_weighted",
    f"""WITH {DAILY}, w AS (SELECT *, pow(0.95, n - idx - 1) AS w FROM p), m AS (SELECT series_id, sum(w * value) / sum(w) AS mean FROM w GROUP BY 1)
SELECT w.series_id, round(any_value(mean), 4) AS mean, round(sum(w * pow(value - mean, 2)) / sum(w), 2) AS variance, round(ln(0.5) / ln(0.95), 4) AS half_life FROM w JOIN m USING (series_id) GROUP BY 1""",
)
def decay_weighted(spark, d):
    return rounded(prepare.decay_weighted(tables.daily_events(spark, d), 0.95).withColumn("variance", F.round("variance", 2)))


@query(
    "floor_quantiles",
    f"""WITH {DAILY}, a AS (SELECT series_id, list(value ORDER BY value) AS v, count(*) AS n FROM p GROUP BY 1)
SELECT series_id, round(v[CAST(floor(n * 0.05) AS INT) + 1], 4) AS q5, round(v[CAST(floor(n * 0.5) AS INT) + 1], 4) AS q50, round(v[CAST(floor(n * 0.95) AS INT) + 1], 4) AS q95 FROM a""",
)
def floor_quantiles(spark, d):
    return rounded(prepare.floor_quantile(tables.daily_events(spark, d), 0.05, 0.5, 0.95))


@query(
    "autocorrelation",
    f"""WITH {ORDERS}, c AS (SELECT series_id, idx, value - avg(value) OVER (PARTITION BY series_id) AS c FROM p)
SELECT a.series_id, l.lag, round(sum(a.c * b.c) / any_value(t.total), 6) AS acf
FROM c a JOIN c b ON a.series_id = b.series_id JOIN range(1, 15) l(lag) ON a.idx = b.idx + l.lag JOIN (SELECT series_id, sum(c * c) AS total FROM c GROUP BY 1) t ON t.series_id = a.series_id GROUP BY 1, 2""",
)
def autocorrelation(spark, d):
    return rounded(prepare.autocorrelation(tables.daily_orders(spark, d), 14), 6).withColumn("lag", F.col("lag").cast("bigint"))


_SIMPLE = f"""
f AS (SELECT series_id, any_value(n) AS n, arg_max(value, idx) AS last, arg_min(value, idx) AS first, avg(value) AS mean, regr_slope(value, idx) AS slope, regr_intercept(value, idx) AS icept FROM p GROUP BY 1),
e AS (SELECT p.series_id, p.n, idx, value, value - lag(value) OVER (PARTITION BY p.series_id ORDER BY idx) AS e1, value - lag(value, 7) OVER (PARTITION BY p.series_id ORDER BY idx) AS e7,
      value - mean AS em, value - (first + (last - first) / (p.n - 1) * idx) AS ed, value - (icept + slope * idx) AS el FROM p JOIN f USING (series_id)),
g AS (SELECT series_id, sqrt(sum(e1 * e1) / greatest(any_value(n) - 1, 1)) AS s_naive, sqrt(sum(e7 * e7) / greatest(any_value(n) - 7, 1)) AS s_snaive, sqrt(sum(em * em) / greatest(any_value(n) - 1, 1)) AS s_mean,
      sqrt(sum(ed * ed) / greatest(any_value(n) - 1, 1)) AS s_drift, sqrt(sum(el * el) / greatest(any_value(n) - 2, 1)) AS s_linear FROM e GROUP BY 1),
fc AS (
  SELECT series_id, 'naive' AS method, h, last AS point, s_naive AS s FROM f JOIN g USING (series_id), range(1, 8) r(h)
  UNION ALL SELECT series_id, 'mean', h, mean, s_mean FROM f JOIN g USING (series_id), range(1, 8) r(h)
  UNION ALL SELECT series_id, 'drift', h, last + h * (last - first) / (n - 1), s_drift FROM f JOIN g USING (series_id), range(1, 8) r(h)
  UNION ALL SELECT series_id, 'linear', h, icept + slope * (n - 1 + h), s_linear FROM f JOIN g USING (series_id), range(1, 8) r(h)
  UNION ALL SELECT p.series_id, 'snaive', h, value, s_snaive FROM p JOIN g USING (series_id) JOIN range(1, 8) r(h) ON idx = n - 7 + (h - 1) % 7
)"""


@query("forecast_simple", f"WITH {DAILY}, {_SIMPLE} SELECT series_id, method, h, round(point, 4) AS point, round(point - 1.2816 * s * sqrt(h), 4) AS lower, round(point + 1.2816 * s * sqrt(h), 4) AS upper FROM fc")
def forecast_simple(spark, d):
    f = models.forecast(tables.daily_events(spark, d), 7, season=7, methods=("naive", "snaive", "mean", "drift", "linear"))
    return rounded(f).withColumn("h", F.col("h").cast("bigint"))


_HOLT = """
grid AS (SELECT a / 10.0::DOUBLE AS alpha, b / 10.0::DOUBLE AS beta FROM range(1, 10) x(a), range(1, 10) y(b)),
r AS (
  SELECT p.series_id, alpha, beta, 0::BIGINT AS idx, p.n, p.value AS level, q.value - p.value AS trend, 0::DOUBLE AS sse FROM p JOIN p q ON p.series_id = q.series_id AND p.idx = 0 AND q.idx = 1, grid
  UNION ALL
  SELECT r.series_id, alpha, beta, p.idx, p.n, alpha * p.value + (1 - alpha) * (level + trend),
         beta * (alpha * p.value + (1 - alpha) * (level + trend) - level) + (1 - beta) * trend, sse + pow(p.value - level - trend, 2)
  FROM r JOIN p ON p.series_id = r.series_id AND p.idx = r.idx + 1
), best AS (SELECT * FROM r WHERE idx = n - 1 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY sse, alpha, beta) = 1)"""


@query("holt_fit", f"WITH RECURSIVE {DAILY}, {_HOLT} SELECT series_id, round(alpha, 2) AS alpha, round(beta, 2) AS beta, round(sqrt(sse / (n - 3)), 4) AS sigma, round(level, 4) AS level, round(trend, 4) AS trend FROM best")
def holt_fit(spark, d):
    f = models.holt_fits(tables.daily_events(spark, d))
    return rounded(f.select("series_id", F.round("alpha", 2).alias("alpha"), F.round("beta", 2).alias("beta"), F.sqrt(F.col("sse") / (F.col("n") - 3)).alias("sigma"), "level", "trend"))


@query(
    "holt_damped",
    f"""WITH RECURSIVE {DAILY},
grid AS (SELECT a / 10.0::DOUBLE AS alpha, b / 10.0::DOUBLE AS beta, CAST(phi AS DOUBLE) AS phi FROM range(1, 10) x(a), range(1, 10) y(b), (SELECT unnest([0.3, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.98]) AS phi)),
r AS (
  SELECT p.series_id, alpha, beta, phi, 0::BIGINT AS idx, p.n, p.value AS level, q.value - p.value AS trend, 0::DOUBLE AS sse FROM p JOIN p q ON p.series_id = q.series_id AND p.idx = 0 AND q.idx = 1, grid
  UNION ALL
  SELECT r.series_id, alpha, beta, phi, p.idx, p.n, alpha * p.value + (1 - alpha) * (level + phi * trend),
         beta * (alpha * p.value + (1 - alpha) * (level + phi * trend) - level) + (1 - beta) * phi * trend, sse + pow(p.value - level - phi * trend, 2)
  FROM r JOIN p ON p.series_id = r.series_id AND p.idx = r.idx + 1
), best AS (SELECT *, sqrt(sse / greatest(n - 4, 1)) AS sigma FROM r WHERE idx = n - 1 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY sse, alpha, beta, phi) = 1),
f AS (SELECT *, level + trend * phi * (1 - pow(phi, h)) / (1 - phi) AS point FROM best, range(1, 8) s(h))
SELECT series_id, 'holt_damped' AS method, CAST(h AS INT) AS h, round(point, 4) AS point, round(point - 1.2816 * sigma * sqrt(h), 4) AS lower, round(point + 1.2816 * sigma * sqrt(h), 4) AS upper FROM f WHERE n >= 4""",
)
def holt_damped(spark, d):
    return rounded(models.forecast(tables.daily_events(spark, d), 7, methods=("holt_damped",)))


@query("holt_winters")
def holt_winters(spark, d):
    return rounded(models.holt_winters(tables.daily_events(spark, d), 7, 14))


@query(
    "theta",
    f"""WITH {DAILY}, a AS (SELECT *, lag(value) OVER w + 0.25 * CASE WHEN idx >= 2 THEN regr_slope(value, idx) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS ahead FROM p WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
f AS (SELECT series_id, regr_slope(value, idx) AS slope, arg_max(value, idx) AS last, sqrt(avg(pow(value - ahead, 2)) FILTER (idx >= 2)) AS sigma FROM a GROUP BY 1)
SELECT series_id, h, round(last + 0.25 * slope * h, 4) AS point, round(last + 0.25 * slope * h - 1.2816 * sigma * sqrt(h), 4) AS lower, round(last + 0.25 * slope * h + 1.2816 * sigma * sqrt(h), 4) AS upper FROM f, range(1, 8) r(h)""",
)
def theta(spark, d):
    return rounded(models.theta(tables.daily_events(spark, d), 7)).withColumn("h", F.col("h").cast("bigint"))


def _demand(spark, d):
    """Quantity of each part on the days of its shipments, by number of day; other days have no row. Dealt by part once, before the sums."""
    line = tables.table(spark, d, "lineitem").select(F.col("l_partkey").alias("series_id"), F.unix_date(F.to_date("l_shipdate")).alias("idx"), "l_quantity")
    per = line.filter("idx IS NOT NULL").repartition("series_id").groupBy("series_id", "idx").agg(F.sum("l_quantity").alias("q"))
    # lines without a part have days, but no quantity
    return per.select("series_id", "idx", F.when(F.col("series_id").isNotNull(), F.coalesce("q", F.lit(0.0))).otherwise(0.0).alias("value"))


_DEMAND = """
per AS (SELECT CAST(l_partkey AS VARCHAR) AS series_id, CAST(l_shipdate AS DATE) AS t, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
days AS (SELECT series_id, CAST(unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) AS DATE) AS t FROM per GROUP BY 1),
p AS (SELECT series_id, t, coalesce(q, 0.0) AS value, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM days LEFT JOIN per USING (series_id, t))"""


@query(
    "croston",
    f"""WITH {_DEMAND}, l AS (SELECT *, count(*) FILTER (value > 0) OVER (PARTITION BY series_id ORDER BY idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later FROM p),
g AS (SELECT series_id, arg_min(value, idx) AS first, count(*) FILTER (value > 0) AS m, any_value(n) AS n, coalesce(sum(0.5 * pow(0.5, later) * value) FILTER (value > 0), 0) AS q, coalesce(sum(0.2::DOUBLE * pow(0.8, later) * value) FILTER (value > 0), 0) AS tq,
coalesce(sum(0.2::DOUBLE * pow(0.8, n - 1 - idx)) FILTER (value > 0), 0) AS tp FROM l GROUP BY 1)
SELECT series_id, round(first * pow(0.5, m) + q, 4) AS demand, round((first * pow(0.8, m) + tq) * (0.5 * pow(0.8, n) + tp), 4) AS tsb FROM g""",
)
def croston(spark, d):
    return rounded(models.croston(_demand(spark, d))).withColumn("series_id", F.col("series_id").cast("string"))


@query(
    "box_cox_lambda",
    f"""WITH {DAILY}, g AS (SELECT p.*, k, k / 10.0 AS l FROM p, range(-20, 21) r(k)),
s AS (SELECT series_id, k, l, round(-count(*) / 2.0 * ln(var_pop(CASE WHEN k = 0 THEN ln(value) ELSE (pow(value, l) - 1) / l END)) + (l - 1) * sum(ln(value)), 6) AS score FROM g GROUP BY 1, 2, 3)
SELECT series_id, CAST(l AS DOUBLE) AS lambda FROM s QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY score DESC, k) = 1""",
)
def box_cox_lambda(spark, d):
    return models.box_cox_lambda(tables.daily_events(spark, d))


_TRAIN = DAILY.replace("p AS (SELECT", "whole AS (SELECT") + ", p AS (SELECT series_id, t, value, idx, n - 7 AS n FROM whole WHERE idx < n - 7)"


@query(
    "backtest",
    f"""WITH RECURSIVE {_TRAIN}, {_SIMPLE}, {_HOLT}, every AS (
  SELECT series_id, method, h, point FROM fc UNION ALL SELECT series_id, 'holt', h, level + h * trend FROM best, range(1, 8) r(h)),
x AS (SELECT series_id, method, value AS a, point AS f FROM every JOIN (SELECT series_id, idx - (n - 7) + 1 AS h, value FROM whole WHERE idx >= n - 7) USING (series_id, h)),
nv AS (SELECT series_id, avg(abs(e1)) AS naive FROM e GROUP BY 1),
m AS (SELECT series_id, method, avg(abs(a - f)) AS mae, sqrt(avg(pow(a - f, 2))) AS rmse, 100 * avg(abs(a - f) / nullif(abs(a), 0)) AS mape,
  100 * sum(coalesce(abs(a - f) / nullif((abs(a) + abs(f)) / 2, 0), 0)) / count(*) AS smape FROM x GROUP BY 1, 2)
SELECT series_id, method, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(mape, 4) AS mape, round(smape, 4) AS smape, round(mae / nullif(naive, 0), 4) AS mase,
row_number() OVER (PARTITION BY series_id ORDER BY round(rmse, 6), list_position(['naive', 'snaive', 'mean', 'drift', 'linear', 'holt'], method)) AS rank FROM m JOIN nv USING (series_id)""",
)
def backtest(spark, d):
    return rounded(evaluate.backtest(tables.daily_events(spark, d), 7, season=7)).withColumn("rank", F.col("rank").cast("bigint"))


def _rolling(spark, d):
    return evaluate.rolling_origin(tables.daily_events(spark, d), 4, 5)


_FOLDS = """
k AS (SELECT p.*, fold, (fold + 1) * 5 AS cut FROM p, range(0, 4) r(fold)),
f AS (SELECT series_id, fold, any_value(cut) AS n, arg_max(value, idx) AS last, arg_min(value, idx) AS first, avg(value) AS mean, regr_slope(value, idx) AS slope, regr_intercept(value, idx) AS icept FROM k WHERE idx < cut GROUP BY 1, 2),
e AS (SELECT series_id, fold, f.n, value - lag(value) OVER (PARTITION BY series_id, fold ORDER BY idx) AS e1, value - mean AS em, value - (first + (last - first) / (f.n - 1) * idx) AS ed, value - (icept + slope * idx) AS el FROM k JOIN f USING (series_id, fold) WHERE idx < cut),
s AS (SELECT series_id, fold, sqrt(sum(e1 * e1) / (any_value(n) - 1)) AS s1, sqrt(sum(em * em) / (any_value(n) - 1)) AS sm, sqrt(sum(ed * ed) / (any_value(n) - 1)) AS sd, sqrt(sum(el * el) / (any_value(n) - 2)) AS sl FROM e GROUP BY 1, 2),
t AS (SELECT series_id, fold, value AS a, idx - cut + 1 AS h FROM k WHERE idx >= cut AND idx < cut + 5),
x AS (SELECT series_id, fold, a, h, unnest(['naive', 'mean', 'drift', 'linear']) AS method, unnest([last, mean, last + h * (last - first) / (n - 1), icept + slope * (n - 1 + h)]) AS f, unnest([s1, sm, sd, sl]) AS sg FROM t JOIN f USING (series_id, fold) JOIN s USING (series_id, fold)),
m AS (SELECT series_id, fold, method, avg(abs(a - f)) AS mae, sqrt(avg(pow(a - f, 2))) AS rmse, 100 * avg(abs(a - f) / nullif(abs(a), 0)) AS mape, 100 * sum(coalesce(abs(a - f) / nullif((abs(a) + abs(f)) / 2, 0), 0)) / count(*) AS smape,
  100 * avg(CASE WHEN a BETWEEN f - 1.2816 * sg * sqrt(h) AND f + 1.2816 * sg * sqrt(h) THEN 1.0 ELSE 0.0 END) AS coverage FROM x GROUP BY 1, 2, 3)"""


@query("rolling_origin", f"WITH {DAILY}, {_FOLDS} SELECT series_id, CAST(fold AS INT) AS fold, method, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(mape, 4) AS mape, round(smape, 4) AS smape, round(coverage, 4) AS coverage FROM m")
def rolling_origin(spark, d):
    return rounded(_rolling(spark, d))


@query(
    "fold_report",
    f"""WITH {DAILY}, {_FOLDS}, sc AS (SELECT series_id, fold, avg(abs(e1)) AS scale FROM e GROUP BY 1, 2),
r AS (SELECT series_id, method, count(*) AS folds, avg(rmse) AS rmse, coalesce(stddev_samp(rmse), 0) AS rmse_sd, avg(mae) AS mae, coalesce(stddev_samp(mae), 0) AS mae_sd, avg(mape) AS mape, avg(mae / nullif(scale, 0)) AS mase, avg(coverage) AS coverage FROM m LEFT JOIN sc USING (series_id, fold) GROUP BY 1, 2)
SELECT series_id, method, folds, round(rmse, 4) AS rmse, round(rmse_sd, 4) AS rmse_sd, round(mae, 4) AS mae, round(mae_sd, 4) AS mae_sd, round(mape, 4) AS mape, round(mase, 4) AS mase, 80.0::DOUBLE AS promised, round(coverage, 4) AS coverage,
row_number() OVER (PARTITION BY series_id ORDER BY round(rmse, 6), list_position(['naive', 'mean', 'drift', 'linear'], method)) AS rank FROM r""",
)
def fold_report(spark, d):
    return rounded(evaluate.fold_report(tables.daily_events(spark, d), 4, 5)).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "diebold_mariano",
    f"""WITH {DAILY}, {_FOLDS}, d AS (SELECT a.series_id, a.method AS method_a, b.method AS method_b, count(*) AS n, avg(a.rmse - b.rmse) AS mean_diff, stddev_samp(a.rmse - b.rmse) AS sd
FROM m a JOIN m b ON a.series_id = b.series_id AND a.fold = b.fold AND a.method < b.method GROUP BY 1, 2, 3),
st AS (SELECT *, CASE WHEN abs(mean_diff) < 1e-6 THEN 0.0 ELSE mean_diff / (sd / sqrt(n)) END AS statistic FROM d)
SELECT series_id, method_a, method_b, n, round(mean_diff, 4) AS mean_diff, round(statistic, 4) AS statistic, round(2 * (1 - {norm_cdf_sql("abs(statistic)")}), 4) AS p_value FROM st""",
)
def diebold_mariano(spark, d):
    return rounded(evaluate.diebold_mariano(_rolling(spark, d)))


@query(
    "ljung_box",
    f"""WITH {DAILY}, c AS (SELECT series_id, idx, n, value - avg(value) OVER (PARTITION BY series_id) AS c FROM p),
a AS (SELECT a.series_id, l.lag, any_value(a.n) AS n, sum(a.c * b.c) / any_value(t.total) AS acf FROM c a JOIN c b ON a.series_id = b.series_id JOIN range(1, 8) l(lag) ON a.idx = b.idx + l.lag JOIN (SELECT series_id, sum(c * c) AS total FROM c GROUP BY 1) t ON t.series_id = a.series_id GROUP BY 1, 2),
q AS (SELECT series_id, sum(acf * acf * (n + 2) * (n + 1) / ((n - lag) * lag)) AS statistic FROM a GROUP BY 1),
z AS (SELECT *, (pow(statistic / 7, 1 / 3.0) - (1 - 2 / 63.0)) / sqrt(2 / 63.0) AS z FROM q)
SELECT series_id, round(statistic, 4) AS statistic, round(1 - {norm_cdf_sql("z")}, 4) AS p_value FROM z""",
)
def ljung_box(spark, d):
    return rounded(evaluate.ljung_box(tables.daily_events(spark, d), 7))


@query(
    "zscore_outliers",
    f"""WITH {ORDERS}, z AS (SELECT series_id, idx, value, abs(value - avg(value) OVER w) / stddev_pop(value) OVER w AS score FROM p WINDOW w AS (PARTITION BY series_id))
SELECT series_id, idx, round(value, 4) AS value, round(score, 4) AS score, round(least(0.95, exp(-2 / score)), 4) AS confidence FROM z WHERE score > 2.5""",
)
def zscore_outliers(spark, d):
    return rounded(quality.zscore_outliers(tables.daily_orders(spark, d))).withColumn("idx", F.col("idx").cast("bigint"))


@query(
    "iqr_outliers",
    f"""WITH {ORDERS}, a AS (SELECT series_id, list(value ORDER BY value) AS v, count(*) AS k FROM p GROUP BY 1),
q AS (SELECT series_id, v[CAST(floor(k * 0.25) AS INT) + 1] AS q1, v[CAST(floor(k * 0.75) AS INT) + 1] AS q3 FROM a)
SELECT series_id, idx, round(value, 4) AS value, round(q1 - 1.5 * (q3 - q1), 4) AS low, round(q3 + 1.5 * (q3 - q1), 4) AS high FROM p JOIN q USING (series_id) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
)
def iqr_outliers(spark, d):
    return rounded(quality.iqr_outliers(tables.daily_orders(spark, d))).withColumn("idx", F.col("idx").cast("bigint"))


@query(
    "mad_outliers",
    f"""WITH {ORDERS}, a AS (SELECT *, median(value) OVER (PARTITION BY series_id) AS med FROM p), b AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY series_id) AS mad FROM a)
SELECT series_id, idx, round(value, 4) AS value, round(0.6745 * abs(value - med) / mad, 4) AS score FROM b WHERE 0.6745 * abs(value - med) / mad > 2.5""",
)
def mad_outliers(spark, d):
    return rounded(quality.mad_outliers(tables.daily_orders(spark, d), 2.5)).withColumn("idx", F.col("idx").cast("bigint"))


@query(
    "hampel_outliers",
    f"""WITH {DAILY}, a AS (SELECT a.series_id, a.idx, any_value(a.value) AS value, median(b.value) AS median, list(b.value) AS near FROM p a JOIN p b ON a.series_id = b.series_id AND b.idx BETWEEN a.idx - 5 AND a.idx + 5 AND a.idx <> b.idx GROUP BY 1, 2),
m AS (SELECT series_id, idx, value, median, list_median(list_transform(near, lambda x: abs(x - median))) AS mad FROM a)
SELECT series_id, idx, round(value, 4) AS value, round(median, 4) AS median, round(mad, 4) AS mad FROM m WHERE abs(value - median) > 1.5 * greatest(1.4826 * mad, 1e-9 * greatest(abs(median), 1.0))""",
)
def hampel_outliers(spark, d):
    return rounded(quality.hampel_outliers(tables.daily_events(spark, d), 5, 1.5)).withColumn("idx", F.col("idx").cast("bigint"))


@query(
    "trend_shifts",
    f"""WITH {DAILY}, a AS (SELECT *, greatest(5, CAST(floor(n / 10) AS BIGINT)) AS w, stddev_pop(value) OVER (PARTITION BY series_id) AS sd FROM p),
s AS (SELECT a.series_id, a.idx, any_value(a.sd) AS sd, avg(b.value) FILTER (b.idx < a.idx) AS before, avg(b.value) FILTER (b.idx >= a.idx) AS after
FROM a JOIN a b ON a.series_id = b.series_id AND b.idx >= a.idx - a.w AND b.idx < a.idx + a.w WHERE a.idx >= a.w AND a.idx < a.n - a.w GROUP BY 1, 2)
SELECT series_id, idx, round(before, 4) AS before, round(after, 4) AS after, round(after - before, 4) AS magnitude FROM s WHERE abs(after - before) > 0.5 * sd""",
)
def trend_shifts(spark, d):
    return rounded(quality.trend_shifts(tables.daily_events(spark, d))).withColumn("idx", F.col("idx").cast("bigint"))


@query(
    "outlier_clusters",
    f"""WITH {ORDERS}, f AS (SELECT series_id, idx FROM p QUALIFY abs(value - avg(value) OVER (PARTITION BY series_id)) > 1.0 * stddev_pop(value) OVER (PARTITION BY series_id)),
r AS (SELECT series_id, idx, idx - row_number() OVER (PARTITION BY series_id ORDER BY idx) AS run FROM f)
SELECT series_id, min(idx) AS first, max(idx) AS last, count(*) AS size FROM r GROUP BY series_id, run HAVING count(*) >= 2""",
)
def outlier_clusters(spark, d):
    out = quality.outlier_clusters(tables.daily_orders(spark, d), 1.0)
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("first", "last")})


def _holes(spark, d):
    """Hourly events of which hours without events are null."""
    ev = tables.table(spark, d, "events")
    per = ev.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("t")).agg(F.sum("value").alias("value"))
    hours = per.groupBy("series_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).select("series_id", F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("t"))
    return tables.indexed(hours.join(per, ["series_id", "t"], "left"))


_HOLES = """
per AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS t, sum(value) AS value FROM events GROUP BY 1, 2),
hours AS (SELECT series_id, unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) AS t FROM per GROUP BY 1),
p AS (SELECT series_id, t, value, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS idx FROM hours LEFT JOIN per USING (series_id, t))"""


@query(
    "missing_runs",
    f"""WITH {_HOLES}, r AS (SELECT series_id, idx, idx - row_number() OVER (PARTITION BY series_id ORDER BY idx) AS run FROM p WHERE value IS NULL)
SELECT series_id, min(idx) AS first, max(idx) AS last, count(*) AS duration, CASE WHEN count(*) <= 2 THEN 'scattered_hole' ELSE 'complete_time_gap' END AS kind FROM r GROUP BY series_id, run""",
)
def missing_runs(spark, d):
    return quality.missing_runs(_holes(spark, d)).withColumns({c: F.col(c).cast("bigint") for c in ("first", "last")})


@query("coverage", f"WITH {_HOLES} SELECT series_id, count(*) FILTER (value IS NULL) AS missing, round(100.0 * count(value) / count(*), 2) AS coverage FROM p GROUP BY 1")
def coverage(spark, d):
    return quality.coverage(_holes(spark, d))


@query(
    "impute_linear",
    f"""WITH {_HOLES}, l AS (SELECT series_id, idx, value, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
first_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM p)
SELECT series_id, idx, round(coalesce(value, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END), 4) AS value FROM l""",
)
def impute_linear(spark, d):
    return rounded(quality.impute(_holes(spark, d)).select("series_id", F.col("idx").cast("bigint").alias("idx"), "value"))


@query("impute_seasonal", f"WITH {_HOLES} SELECT series_id, idx, round(coalesce(value, avg(value) OVER (PARTITION BY series_id, idx % 24)), 4) AS value FROM p")
def impute_seasonal(spark, d):
    return rounded(quality.impute(_holes(spark, d), "seasonal", 24).select("series_id", F.col("idx").cast("bigint").alias("idx"), "value"))


@query(
    "season_breaks",
    f"""WITH {DAILY}, b AS (SELECT series_id, idx // 7 AS block, idx % 7 AS phase, value FROM p),
r AS (SELECT a.series_id, a.block, corr(a.value, b.value) AS r, count(*) AS n FROM b a JOIN b ON a.series_id = b.series_id AND b.block = a.block + 1 AND a.phase = b.phase GROUP BY 1, 2)
SELECT series_id, block, round(r, 4) AS r FROM r WHERE n = 7 AND r < 0.7""",
)
def season_breaks(spark, d):
    return rounded(quality.season_breaks(tables.daily_events(spark, d)))


@query(
    "business_metrics",
    f"""WITH {DAILY}, x AS (SELECT series_id, idx, value, lag(value) OVER w AS point FROM p WINDOW w AS (PARTITION BY series_id ORDER BY idx)), y AS (SELECT * FROM x WHERE point IS NOT NULL),
z AS (SELECT *, lag(value) OVER w AS pv, lag(point) OVER w AS pp, avg(value) OVER (PARTITION BY series_id) AS av, abs(value - point) AS e, pow(0.9, idx) AS w FROM y WINDOW w AS (PARTITION BY series_id ORDER BY idx))
SELECT series_id, round(100 * sum(w * e / abs(value)) / sum(w), 4) AS weighted_mape, round(100 * avg(CASE WHEN e / abs(value) <= 1 - 0.9 THEN 1.0 ELSE 0.0 END), 4) AS service_level, round(avg(e) FILTER (value >= av * 1.05), 4) AS peak_mae,
round(100 * avg(CASE WHEN (value > pv) = (point > pp) THEN 1.0 ELSE 0.0 END) FILTER (pv IS NOT NULL), 4) AS direction, round(avg(CASE WHEN point > value THEN e ELSE 2 * e END), 4) AS cost FROM z GROUP BY 1""",
)
def business_metrics(spark, d):
    from pyspark.sql import Window

    p = tables.daily_events(spark, d)
    pairs = p.withColumn("point", F.lag("value").over(Window.partitionBy("series_id").orderBy("idx"))).filter("point is not null")
    return rounded(evaluate.business_metrics(pairs, top=1.05))


_AHEAD = "SELECT series_id, method, h, point, s FROM fc WHERE method <> 'snaive' UNION ALL SELECT series_id, 'holt', h, level + h * trend, sqrt(sse / greatest(n - 3, 1)) FROM best, range(1, 8) r(h)"
_FIVE = f"""five AS (WITH RECURSIVE {DAILY}, {_SIMPLE}, {_HOLT} {_AHEAD}), early AS (WITH RECURSIVE {_TRAIN}, {_SIMPLE}, {_HOLT} {_AHEAD}), {DAILY},
x AS (SELECT series_id, method, sqrt(avg(pow(value - point, 2))) AS rmse FROM early JOIN (SELECT series_id, idx - (n - 7) + 1 AS h, value FROM p WHERE idx >= n - 7) USING (series_id, h) GROUP BY 1, 2),
b AS (SELECT five.*, CAST(five.h AS INT) AS step, rmse, point - 1.2816 * s * sqrt(five.h) AS lower, point + 1.2816 * s * sqrt(five.h) AS upper FROM five JOIN x USING (series_id, method))"""
ORACLES["ensemble_forecast"] = f"""WITH {_FIVE}, w AS (SELECT *, 1 / greatest(rmse, 1e-9) AS w FROM b)
SELECT series_id, step AS h, round(sum(point * w) / sum(w), 4) AS point, round(sum(lower * w) / sum(w), 4) AS lower, round(sum(upper * w) / sum(w), 4) AS upper FROM w GROUP BY 1, 2"""


@query("fold_summary", f"SELECT series_id, method, count(*) AS folds, round(avg(rmse), 3) AS mean, round(stddev_samp(rmse), 3) AS sd FROM ({ORACLES['rolling_origin']}) GROUP BY 1, 2")
def fold_summary(spark, d):
    return rounded(guidance.fold_summary(rounded(_rolling(spark, d))), 3)


for _name, _method, _sides in (("impute_neighbors", "neighbor_avg", "3 PRECEDING AND 3 FOLLOWING"), ("impute_last", "last", "10 PRECEDING AND 1 PRECEDING")):
    query(_name, f"WITH {_HOLES} SELECT series_id, idx, round(coalesce(value, avg(value) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN {_sides})), 4) AS value FROM p")(
        lambda spark, d, method=_method: rounded(quality.impute(_holes(spark, d), method).select("series_id", F.col("idx").cast("bigint").alias("idx"), "value"))
    )


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event type the best of five methods by hold-out error, fitted to all days, with its week ahead."""
    points = tables.daily_events(spark, sf_dir)
    methods = ("naive", "mean", "drift", "linear", "holt")
    best = evaluate.backtest(points, 7, methods=methods).filter("rank = 1").select("series_id", "method", "rmse")
    return rounded(models.forecast(points, 7, methods=methods).join(best, ["series_id", "method"]))


@query(
    "best_forecast",
    f"""WITH {_FIVE}, top AS (SELECT series_id, method FROM x QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(rmse, 6), list_position(['naive', 'mean', 'drift', 'linear', 'holt'], method)) = 1)
SELECT series_id, method, step AS h, round(point, 4) AS point, round(lower, 4) AS lower, round(upper, 4) AS upper, round(rmse, 4) AS rmse FROM b JOIN top USING (series_id, method)""",
)
def best_forecast(spark, d):
    return entry(spark, d)


def queries() -> dict:
    return QUERIES | wider.QUERIES | further.QUERIES | more.QUERIES | latest.QUERIES | guide.QUERIES | states.QUERIES | graphs.QUERIES | designs.QUERIES | scales.QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES | wider.ORACLES | further.ORACLES | more.ORACLES | latest.ORACLES | guide.ORACLES | states.ORACLES | graphs.ORACLES | designs.ORACLES | scales.ORACLES
