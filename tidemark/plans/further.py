"""Queries of anomalies, tuning, allocation, prices, densities, cascades, sessions and feeds, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stats import norm_cdf_sql
from tidemark.operators import anomalies, models, tuning
from tidemark.plans.wider import DAILY, longs, rounded
from tidemark.sources import reports, tables
from tidemark.streaming import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ORDERS = """
od AS (SELECT 'orders' AS series_id, CAST(o_orderdate AS DATE) AS t, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM od)
"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(
    "cusum",
    f"""WITH RECURSIVE {DAILY}, z AS (SELECT series_id, idx, value, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM p WINDOW w AS (PARTITION BY series_id)),
r AS (SELECT series_id, idx, value, greatest(0.0, z - 0.5)::DOUBLE AS up, least(0.0, z + 0.5)::DOUBLE AS down FROM z WHERE idx = 0
  UNION ALL SELECT r.series_id, z.idx, z.value, greatest(0.0, up + z.z - 0.5), least(0.0, down + z.z + 0.5) FROM r JOIN z ON z.series_id = r.series_id AND z.idx = r.idx + 1)
SELECT series_id, idx, round(value, 4) AS value, round(up, 4) + 0.0 AS up, round(down, 4) + 0.0 AS down, greatest(up, -down) > 2.0 AS detected FROM r""",
)
def cusum(spark, d):
    out = anomalies.cusum(tables.daily_events(spark, d), threshold=2.0)
    return longs(rounded(out), "idx").withColumns({c: F.col(c) + 0.0 for c in ("up", "down")})


@query(
    "anomaly_patterns",
    f"""WITH {ORDERS}, a AS (SELECT series_id, idx, abs(value - avg(value) OVER s) / stddev_pop(value) OVER s AS score,
coalesce(regr_slope(value, idx) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0.0) AS before,
coalesce(regr_slope(value, idx) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0.0) AS after FROM p WINDOW s AS (PARTITION BY series_id))
SELECT series_id, idx, round(score, 4) AS score, round(before, 3) AS before, round(after, 3) AS after,
CASE WHEN before = 0 AND after = 0 THEN 'isolated_spike' WHEN before <> after THEN 'trend_reversal' WHEN score > 3 THEN 'extreme_outlier' ELSE 'moderate_deviation' END AS pattern FROM a WHERE score > 2.5""",
)
def anomaly_patterns(spark, d):
    out = longs(anomalies.anomaly_patterns(tables.daily_orders(spark, d)), "idx")
    return out.withColumns({"score": F.round("score", 4), "before": F.round("before", 3), "after": F.round("after", 3)})


@query(
    "stationarity",
    f"""WITH {DAILY}, x AS (SELECT series_id, value, coalesce(value - lag(value) OVER (PARTITION BY series_id ORDER BY idx), 0.0) AS d FROM p)
SELECT series_id, round(var_pop(value) / greatest(var_pop(d), 0.001), 4) AS statistic, var_pop(value) / greatest(var_pop(d), 0.001) < 2 AS stationary FROM x GROUP BY 1""",
)
def stationarity(spark, d):
    return rounded(anomalies.stationarity(tables.daily_events(spark, d)))


@query(
    "season_kind",
    f"""WITH {DAILY}, f AS (SELECT series_id, idx % 7 AS phase, avg(value) AS mean, stddev_pop(value) AS sd, count(*) AS k FROM p GROUP BY 1, 2),
v AS (SELECT series_id, avg(CASE WHEN k >= 2 AND mean > 0 THEN sd / mean END) AS variation, sum(k) AS n FROM f GROUP BY 1)
SELECT series_id, round(variation, 4) AS variation, CASE WHEN n >= 14 AND variation > 0.5 THEN 'multiplicative' ELSE 'additive' END AS kind FROM v""",
)
def season_kind(spark, d):
    return rounded(anomalies.season_kind(tables.daily_events(spark, d), 7))


@query("isolation_scores")
def isolation_scores(spark, d):
    return rounded(anomalies.isolation_scores(tables.daily_events(spark, d)))


@query(
    "tuned_holt",
    f"""WITH RECURSIVE {DAILY}, grid AS (SELECT a / 10.0::DOUBLE AS alpha, b / 10.0::DOUBLE AS beta FROM range(1, 10) x(a), range(1, 10) y(b)),
r AS (SELECT p.series_id, alpha, beta, 0::BIGINT AS idx, p.n, p.value AS level, q.value - p.value AS trend FROM p JOIN p q ON p.series_id = q.series_id AND p.idx = 0 AND q.idx = 1, grid
  UNION ALL
  SELECT r.series_id, alpha, beta, p.idx, p.n, alpha * p.value + (1 - alpha) * (level + trend), beta * (alpha * p.value + (1 - alpha) * (level + trend) - level) + (1 - beta) * trend
  FROM r JOIN p ON p.series_id = r.series_id AND p.idx = r.idx + 1),
e AS (SELECT r.series_id, alpha, beta, fold, sqrt(avg(pow(p.value - level - (p.idx - r.idx) * trend, 2))) AS rmse FROM r JOIN range(0, 3) f(fold) ON r.idx = r.n - (3 - fold) * 5 - 1
  JOIN p ON p.series_id = r.series_id AND p.idx > r.idx AND p.idx <= r.idx + 5 GROUP BY 1, 2, 3, 4),
m AS (SELECT series_id, alpha, beta, avg(rmse) AS rmse FROM e GROUP BY 1, 2, 3)
SELECT series_id, round(alpha, 2) AS alpha, round(beta, 2) AS beta, round(rmse, 4) AS rmse FROM m QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(rmse, 6), alpha, beta) = 1""",
)
def tuned_holt(spark, d):
    return rounded(tuning.tuned_holt(tables.daily_events(spark, d), 3, 5))


@query(
    "top_down",
    """WITH m AS (SELECT date_trunc('month', o_orderdate) AS t, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
f AS (SELECT arg_max(value, t) AS last, (arg_max(value, t) - arg_min(value, t)) / (count(*) - 1) AS slope FROM m),
s AS (SELECT c_mktsegment, c_nationkey, sum(o_totalprice) / sum(sum(o_totalprice)) OVER () AS share FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT CAST(h AS INT) AS h, c_mktsegment, c_nationkey, round(sum((last + h * slope) * share), 2) AS point FROM s, f, range(1, 4) r(h) GROUP BY ROLLUP (h, c_mktsegment, c_nationkey) HAVING h IS NOT NULL""",
)
def top_down(spark, d):
    leaves = tables.monthly_revenue(spark, d)
    months = tables.indexed(leaves.groupBy(F.lit("all").alias("series_id"), "t").agg(F.sum("value").alias("value")))
    return rounded(tuning.top_down(models.forecast(months, 3, methods=("drift",)), leaves, "c_mktsegment", "c_nationkey"), 2)


@query("inverse_variance", f"WITH {DAILY}, v AS (SELECT series_id, 1 / var_pop(value) AS w FROM p GROUP BY 1) SELECT series_id, round(w / sum(w) OVER (), 4) AS weight FROM v")
def inverse_variance(spark, d):
    return rounded(tuning.inverse_variance(tables.daily_events(spark, d)))


@query(
    "revenue_impact",
    """WITH x AS (SELECT l_returnflag, l_extendedprice / l_quantity * (1 - l_discount) AS price, l_quantity * (1 + 1.2 * l_discount) AS quantity, l_extendedprice / l_quantity AS bp, l_quantity AS bq FROM lineitem)
SELECT l_returnflag, round(sum(price * quantity) - sum(bp * bq), 1) AS absolute, round(100 * (sum(price * quantity) - sum(bp * bq)) / sum(bp * bq), 4) AS percent, round(100 * (sum(quantity) - sum(bq)) / sum(bq), 4) AS quantity_percent FROM x GROUP BY 1""",
)
def revenue_impact(spark, d):
    base = F.col("l_extendedprice") / F.col("l_quantity")
    rows = tables.table(spark, d, "lineitem").select("l_returnflag", (base * (1 - F.col("l_discount"))).alias("price"), (F.col("l_quantity") * (1 + 1.2 * F.col("l_discount"))).alias("quantity"), base.alias("base_price"), F.col("l_quantity").alias("base_quantity"))
    return rounded(tuning.revenue_impact(rows, "l_returnflag").withColumn("absolute", F.round("absolute", 1)))


@query("optimal_price", "SELECT p_brand, round(avg(p_retailprice) * pow(1.1::DOUBLE, 1 / -1.2::DOUBLE), 4) AS price FROM part GROUP BY 1")
def optimal_price(spark, d):
    per = tables.table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("base"))
    return rounded(per.select("p_brand", tuning.optimal_price(F.col("base"), -1.2, 1.1).alias("price")))


@query(
    "exceedance",
    f"""WITH {DAILY}, e AS (SELECT *, value - lag(value) OVER (PARTITION BY series_id ORDER BY idx) AS e FROM p),
f AS (SELECT series_id, arg_max(value, idx) AS point, avg(value) AS lim, sqrt(sum(e * e) / greatest(any_value(n) - 1, 1)) AS s FROM e GROUP BY 1),
g AS (SELECT series_id, h, point, s * sqrt(h) AS sd, (lim - point) / (s * sqrt(h)) AS x FROM f, range(1, 8) r(h))
SELECT series_id, h, round(point, 4) AS point, round(sd, 4) AS sd, round(exp(-x * x / 2) / (sd * sqrt(2 * pi())), 8) AS density, round(1 - {norm_cdf_sql("x")}, 4) AS p_above FROM g""",
)
def exceedance(spark, d):
    points = tables.daily_events(spark, d)
    f = models.forecast(points, 7, methods=("naive",)).join(points.groupBy("series_id").agg(F.avg("value").alias("lim")), "series_id")
    out = tuning.exceedance(f, F.col("lim"), models.INTERVAL_Z[80]).withColumn("density", F.round("density", 8))
    return longs(out.select("series_id", "h", F.round("point", 4).alias("point"), F.round("sd", 4).alias("sd"), "density", F.round("p_above", 4).alias("p_above")), "h")


@query(
    "supplier_cascade",
    """WITH RECURSIVE e AS (SELECT s_suppkey // 2 AS src, s_suppkey AS dst FROM supplier WHERE s_suppkey > 1 AND s_suppkey * 7 % 10 < 8),
r AS (SELECT 1::BIGINT AS node, 0 AS round UNION SELECT dst, round + 1 FROM r JOIN e ON src = node) SELECT node, round FROM r""",
)
def supplier_cascade(spark, d):
    s = tables.table(spark, d, "supplier").filter("s_suppkey > 1")
    p = F.when(F.col("s_suppkey") * 7 % 10 < 8, 1.0).otherwise(0.0)
    edges = s.select(F.expr("s_suppkey div 2").alias("src"), F.col("s_suppkey").alias("dst"), p.alias("p"))
    return tuning.cascade(edges, spark.range(1, 2).toDF("node"))


@query(
    "user_sessions",
    """WITH x AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM x), z AS (SELECT user_id, s, count(*) AS n, sum(value) AS v, max(ts) - min(ts) AS d FROM y GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, max(n) AS longest, round(max(v), 4) AS most FROM z GROUP BY 1""",
)
def user_sessions(spark, d):
    events = tables.table(spark, d, "events")
    per = events.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return rounded(per.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"), F.max("v").alias("most")))


@query("feed_points", "SELECT event_type AS series_id, epoch_us(ts) // 1000 AS t_ms, round(value, 4) AS value FROM events")
def feed_points(spark, d):
    line = F.to_json(F.struct(F.col("event_type").alias("seriesId"), F.unix_millis("ts").alias("t"), "value"))
    points = feeds.points_from_json(tables.table(spark, d, "events").select(line.alias("line")))
    return points.select("series_id", F.unix_millis("t").alias("t_ms"), F.round("value", 4).alias("value"))


@query("report_json")
def report_json(spark, d):
    return reports.json_reports(tables.daily_events(spark, d), test=7, horizon=7)
