"""Queries of tests, panels, shocks and reports, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import norm_cdf_sql
from tidemark.operators import inference, pairs, panel, report, shocks
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
PANEL = """
mr AS (SELECT c_mktsegment AS segment, c_nationkey, date_trunc('month', o_orderdate) AS t, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
p AS (SELECT *, row_number() OVER (PARTITION BY segment, c_nationkey ORDER BY t) - 1 AS idx, count(*) OVER (PARTITION BY segment, c_nationkey) AS n FROM mr),
fit AS (SELECT segment, c_nationkey, arg_max(value, idx) AS last, arg_min(value, idx) AS first, avg(value) AS mean, regr_slope(value, idx) AS slope, regr_intercept(value, idx) AS level FROM p WHERE n >= 12 AND idx < n - 10 GROUP BY 1, 2),
held AS (SELECT p.*, idx - n + 11 AS h, last, first, mean, slope, level FROM p JOIN fit USING (segment, c_nationkey) WHERE idx >= n - 10),
f AS (SELECT segment, c_nationkey, idx, h, value, 'naive' AS method, last AS point FROM held UNION ALL SELECT segment, c_nationkey, idx, h, value, 'mean', mean FROM held
UNION ALL SELECT segment, c_nationkey, idx, h, value, 'drift', CASE WHEN n <> 11 THEN last + h * ((last - first) / (n - 11)) END FROM held UNION ALL SELECT segment, c_nationkey, idx, h, value, 'linear', level + slope * idx FROM held)
"""


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def nudged(df: DataFrame, digits: int) -> DataFrame:
    """All doubles rounded a little above their value: products of cents lie on rounding edges."""
    return df.select(*(F.round(F.col(c) + 10.0 ** -(digits + 3), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in names})


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def daily(spark, d):
    return tables.daily_events(spark, d)


def counted(points: DataFrame) -> DataFrame:
    return points.join(points.groupBy("series_id").agg(F.count("*").alias("n")), "series_id")


def monthly(spark, d):
    """(segment, c_nationkey, idx, value): monthly revenue of 125 series."""
    o, c = tables.table(spark, d, "orders"), tables.table(spark, d, "customer")
    per = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_mktsegment").alias("segment"), "c_nationkey", F.date_trunc("month", "o_orderdate").alias("t")).agg(F.sum("o_totalprice").alias("value"))
    return per.withColumn("idx", F.row_number().over(Window.partitionBy("segment", "c_nationkey").orderBy("t")) - 1).drop("t")


def forecasts(spark, d):
    return panel.panel_forecasts(monthly(spark, d), 10, ("segment", "c_nationkey"))


#: p-values by Simpson's rule over 2,000 steps of the density.
_STEPS = "(SELECT range AS k, CASE WHEN range IN (0, 2000) THEN 1 WHEN range % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(2001))"


@query(
    "ols_trend",
    f"""WITH {DAILY}, s AS (SELECT series_id, count(*) AS n, regr_slope(value, idx) AS b, regr_intercept(value, idx) AS a, regr_sxx(value, idx) AS sxx, regr_syy(value, idx) AS syy, regr_sxy(value, idx) AS sxy, avg(idx) AS mx FROM p GROUP BY 1),
e AS (SELECT *, sqrt((syy - sxy * sxy / sxx) / (n - 2)) AS sigma FROM s),
r AS (SELECT series_id, 'idx' AS term, n, b AS beta, sigma / sqrt(sxx) AS se, 1 - (syy - sxy * sxy / sxx) / syy AS r2 FROM e UNION ALL SELECT series_id, 'intercept', n, a, sigma * sqrt(1.0 / n + mx * mx / sxx), 1 - (syy - sxy * sxy / sxx) / syy FROM e),
t AS (SELECT *, beta / se AS t, n - 2 AS v FROM r),
i AS (SELECT series_id, term, sum(w * pow(1 + pow(abs(t) * k / 2000.0, 2) / v, -(v + 1) / 2.0)) * abs(t) / 6000 * exp(lgamma((v + 1) / 2.0) - lgamma(v / 2.0)) / sqrt(v * pi()) AS half FROM t, {_STEPS} GROUP BY series_id, term, t, v)
SELECT series_id, term, n, round(beta, 4) AS beta, round(se, 4) AS se, round(t, 4) AS t, round(1 - 2 * half, 4) AS p, round(r2, 4) AS r2 FROM t JOIN i USING (series_id, term)""",
)
def ols_trend(spark, d):
    return rounded(inference.ols(daily(spark, d), "value", ("idx",)).drop("regularised", "degenerate"))


@query(
    "weekday_anova",
    f"""WITH {DAILY}, g AS (SELECT series_id, dayofweek(t) AS wd, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM p GROUP BY 1, 2),
a AS (SELECT series_id, count(*) AS k, sum(n) AS n, sum(s * s / n) AS b, sum(s) AS s, sum(q) AS q FROM g GROUP BY 1),
f AS (SELECT series_id, ((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)) AS f, k - 1 AS df1, n - k AS df2 FROM a WHERE k > 1 AND n > k),
i AS (SELECT series_id, sum(w * CASE WHEN k = 0 THEN 0 ELSE pow(f * k / 2000.0, df1 / 2.0 - 1) * pow(1 + df1 * (f * k / 2000.0) / df2, -(df1 + df2) / 2.0) END) * f / 6000 * pow(df1 * 1.0 / df2, df1 / 2.0) * exp(lgamma((df1 + df2) / 2.0) - lgamma(df1 / 2.0) - lgamma(df2 / 2.0)) AS below FROM f, {_STEPS} GROUP BY series_id, f, df1, df2)
SELECT series_id, round(f, 4) AS f, CAST(df1 AS BIGINT) AS df1, CAST(df2 AS BIGINT) AS df2, round(1 - below, 4) AS p FROM f JOIN i USING (series_id)""",
)
def weekday_anova(spark, d):
    return longs(rounded(inference.anova(daily(spark, d).withColumn("wd", F.dayofweek("t")), "value", "wd")), "df1", "df2")


_PAIRS = "q AS (SELECT a.series_id AS a, b.series_id AS b, a.idx, a.value AS x, b.value AS y FROM p a JOIN p b USING (idx) WHERE a.series_id < b.series_id)"


@query(
    "sign_stability",
    f"""WITH {DAILY}, {_PAIRS}, n AS (SELECT a, b, count(*) AS n, corr(x, y) AS r, min(idx) AS low FROM q GROUP BY 1, 2),
k AS (SELECT a, b, floor((idx - low) / floor(n / 3)) AS block, corr(x, y) AS rb, any_value(r) AS r FROM q JOIN n USING (a, b) WHERE floor(n / 3) >= 8 AND floor((idx - low) / floor(n / 3)) < 3 GROUP BY 1, 2, 3),
g AS (SELECT a, b, avg(CASE WHEN sign(rb) = sign(r) THEN 1.0 ELSE 0.0 END) AS s FROM k WHERE NOT isnan(rb) GROUP BY 1, 2)
SELECT a, b, round(r, 4) AS r, round(coalesce(s, 0.0), 4) AS stability FROM n LEFT JOIN g USING (a, b)""",
)
def sign_stability(spark, d):
    return rounded(pairs.stable_signs(daily(spark, d), windows=3))


@query(
    "correlated_pairs",
    f"""WITH {DAILY}, {_PAIRS}, n AS (SELECT a, b, count(*) AS n, corr(x, y) AS r FROM q GROUP BY 1, 2),
r AS (SELECT *, {norm_cdf_sql("(abs(r) * sqrt((n - 2) / (1 - r * r)))")} AS c, CASE WHEN r >= 0.1 THEN 'positive' WHEN r <= -0.1 THEN 'negative' ELSE 'weak' END AS relation FROM n)
SELECT a, b, n, round(r, 4) AS r, round(2 * (1 - c), 4) AS p, relation, CASE WHEN relation <> 'weak' THEN dense_rank() OVER (PARTITION BY relation ORDER BY a) END AS cluster FROM r""",
)
def correlated_pairs(spark, d):
    return longs(rounded(inference.correlated_pairs(pairs.pair_correlations(daily(spark, d)), 0.1)), "cluster")


@query(
    "panel_methods",
    f"""WITH {PANEL}, s AS (SELECT method, segment, c_nationkey, sqrt(avg((point - value) ** 2)) AS rmse, avg(abs(point - value)) AS mae, avg(abs((point - value) / nullif(value, 0)) * 100) AS mape FROM f GROUP BY 1, 2, 3)
SELECT method, segment AS category, count(*) AS series, round(avg(rmse), 3) AS rmse, round(avg(mae), 3) AS mae, round(avg(mape), 3) AS mape FROM s GROUP BY 1, 2""",
)
def panel_methods(spark, d):
    return rounded(panel.compare_methods(forecasts(spark, d), "segment", ("segment", "c_nationkey")), 3)


@query(
    "panel_dm",
    f"""WITH {PANEL}, l AS (SELECT segment, c_nationkey, idx, max(CASE WHEN method = 'mean' THEN (point - value) ** 2 END) - max(CASE WHEN method = 'linear' THEN (point - value) ** 2 END) AS d FROM f GROUP BY 1, 2, 3),
g AS (SELECT segment AS category, count(d) AS n, avg(d) AS m, avg(d) / sqrt(var_samp(d) / count(d)) AS s FROM l GROUP BY 1),
c AS (SELECT *, 2 * (1 - {norm_cdf_sql("abs(s)")}) AS p FROM g)
SELECT category, n, round(s, 4) AS statistic, round(p, 4) AS p, p < 0.05 AS significant, CASE WHEN m > 0 THEN 'linear' ELSE 'mean' END AS better FROM c""",
)
def panel_dm(spark, d):
    return rounded(panel.panel_dm(forecasts(spark, d), "mean", "linear", "segment"))


@query(
    "batch_summary",
    f"""WITH {PANEL}, s AS (SELECT method, segment, c_nationkey, stddev_samp(point - value) AS sigma FROM f GROUP BY 1, 2, 3)
SELECT method, count(*) AS runs, count(sigma) AS successes, round(avg(sigma), 3) AS avg_sigma, round(min(sigma), 3) AS min_sigma, round(max(sigma), 3) AS max_sigma FROM s GROUP BY 1""",
)
def batch_summary(spark, d):
    return rounded(panel.batch_summary(forecasts(spark, d), ("segment", "c_nationkey")), 3)


@query(
    "ensembles",
    f"""WITH {PANEL} SELECT segment, c_nationkey, h, round(avg(point) + 1e-6, 3) AS simple, round(CASE WHEN count(point) > 2 THEN (sum(point) - min(point) - max(point)) / (count(point) - 2) ELSE avg(point) END + 1e-6, 3) AS trimmed FROM f GROUP BY 1, 2, 3""",
)
def ensembles(spark, d):
    return longs(nudged(panel.ensembles(forecasts(spark, d), ("segment", "c_nationkey")), 3), "h")


@query(
    "bottom_up_errors",
    f"""WITH {PANEL}, u AS (SELECT segment AS node, method, idx, sum(point) AS point, sum(value) AS value FROM f GROUP BY 1, 2, 3)
SELECT node, method, round(sqrt(avg((point - value) ** 2)), 3) AS rmse FROM u GROUP BY 1, 2""",
)
def bottom_up_errors(spark, d):
    return rounded(panel.bottom_up_errors(forecasts(spark, d), "segment"), 3)


@query(
    "anomaly_union",
    f"""WITH {DAILY}, s AS (SELECT series_id, avg(value) AS m, stddev_pop(value) AS sd, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM p GROUP BY 1 HAVING count(*) >= 5),
r AS (SELECT p.series_id, idx, value, m, sd, q1, q3, abs(value - q2) AS dv, (q3 - q1) * 0.5 AS reach FROM p JOIN s USING (series_id)),
a AS (SELECT *, quantile_cont(dv, 0.5) OVER (PARTITION BY series_id) AS mad, greatest(q1 - reach - value, value - q3 - reach) AS beyond FROM r),
k AS (SELECT series_id, idx, value, 0.6745 * dv / mad / 1.2 AS r1, CASE WHEN beyond > 0 THEN 1 + beyond / reach END AS r2, abs(value - m) / sd / 1.2 AS r3 FROM a)
SELECT series_id, idx, round(value, 4) AS value, CASE WHEN greatest(r1, r2, r3) >= 3 THEN 3 WHEN greatest(r1, r2, r3) >= 2 THEN 2 ELSE 1 END AS severity,
concat_ws(',', CASE WHEN r1 > 1 THEN 'mad' END, CASE WHEN r2 > 1 THEN 'iqr' END, CASE WHEN r3 > 1 THEN 'zscore' END) AS methods FROM k WHERE r1 > 1 OR r2 > 1 OR r3 > 1""",
)
def anomaly_union(spark, d):
    return longs(rounded(report.anomaly_union(daily(spark, d), mad=1.2, iqr=0.5, z=1.2)), "idx")


@query("confidence_buckets", f"""WITH {DAILY}, z AS (SELECT series_id, abs(value - avg(value) OVER (PARTITION BY series_id)) / stddev_pop(value) OVER (PARTITION BY series_id) AS z FROM p),
c AS (SELECT series_id, least(0.95, CASE WHEN z > 0 THEN exp(-2 / z) ELSE 0 END) AS c FROM z)
SELECT series_id, count(*) FILTER (c >= 0.8) AS high, count(*) FILTER (c >= 0.5 AND c < 0.8) AS medium, count(*) FILTER (c < 0.5) AS low FROM c GROUP BY 1""")
def confidence_buckets(spark, d):
    return report.confidence_buckets(daily(spark, d))


@query("top_points", f"""WITH {DAILY}, z AS (SELECT series_id, idx, (value - avg(value) OVER (PARTITION BY series_id)) / stddev_pop(value) OVER (PARTITION BY series_id) AS z FROM p)
SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY round(abs(z), 6) DESC, idx) AS rank, idx, round(z, 4) AS z FROM z QUALIFY rank <= 10""")
def top_points(spark, d):
    return longs(rounded(report.top_points(daily(spark, d))), "rank", "idx")


@query("requirements", f"""WITH {DAILY}, n AS (SELECT series_id, count(*) AS n FROM p GROUP BY 1)
SELECT series_id, n, n >= 30 AND n >= 48 AS sufficient, CASE WHEN n < 30 THEN 'Insufficient observations: ' || n || ' < 30' WHEN n < 48 THEN 'Need more history for seasonality: ' || n || ' < 48' ELSE '' END AS reason,
CAST(72 AS BIGINT) AS "window", 108.0::DOUBLE AS least_window, CAST(greatest(1, least(365, floor(n / 5.0 + 0.5))) AS BIGINT) AS test_size FROM n""")
def requirements(spark, d):
    return longs(report.requirements(daily(spark, d), 24, confidence=0.99), "window", "test_size")


@query("second_differences", f"""WITH {DAILY}, a AS (SELECT series_id, idx, value - lag(value) OVER (PARTITION BY series_id ORDER BY idx) AS value FROM p),
b AS (SELECT series_id, idx, value - lag(value) OVER (PARTITION BY series_id ORDER BY idx) AS value FROM a WHERE value IS NOT NULL)
SELECT series_id, idx, round(value, 4) AS value FROM b WHERE value IS NOT NULL""")
def second_differences(spark, d):
    return longs(rounded(report.differenced(daily(spark, d))), "idx")


@query("naive_baseline", f"""WITH {DAILY}, e AS (SELECT series_id, n, least(n - 1, greatest(3, n // 4)) AS k FROM p GROUP BY 1, 2),
l AS (SELECT e.*, p.value AS last, q.value AS old FROM e JOIN p ON p.series_id = e.series_id AND p.idx = e.n - 1 JOIN p q ON q.series_id = e.series_id AND q.idx = e.n - 1 - e.k)
SELECT l.series_id, h, round(b.value + (last - old) / k * (7 - (h - 1) % 7 + h - 1), 4) AS point FROM l, (SELECT unnest(range(1, 15)) AS h) JOIN p b ON b.series_id = l.series_id AND b.idx = l.n - 7 + (h - 1) % 7""")
def naive_baseline(spark, d):
    return longs(rounded(report.naive_baseline(daily(spark, d), 14, 7)), "h")


@query("lower_bound", f"""WITH {ORDERS}, s AS (SELECT min(t) AS low, max(t) AS high, max(idx) AS last FROM p), m AS (SELECT CAST(unnest(generate_series(low - 3, high + 3, INTERVAL 1 DAY)) AS DATE) AS moment FROM s),
j AS (SELECT moment, CASE WHEN moment >= low THEN coalesce(i, last) END AS idx FROM s, m ASOF LEFT JOIN (SELECT t, idx AS i FROM p) q ON q.t >= m.moment)
SELECT 'orders' AS series_id, CAST(moment AS VARCHAR) AS moment, j.idx, round(value, 4) AS value FROM j LEFT JOIN p ON p.idx = j.idx""")
def lower_bound(spark, d):
    p = tables.daily_orders(spark, d).withColumn("t", F.col("t").cast("date"))
    moments = p.agg(F.min("t").alias("a"), F.max("t").alias("b")).select(F.explode(F.sequence(F.date_sub("a", 3), F.date_add("b", 3))).alias("at"))
    out = longs(rounded(report.lower_bound(p, moments)), "idx")
    return out.withColumn("at", F.col("at").cast("string")).withColumnRenamed("at", "moment")


@query("seasonal_mase", f"""WITH {DAILY}, c AS (SELECT series_id, idx, value, abs(value - lag(value, 7) OVER (PARTITION BY series_id ORDER BY idx)) AS c, lag(value) OVER (PARTITION BY series_id ORDER BY idx) AS point FROM p)
SELECT series_id, round(avg(abs(value - point)) / avg(c), 4) AS mase FROM c GROUP BY 1""")
def seasonal_mase(spark, d):
    p = daily(spark, d)
    return rounded(report.seasonal_mase(p, p.select("series_id", "idx", F.lag("value").over(Window.partitionBy("series_id").orderBy("idx")).alias("point")), 7))


@query("varying_series", f"WITH {DAILY} SELECT series_id, count(*) AS n, round(sum(value), 4) AS total FROM p WHERE series_id IN (SELECT series_id FROM p GROUP BY 1 HAVING stddev_pop(value) > 0) GROUP BY 1")
def varying_series(spark, d):
    return rounded(report.varying(daily(spark, d)).groupBy("series_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


_PEAKS = "k AS (SELECT series_id, idx, value AS height FROM p QUALIFY value > lag(value) OVER (PARTITION BY series_id ORDER BY idx) AND value > lead(value) OVER (PARTITION BY series_id ORDER BY idx)), o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY idx) AS r FROM k)"


@query("thinned_peaks", f"""WITH RECURSIVE {DAILY}, {_PEAKS},
w AS (SELECT series_id, r, [(idx, height)] AS a FROM o WHERE r = 1
UNION ALL SELECT o.series_id, o.r, CASE WHEN o.idx - w.a[-1][1] >= 4 THEN w.a || [(o.idx, o.height)] WHEN o.height > w.a[-1][2] THEN w.a[:-2] || [(o.idx, o.height)] ELSE w.a END FROM w JOIN o ON o.series_id = w.series_id AND o.r = w.r + 1),
l AS (SELECT series_id, unnest(arg_max(a, r)) AS x FROM w GROUP BY 1)
SELECT series_id, x[1] AS idx, round(x[2], 4) AS height FROM l""")
def thinned_peaks(spark, d):
    w = Window.partitionBy("series_id").orderBy("idx")
    p = daily(spark, d).withColumns({"a": F.lag("value").over(w), "b": F.lead("value").over(w)}).filter("value > a and value > b")
    return longs(rounded(report.thinned_peaks(p.select("series_id", "idx", F.col("value").alias("height")), 4)), "idx")


@query("shock_scenarios", f"""WITH {ORDERS}, s AS (SELECT series_id, idx, n, value, unnest(['pandemic_retail', 'pandemic_travel', 'tariff', 'subsidy', 'geopolitical', 'weather', 'regulation', 'seasonal_promotion']) AS scenario FROM p),
m AS (SELECT *, CASE scenario WHEN 'pandemic_retail' THEN 0.4 ELSE 0.7 END AS depth FROM s)
SELECT series_id, idx, scenario, round(value * CASE
WHEN scenario LIKE 'pandemic%' THEN CASE WHEN idx < 60 THEN 1 - depth * least(1.0, (idx + 1) / 60.0) WHEN idx < 150 THEN CASE WHEN (idx // 14) % 3 = 0 THEN 0.7 ELSE 1.0 END WHEN idx < 330 THEN 1 + depth * 0.3 * (1 - exp(-0.01 * (idx - 150))) ELSE 1 END
WHEN scenario = 'tariff' THEN 0.84
WHEN scenario = 'subsidy' THEN CASE WHEN idx // (n // 3) < 3 THEN 1 + 1.15 * (idx // (n // 3) + 1) / 3.0 ELSE 1 END
WHEN scenario = 'geopolitical' THEN CASE WHEN idx < 90 THEN (1 - 0.05 * least(1.0, idx / 30.0)) * (1 - (0.15 * 0.3 + 0.25 * 0.15) * least(1.0, idx / 30.0)) ELSE 1 END
WHEN scenario = 'weather' THEN CASE WHEN idx >= 20 AND idx < 30 THEN 1 - 0.4 * pow(0.9, idx - 20) ELSE 1 END
WHEN scenario = 'regulation' THEN 0.95
ELSE CASE idx // 7 WHEN 2 THEN 1.3 WHEN 5 THEN 1.3 ELSE 1 END END + 1e-5, 2) AS adjusted FROM m""")
def shock_scenarios(spark, d):
    return longs(nudged(shocks.shock_scenarios(counted(tables.daily_orders(spark, d))), 2), "idx")


@query("dynamic_price", f"""WITH {DAILY}, c AS (SELECT series_id, idx, value, value / nullif(lag(value) OVER (PARTITION BY series_id ORDER BY idx), 0) AS r FROM p)
SELECT series_id, idx, round(value * CASE WHEN r > 1.05 THEN 1.05 WHEN r < 0.95 THEN 0.95 ELSE 1 END * CASE WHEN idx % 24 IN (9, 10, 17, 18) THEN 1.15 ELSE 0.9 END, 4) AS adjusted FROM c""")
def dynamic_price(spark, d):
    return longs(rounded(shocks.dynamic_price(daily(spark, d))), "idx")


_PRODUCTS = [("click", "grocery", 2), ("view", "luxury", None), ("purchase", "other", 1), ("signup", "subscription", 0)]


@query("category_prices", f"""WITH {DAILY}, c AS (SELECT * FROM (VALUES ('click', 'grocery', -1.2, 2), ('view', 'luxury', -0.5, 0), ('purchase', 'other', -1.0, 1), ('signup', 'subscription', -0.4, 0)) v(series_id, category, elasticity, weeks))
SELECT series_id, category, CAST(elasticity AS DOUBLE) AS elasticity, idx, round(value * (1 + elasticity * CASE WHEN weeks > 0 THEN CASE WHEN idx // 7 < weeks THEN -0.1 ELSE 0 END WHEN idx < 7 THEN -0.05 ELSE 0 END), 4) AS adjusted FROM p JOIN c USING (series_id)""")
def category_prices(spark, d):
    products = spark.createDataFrame(_PRODUCTS, "series_id string, category string, promo_weeks int")
    return longs(rounded(shocks.category_prices(daily(spark, d), products)), "idx")


@query("cannibalised", f"""WITH {DAILY}, s AS (SELECT series_id, sum(value) AS value FROM p GROUP BY 1)
SELECT series_id, round(value, 4) AS value, round(value * CASE series_id WHEN 'click' THEN 1.5 WHEN 'view' THEN 0.9 WHEN 'signup' THEN 0.9 ELSE 1 END, 4) AS adjusted FROM s""")
def cannibalised(spark, d):
    promoted = spark.createDataFrame([("click", 2500.0, ["view", "signup"]), ("error", 0.0, ["purchase"])], "series_id string, budget double, related array<string>")
    return rounded(shocks.cannibalised(daily(spark, d).groupBy("series_id").agg(F.sum("value").alias("value")), promoted))


@query("risk_assessment", f"""WITH {DAILY}, s AS (SELECT series_id, sum(abs(value)) AS total FROM p GROUP BY 1),
r AS (SELECT * FROM (VALUES ('pandemic', 0.1, 3.0, 'Activate contingency planning; Secure alternative suppliers; '), ('weather', 0.4, 1.5, 'Implement early warning monitoring; '), ('policy', 0.6, 1.2, 'Invest in resilience infrastructure; '), ('natural-disaster', 0.15, 2.0, 'Implement early warning monitoring; '), ('other', 0.3, 1.0, '')) v(event, p, scale, a))
SELECT series_id, event, round(p * scale * total, 4) AS expected_loss, round(p * scale * total * 0.5, 4) AS lower, round(p * scale * total * 2, 4) AS upper, a || 'Update insurance coverage; Maintain higher safety stock' AS actions FROM s, r""")
def risk_assessment(spark, d):
    return rounded(shocks.risks(daily(spark, d)))


@query("parameter_sweep", f"""WITH {DAILY}, s AS (SELECT series_id, sum(value) AS value FROM p GROUP BY 1)
SELECT series_id, CAST(price AS DOUBLE) AS price, CAST(volume AS DOUBLE) AS volume, round(value * (1 + price) * (1 - 1.2 * price) * (1 + volume), 4) AS outcome FROM s, (SELECT unnest([-0.1, 0.0, 0.1, 0.2]) AS price), (SELECT unnest([-0.2, 0.0, 0.2]) AS volume)""")
def parameter_sweep(spark, d):
    return rounded(shocks.parameter_sweep(daily(spark, d).groupBy("series_id").agg(F.sum("value").alias("value")), (-0.1, 0.0, 0.1, 0.2), (-0.2, 0.0, 0.2)))


@query("bankrupt_items", """WITH s AS (SELECT DISTINCT l_partkey AS item, l_suppkey AS supplier FROM lineitem), f AS (SELECT s_suppkey AS supplier FROM supplier WHERE s_nationkey <> 7)
SELECT DISTINCT item FROM s WHERE supplier IN (SELECT supplier FROM f) AND item NOT IN (SELECT item FROM s WHERE supplier NOT IN (SELECT supplier FROM f))""")
def bankrupt_items(spark, d):
    supplied = tables.table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("supplier"))
    return shocks.bankrupt_items(supplied, tables.table(spark, d, "supplier").filter("s_nationkey <> 7").select(F.col("s_suppkey").alias("supplier")))


@query("bottlenecks", """WITH s AS (SELECT l_returnflag AS route, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE) AS days, CASE WHEN l_linenumber = 1 THEN 0.5 END AS severity FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
a AS (SELECT *, days * (1 + CASE route WHEN 'A' THEN 0.3 WHEN 'N' THEN 0.8 ELSE 1 END + coalesce(severity, 0)) AS adjusted FROM s)
SELECT route, count(*) AS shipments, round(avg(days), 4) AS days, round(avg(adjusted), 4) AS adjusted, round(avg(adjusted - days), 4) AS delay FROM a GROUP BY 1""")
def bottlenecks(spark, d):
    li, o = tables.table(spark, d, "lineitem"), tables.table(spark, d, "orders")
    sent = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("l_returnflag").alias("route"), F.datediff("l_shipdate", "o_orderdate").cast("double").alias("days"), F.when(F.col("l_linenumber") == 1, 0.5).alias("severity"))
    routes = spark.createDataFrame([("A", 0.3), ("N", 0.8)], "route string, congestion double")
    out = shocks.bottlenecks(sent, routes)
    return rounded(out.groupBy("route").agg(F.count("*").alias("shipments"), *(F.avg(c).alias(c) for c in ("days", "adjusted", "delay"))))


@query("scenario_weights", "SELECT event_type AS name, round(count(*) / sum(count(*)) OVER (), 4) AS p FROM events GROUP BY 1")
def scenario_weights(spark, d):
    """Scenarios named by event types, as probable as those are frequent."""
    counts = tables.table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg((F.count("*") / 1000.0).alias("p"))
    return rounded(report.scenario_weights(counts))


@query("events_in_range", """SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE CAST(ts AS DATE) BETWEEN (SELECT CAST(min(ts) AS DATE) + 5 FROM events) AND (SELECT CAST(min(ts) AS DATE) + 12 FROM events) GROUP BY 1""")
def events_in_range(spark, d):
    ev = tables.table(spark, d, "events")
    low = ev.agg(F.to_date(F.min("ts")).alias("low"))
    inside = ev.crossJoin(F.broadcast(low)).filter(F.to_date("ts").between(F.date_add("low", 5), F.date_add("low", 12)))
    return rounded(inside.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")))
