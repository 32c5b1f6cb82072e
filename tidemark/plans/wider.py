"""Queries over several series, of causes, simulations and scenarios, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import plugins
from tidemark.operators import causal, decompose, features, models, multi, quality, regress, scenarios
from tidemark.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DAILY = """
ev AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS t, sum(value) AS value FROM events GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM ev)
"""
MONTHLY = """
mr AS (SELECT c_mktsegment AS segment, c_nationkey, date_trunc('month', o_orderdate) AS t, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)
"""
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in names})


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(
    "panel_by_segment",
    f"""WITH {MONTHLY} SELECT segment AS category, round(avg(value), 2) AS mean, round(median(value), 2) AS median, round(stddev_pop(value), 2) AS std, round(min(value), 2) AS min, round(max(value), 2) AS max, count(*) AS n
FROM mr GROUP BY GROUPING SETS ((segment), ())""",
)
def panel_by_segment(spark, d):
    return rounded(multi.panel(tables.monthly_revenue(spark, d), "c_mktsegment"), 2)


@query(
    "hierarchy_roll_up",
    """SELECT r_name AS region, n_name AS nation, c_mktsegment AS segment, round(sum(o_totalprice), 2) AS value, CAST(grouping(r_name, n_name, c_mktsegment) AS BIGINT) AS below
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""",
)
def hierarchy_roll_up(spark, d):
    t = lambda n: tables.table(spark, d, n)
    leaves = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    leaves = leaves.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("o_totalprice").alias("value"))
    return longs(rounded(multi.roll_up(leaves, "region", "nation", "segment"), 2), "below")


_CORR = """
c AS (SELECT a.series_id AS a, b.series_id AS b, l.lag, corr(a.value, b.value) AS r, count(*) AS k FROM p a JOIN p b ON a.series_id < b.series_id JOIN range(-7, 8) l(lag) ON a.idx = b.idx - l.lag GROUP BY 1, 2, 3 HAVING count(*) >= 3)"""


@query("lagged_correlation", f"WITH {DAILY}, {_CORR} SELECT a, b, lag, round(r, 4) AS r, k AS n FROM c")
def lagged_correlation(spark, d):
    return longs(rounded(multi.lagged_correlation(tables.daily_events(spark, d), 7)), "lag")


@query(
    "best_lags",
    f"""WITH {DAILY}, {_CORR} SELECT a, b, lag, round(r, 4) AS r, CASE WHEN abs(r) >= 0.9 THEN 'very strong' WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate' ELSE 'weak' END AS strength
FROM c QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY round(abs(r), 9) DESC, abs(lag), lag) = 1""",
)
def best_lags(spark, d):
    return longs(rounded(multi.best_lags(multi.lagged_correlation(tables.daily_events(spark, d), 7))), "lag")


@query("factors")
def factors(spark, d):
    return rounded(multi.factors(tables.daily_events(spark, d), EVENT_TYPES, 2))


@query(
    "reconciled_forecast",
    f"""WITH {DAILY}, u AS (SELECT series_id, idx, value FROM p UNION ALL SELECT 'total', row_number() OVER (ORDER BY t) - 1, sum(value) FROM ev GROUP BY t),
f AS (SELECT series_id, h, regr_intercept(value, idx) + regr_slope(value, idx) * (count(*) - 1 + h) AS point FROM u, range(1, 8) r(h) GROUP BY 1, 2),
d AS (SELECT h, (sum(point) FILTER (series_id = 'total') - sum(point) FILTER (series_id <> 'total')) / count(*) AS gap FROM f GROUP BY 1)
SELECT series_id AS node, CAST(h AS INT) AS h, round(point, 4) AS point, round(CASE WHEN series_id = 'total' THEN point - gap ELSE point + gap END, 4) AS reconciled FROM f JOIN d USING (h)""",
)
def reconciled_forecast(spark, d):
    points = tables.daily_events(spark, d)
    total = tables.indexed(points.groupBy("t").agg(F.sum("value").alias("value")).withColumn("series_id", F.lit("total")))
    base = models.forecast(points.select("series_id", "idx", "value").unionByName(total.select("series_id", "idx", "value")), 7, methods=("linear",))
    return rounded(multi.reconcile(base.select(F.col("series_id").alias("node"), "h", "point"), {"total": None} | {e: "total" for e in EVENT_TYPES}))


@query(
    "as_of_join",
    """WITH e AS (SELECT user_id, ts, max(value) AS error_value FROM events WHERE event_type = 'error' GROUP BY 1, 2)
SELECT p.event_id, p.user_id, round(e.error_value, 4) AS error_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.ts >= e.ts""",
)
def as_of_join(spark, d):
    events = tables.table(spark, d, "events")
    errors = events.filter("event_type = 'error'").groupBy("user_id", "ts").agg(F.max("value").alias("error_value"))
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return rounded(causal.as_of(left, errors, "user_id", "ts", "error_value").select("event_id", "user_id", "error_value"))


@query(
    "nearest_point",
    """WITH od AS (SELECT CAST(o_orderdate AS DATE) AS t FROM orders GROUP BY 1), p AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS idx FROM od),
w AS (SELECT 'e' || i AS name, DATE '1992-01-03' + CAST(i * 97 AS INT) AS t FROM range(0, 20) r(i))
SELECT name, arg_min(idx, abs(epoch_ms(p.t) - epoch_ms(w.t)) * 1000000.0 + idx) AS idx FROM w, p GROUP BY 1""",
)
def nearest_point(spark, d):
    when = spark.range(20).select(F.concat(F.lit("e"), "id").alias("name"), F.date_add(F.to_date(F.lit("1992-01-03")), (F.col("id") * 97).cast("int")).alias("when"))
    return longs(causal.nearest(when, tables.daily_orders(spark, d)).select("name", "idx"), "idx")


def _kernel_sql(kind: str) -> str:
    at = "(i - s)"
    body = {
        "box": "1.0",
        "exponential": f"exp(-{at} / greatest(dur / 3.0, 0.5))",
        "triangular": f"CASE WHEN {at} < dur / 2.0 THEN {at} / greatest(dur / 2.0, 0.5) ELSE (dur - {at}) / greatest({at} - dur / 2.0, 0.5) END",
        "gaussian": f"exp(-0.5 * pow(({at} - dur / 2.0) / greatest(dur / 4.0, 0.5), 2))",
        "step": f"1 - exp(-{at} / greatest(dur / 3.0, 0.5))",
    }[kind]
    where = {"box": "i >= s AND i < s + dur", "triangular": "i >= s AND i < s + dur", "gaussian": "true"}.get(kind, "i >= s")
    return f"SELECT '{kind}' AS kind, name, CAST(i AS INT) AS idx, round({body}, 6) AS weight FROM e, range(0, 30) r(i) WHERE s < 30 AND {where}"


_PEAKS = f"{DAILY}, e AS (SELECT series_id AS name, arg_max(idx, value) AS s, 3 + sum((value > m)::INT) % 6 AS dur FROM (SELECT *, avg(value) OVER (PARTITION BY series_id) AS m FROM p) GROUP BY 1)"


@query("event_weights", f"WITH {_PEAKS} " + " UNION ALL ".join(_kernel_sql(k) for k in ("box", "exponential", "triangular", "gaussian", "step")))
def event_weights(spark, d):
    """Weights of an event at each event type's largest day, the longer the more days lie above the mean."""
    points = tables.daily_events(spark, d).withColumn("m", F.avg("value").over(Window.partitionBy("series_id")))
    peak = points.groupBy(F.col("series_id").alias("name")).agg(F.max_by("idx", "value").cast("int").alias("start"), (3 + F.count_if(F.col("value") > F.col("m")) % 6).cast("int").alias("duration"))
    out = None
    for kind in ("box", "exponential", "triangular", "gaussian", "step"):
        part = causal.event_weights(peak, 30, kind).select(F.lit(kind).alias("kind"), "name", "idx", "weight")
        out = part if out is None else out.unionByName(part)
    return rounded(out, 6)


@query(
    "diff_in_diff",
    f"""WITH {DAILY}, w AS (SELECT series_id, idx >= 15 AS after, avg(value) AS m, var_samp(value) AS v FROM p WHERE idx >= 5 AND idx < 25 GROUP BY 1, 2),
s AS (SELECT avg(m) FILTER (series_id = 'click' AND NOT after) AS a, avg(m) FILTER (series_id = 'click' AND after) AS b, avg(m) FILTER (series_id <> 'click' AND NOT after) AS c, avg(m) FILTER (series_id <> 'click' AND after) AS d,
avg(v) FILTER (series_id = 'click' AND NOT after) AS va, avg(v) FILTER (series_id = 'click' AND after) AS vb, avg(v) FILTER (series_id <> 'click' AND NOT after) AS vc, avg(v) FILTER (series_id <> 'click' AND after) AS vd, count(DISTINCT series_id) - 1 AS k FROM w),
e AS (SELECT *, (b - a) - (d - c) AS effect, sqrt(va / 10 + vb / 10 + (vc / 10 + vd / 10) / k) AS se FROM s)
SELECT round(a, 4) AS m_t_pre, round(b, 4) AS m_t_post, round(c, 4) AS m_c_pre, round(d, 4) AS m_c_post, round(effect, 4) AS effect, round(se, 4) AS se, round(effect / se, 4) AS t, 36 AS df FROM e""",
)
def diff_in_diff(spark, d):
    return rounded(causal.diff_in_diff(tables.daily_events(spark, d), "click", 15, 10, 10))


@query(
    "pulse_response",
    """WITH c AS (SELECT avg(o_totalprice) / 1000 AS change FROM orders)
SELECT CAST(h AS INT) AS h, round(CAST(sum(CASE WHEN h - lag BETWEEN 2 AND 6 THEN change * c ELSE 0 END) AS DOUBLE), 4) AS delta, count(*) FILTER (h - lag BETWEEN 2 AND 6) AS active
FROM c, range(0, 12) s(h), (VALUES (0, 0.5), (1, 0.3), (2, 0.1)) l(lag, c) GROUP BY 1""",
)
def pulse_response(spark, d):
    """A pulse of the mean order, in thousands."""
    change = tables.table(spark, d, "orders").agg(F.avg("o_totalprice") / 1000).head()[0]
    return rounded(causal.pulse_response([0.5, 0.3, 0.1], change, 2, 5, 12, spark))


@query("monte_carlo")
def monte_carlo(spark, d):
    """Walks of daily revenue from its last value, by the mean and deviation of its steps."""
    return rounded(scenarios.joint_bands(scenarios.simulate_paths(spark, *scenarios.walk_of(tables.daily_orders(spark, d)), 24), 24))


@query("simulated_risk")
def simulated_risk(spark, d):
    total = scenarios.simulate_paths(spark, *scenarios.walk_of(tables.daily_orders(spark, d)), 24).groupBy("sim").agg(F.sum("value").alias("value"))
    return rounded(scenarios.risk(total))


@query(
    "order_risk",
    """WITH o AS (SELECT o_totalprice AS v FROM orders), k AS (SELECT list(v ORDER BY v)[CAST(floor(count(*) * (1 - 0.95)) AS BIGINT) + 1] AS var FROM o)
SELECT round(any_value(var), 4) AS var, round(avg(v) FILTER (v <= var), 4) AS cvar, avg(CASE WHEN v < 0 THEN 1.0 ELSE 0.0 END) AS p_negative FROM o, k""",
)
def order_risk(spark, d):
    return rounded(scenarios.risk(tables.table(spark, d, "orders").select(F.col("o_totalprice").alias("value"))))


def _base(spark, d):
    return models.forecast(tables.daily_events(spark, d), 60, methods=("linear",)).select("series_id", "h", "point")


_BASE = "b AS (SELECT series_id, h, regr_intercept(value, idx) + regr_slope(value, idx) * (any_value(n) - 1 + h) AS point FROM p, range(1, 61) r(h) GROUP BY series_id, h)"
_TREE = [("boom", 0.2, "multiplicative", 1.3), ("slump", 0.1, "multiplicative", 0.7), ("deal", 0.1, "additive", 250.0)]


@query(
    "scenario_tree",
    f"""WITH {DAILY}, {_BASE}, s(name, p, kind, amount) AS (VALUES {", ".join(map(str, _TREE))}), q AS (SELECT *, 0.4 * p / sum(p) OVER () AS w FROM s)
SELECT series_id, h, round(any_value(point), 4) AS base, round(0.6 * any_value(point) + sum(w * CASE kind WHEN 'multiplicative' THEN point * amount ELSE point + amount END), 4) AS expected FROM b, q GROUP BY 1, 2""",
)
def scenario_tree(spark, d):
    return longs(rounded(scenarios.scenario_tree(_base(spark, d), _TREE)), "h")


_MULTIPLIERS = {
    "price_increase": "1 - 1.2 * (1 + 0.5 * 0.05 * least(i // 7 + 1, 6)) * 0.05 * least(i // 7 + 1, 6)",
    "price_decrease": "1 + 1.2 * CASE WHEN i < 7 THEN 0.05 WHEN i < 14 THEN 0.10 ELSE 0.15 END",
    "regular_promotion": "CASE WHEN i % 30 < 7 THEN 1.25 ELSE 1.0 END",
    "flash_sale": "1 + " + " + ".join(f"CASE WHEN i BETWEEN {s} AND {s + 2} THEN 2.5 * pow(0.6, i - {s}) ELSE 0 END" for s in (3, 17, 31)),
    "stacked_promotions": "CASE i // 7 WHEN 1 THEN 2.5 WHEN 2 THEN 2.0 WHEN 3 THEN 1.8 ELSE 1.0 END",
    "short_delay": "CASE WHEN i < 3 THEN 0.6 ELSE 1.0 END",
    "long_outage": "CASE WHEN i < 14 THEN 0.2 WHEN i < 21 THEN 0.6 ELSE 1.0 END",
    "natural_disaster": "greatest(0.1, 1 - 0.5 * (1 + i / 30.0))",
}


@query(
    "what_if",
    f"""WITH {DAILY}, {_BASE}, i AS (SELECT *, h - 1 AS i FROM b), s AS ({" UNION ALL ".join(f"SELECT series_id, '{k}' AS scenario, h, point AS base, point * ({m}) AS adjusted FROM i" for k, m in _MULTIPLIERS.items())})
SELECT series_id, scenario, h, round(base, 4) AS base, round(adjusted, 4) AS adjusted, round(sum(adjusted - base) OVER (PARTITION BY series_id, scenario ORDER BY h), 4) AS cumulative FROM s""",
)
def what_if(spark, d):
    return longs(rounded(scenarios.what_if(_base(spark, d))), "h")


@query("capacity_limited", f"WITH {DAILY} SELECT series_id, round(sum(least(value, 3300)), 4) AS served, round(sum(greatest(value - 3300, 0)), 4) AS lost, round(avg(least(value / 3300, 1)), 4) AS utilisation FROM p GROUP BY 1")
def capacity_limited(spark, d):
    return rounded(scenarios.capacity_limited(tables.daily_events(spark, d), 3300.0))


@query(
    "cross_elasticity",
    """WITH m AS (SELECT date_trunc('month', l_shipdate) AS t, sum(l_extendedprice) FILTER (p_brand = 'Brand#1') / sum(l_quantity) FILTER (p_brand = 'Brand#1') AS pb, sum(l_quantity) FILTER (p_brand <> 'Brand#1') AS qa
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
c AS (SELECT (pb - lag(pb) OVER w) / lag(pb) OVER w AS p, (qa - lag(qa) OVER w) / lag(qa) OVER w AS q FROM m WINDOW w AS (ORDER BY t)),
e AS (SELECT regr_slope(q, p) AS elasticity FROM c)
SELECT round(elasticity, 4) AS elasticity, CASE WHEN elasticity > 0.1 THEN 'substitute' WHEN elasticity < -0.1 THEN 'complementary' ELSE 'independent' END AS relation FROM e""",
)
def cross_elasticity(spark, d):
    line = tables.table(spark, d, "lineitem").join(tables.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    mine = F.col("p_brand") == "Brand#1"
    per = line.groupBy(F.trunc("l_shipdate", "month").alias("t")).agg((F.sum(F.when(mine, F.col("l_extendedprice"))) / F.sum(F.when(mine, F.col("l_quantity")))).alias("price_b"), F.sum(F.when(~mine, F.col("l_quantity"))).alias("quantity_a"))
    return rounded(scenarios.cross_elasticity(per))


@query(
    "seasonal_lags",
    """WITH od AS (SELECT CAST(o_orderdate AS DATE) AS t, sum(o_totalprice) AS value FROM orders GROUP BY 1), p AS (SELECT value - avg(value) OVER () AS c, row_number() OVER (ORDER BY t) AS i, count(*) OVER () AS n FROM od),
a AS (SELECT l.lag, any_value(a.n) AS n, sum(a.c * b.c) / (any_value(a.n) - l.lag) / any_value(v.v) AS acf FROM p a JOIN range(1, 61) l(lag) ON true JOIN p b ON a.i = b.i + l.lag, (SELECT avg(c * c) AS v FROM p) v GROUP BY 1),
k AS (SELECT *, lag(acf) OVER (ORDER BY lag) AS before, lead(acf) OVER (ORDER BY lag) AS after FROM a)
SELECT 'orders' AS series_id, lag, round(acf, 6) AS acf FROM k WHERE lag >= 2 AND acf > before AND acf > after AND acf > 0.5 / sqrt(n)""",
)
def seasonal_lags(spark, d):
    return longs(rounded(features.seasonal_lags(tables.daily_orders(spark, d), 60, 0.0, 0.5), 6), "lag")


@query(
    "fourier_features",
    f"""WITH {DAILY} SELECT series_id, idx, k, round(sin(2 * pi() * k * idx / 7), 6) + 0.0 AS s, round(cos(2 * pi() * k * idx / 7), 6) + 0.0 AS c FROM p, range(1, 4) r(k)""",
)
def fourier_features(spark, d):
    return longs(rounded(features.fourier(tables.daily_events(spark, d), 7, 3).select("series_id", "idx", "k", "s", "c"), 6).withColumns({c: F.col(c) + 0.0 for c in "sc"}), "idx", "k")


@query(
    "characteristics",
    f"""WITH {DAILY}, l AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY idx) AS b, avg(value) OVER (PARTITION BY series_id) AS m FROM p)
SELECT series_id, count(*) AS n, round(regr_slope(value, idx), 4) AS slope, round(regr_r2(value, idx), 4) AS trend_r2, round(stddev_pop(value) / avg(value), 4) AS cv, round(avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END), 4) AS zero_ratio,
round(sum((value - m) * (b - m)) / sum(pow(value - m, 2)), 4) AS acf1 FROM l GROUP BY 1""",
)
def characteristics(spark, d):
    return rounded(features.characteristics(tables.daily_events(spark, d)))


@query(
    "recommended_methods",
    f"""WITH {DAILY}, l AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY idx) AS b, avg(value) OVER (PARTITION BY series_id) AS m FROM p),
c AS (SELECT series_id, count(*) AS n, regr_r2(value, idx) AS r2, stddev_pop(value) / avg(value) AS cv, avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END) AS zeros, sum((value - m) * (b - m)) / sum(pow(value - m, 2)) AS acf1 FROM l GROUP BY 1)
SELECT series_id, CASE WHEN n < 10 THEN 'naive' WHEN zeros > 0.3 THEN 'croston' WHEN r2 > 0.5 OR acf1 > 0.5 THEN 'holt' WHEN cv < 0.1 THEN 'mean' ELSE 'theta' END AS method,
CASE WHEN n < 10 THEN 'very short series' WHEN zeros > 0.3 THEN 'intermittent demand' WHEN r2 > 0.5 THEN 'strong trend' WHEN acf1 > 0.5 THEN 'strong persistence' WHEN cv < 0.1 THEN 'stable level' ELSE 'no dominant trait' END AS reason FROM c""",
)
def recommended_methods(spark, d):
    return features.recommend(features.characteristics(tables.daily_events(spark, d)))


@query("ensemble_forecast")
def ensemble_forecast(spark, d):
    return rounded(features.ensemble(tables.daily_events(spark, d), 7, 7))


@query(
    "method_changes",
    f"""WITH {DAILY}, k AS (SELECT *, series_id || '/' || (idx // 7) AS key FROM p),
a AS (SELECT key, round(avg(value), 4) AS mae FROM k WHERE idx < n - 10 GROUP BY 1), b AS (SELECT key, round(avg(value), 4) AS mae FROM k WHERE idx >= 10 GROUP BY 1)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' WHEN abs(a.mae - b.mae) > 1e-10 THEN 'changed' ELSE 'same' END AS change, round(b.mae - a.mae, 4) AS delta
FROM a FULL JOIN b ON a.key = b.key""",
)
def method_changes(spark, d):
    """Two reports by series and week: one made ten days ago, one that leaves the first ten days out; together they hold all days."""
    p = tables.daily_events(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("series_id"))).withColumn("key", F.concat_ws("/", "series_id", F.floor(F.col("idx") / 7).cast("string")))
    report = lambda rows: rows.groupBy("key").agg(F.round(F.avg("value"), 4).alias("mae"))
    return rounded(features.changes(report(p.filter("idx < n - 10")), report(p.filter("idx >= 10")), "key", "mae"))


@query(
    "drift_check",
    f"""WITH {DAILY}, r AS (SELECT series_id, avg(value) AS mean, stddev_samp(value) AS sd, avg(value) FILTER (idx >= n - 10) AS recent FROM p GROUP BY 1)
SELECT series_id, round(abs(recent - mean) / sd, 4) AS z, abs(recent - mean) / sd > 0.2 AS drift FROM r""",
)
def drift_check(spark, d):
    return rounded(features.drift(tables.daily_events(spark, d), 10, 0.2))


@query(
    "stream_daily",
    "SELECT event_type AS series_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS t, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
)
def stream_daily(spark, d):
    from tidemark.streaming import engine

    out = engine.daily_totals(spark, d)
    return rounded(out.select("series_id", F.to_date("t").cast("string").alias("t"), "n", "value"))


@query("stream_forecasts")
def stream_forecasts(spark, d):
    from tidemark.streaming import engine

    return rounded(engine.replay(spark, d))


_MA = """
m0 AS (SELECT *, CASE WHEN idx >= 3 AND idx < n - 3 THEN avg(value) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS m FROM p),
t0 AS (SELECT *, coalesce(m, CASE WHEN idx < 3 THEN first_value(m IGNORE NULLS) OVER w ELSE last_value(m IGNORE NULLS) OVER w END) AS trend0 FROM m0 WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
i0 AS (SELECT *, value - avg(value - trend0) OVER (PARTITION BY series_id, idx % 7) AS plain FROM t0),
m1 AS (SELECT *, CASE WHEN idx >= 3 AND idx < n - 3 THEN avg(plain) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS k FROM i0),
t1 AS (SELECT *, coalesce(k, CASE WHEN idx < 3 THEN first_value(k IGNORE NULLS) OVER w ELSE last_value(k IGNORE NULLS) OVER w END) AS trend FROM m1 WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
s1 AS (SELECT a.series_id, a.idx, avg(b.plain - b.trend) AS smooth FROM t1 a JOIN t1 b ON a.series_id = b.series_id AND a.idx // 7 = b.idx // 7 GROUP BY 1, 2),
d AS (SELECT t1.series_id, t1.idx, n, value, trend, smooth - avg(smooth) OVER (PARTITION BY t1.series_id) AS seasonal FROM t1 JOIN s1 USING (series_id, idx))"""


@query("decomposed", f"WITH {DAILY}, {_MA} SELECT series_id, idx, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal, round(value - trend - seasonal, 4) AS remainder FROM d")
def decomposed(spark, d):
    return longs(rounded(decompose.decomposed(tables.daily_events(spark, d), 7).select("series_id", "idx", "trend", "seasonal", "remainder")), "idx")


@query(
    "decomposed_forecast",
    f"""WITH {DAILY}, {_MA}, f AS (SELECT series_id, any_value(n) AS n, arg_max(trend, idx) AS last, regr_slope(trend, idx) FILTER (idx >= n - 3) AS slope, stddev_pop(value - trend - seasonal) AS sigma FROM d GROUP BY 1)
SELECT f.series_id, h, round(last + h * slope + coalesce(seasonal, 0), 4) AS point, round(last + h * slope + coalesce(seasonal, 0) - 1.2816 * sigma * sqrt(h), 4) AS lower, round(last + h * slope + coalesce(seasonal, 0) + 1.2816 * sigma * sqrt(h), 4) AS upper
FROM f JOIN range(1, 15) r(h) ON true LEFT JOIN d ON d.series_id = f.series_id AND d.idx = (f.n - 1) % 7 + (h - 1) % 7""",
)
def decomposed_forecast(spark, d):
    return longs(rounded(decompose.decomposed_forecast(tables.daily_events(spark, d), 7, 14)), "h")


@query("robust_line")
def robust_line(spark, d):
    return rounded(regress.robust_line(tables.daily_events(spark, d)))


@query(
    "human_errors",
    """WITH q AS (SELECT CAST(l_partkey AS VARCHAR) AS series_id, CAST(l_shipdate AS DATE) AS t, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, value / nullif(lag(value) OVER (PARTITION BY series_id ORDER BY t), 0) AS ratio FROM q),
c AS (SELECT series_id, count(*) AS n, count(*) FILTER (ratio > 10 OR ratio < 0.1) AS jumps, count(*) FILTER (value % 10 = 0) AS tens FROM r GROUP BY 1)
SELECT series_id, 'potential_unit_mismatch' AS kind, 'high' AS severity, jumps AS count FROM c WHERE jumps > 0 UNION ALL SELECT series_id, 'human_adjustment_pattern', 'low', tens FROM c WHERE tens > 0.3 * n""",
)
def human_errors(spark, d):
    line = tables.table(spark, d, "lineitem")
    per = line.groupBy(F.col("l_partkey").cast("string").alias("series_id"), F.to_date("l_shipdate").alias("t")).agg(F.sum("l_quantity").alias("value"))
    return quality.human_errors(tables.indexed(per))


@query(
    "quality_gates",
    f"""WITH {DAILY}, v AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, idx - row_number() OVER (PARTITION BY series_id, value IS NULL ORDER BY idx) AS run FROM p WINDOW w AS (PARTITION BY series_id)),
g AS (SELECT series_id, count(*) AS gaps FROM (SELECT series_id, run FROM v WHERE value IS NULL GROUP BY 1, 2 HAVING count(*) > 2) GROUP BY 1),
c AS (SELECT series_id, count(*) AS n, round(100.0 * count(value) / count(*), 2) AS coverage, count(*) FILTER (sd > 0 AND abs(value - m) / sd > 2.5) AS outliers FROM v GROUP BY 1),
e AS (SELECT c.*, coalesce(gaps, 0) AS gaps, CASE WHEN coalesce(gaps, 0) > 0 THEN 1 ELSE 0 END AS e, CASE WHEN outliers > 0 THEN 1 ELSE 0 END + CASE WHEN coverage < 100 THEN 1 ELSE 0 END AS w FROM c LEFT JOIN g USING (series_id))
SELECT series_id, coverage, gaps, outliers, CASE WHEN e + w > 0 THEN round(100 * (1 - (3 * e + w) / (3.0 * (e + w))), 1) ELSE 100.0 END AS health, coverage >= 95 AND gaps <= 1 AND outliers <= 0.05 * n AS passed FROM e""",
)
def quality_gates(spark, d):
    return quality.gates(tables.daily_events(spark, d))


@query(
    "threshold_alerts",
    f"""WITH {DAILY}, b AS (SELECT *, value > 3300 AS hit, sum(CASE WHEN value > 3300 THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY t) AS run FROM p),
h AS (SELECT *, row_number() OVER (PARTITION BY series_id, run ORDER BY t) AS hits FROM b WHERE hit)
SELECT series_id, CAST(t AS VARCHAR) AS t, round(value, 4) AS value, hits, CASE WHEN hits >= 6 THEN 'critical' WHEN hits >= 3 THEN 'warning' ELSE 'info' END AS level FROM h WHERE hits IN (1, 3, 6) OR (hits - 1) // 2 > (hits - 2) // 2""",
)
def threshold_alerts(spark, d):
    from tidemark.streaming import alerts

    out = alerts.threshold_alerts(tables.daily_events(spark, d), 3300.0, cooldown_seconds=2 * 86_400)
    return longs(rounded(out.withColumn("t", F.col("t").cast("string"))), "hits")


@query(
    "plugin_forecast",
    f"WITH {DAILY} SELECT series_id, CAST(h AS INT) AS h, round(avg(value) + 0.1 * regr_slope(value, idx) * h, 4) AS point FROM p, range(1, 8) r(h) GROUP BY series_id, h",
)
def plugin_forecast(spark, d):
    return rounded(plugins.forecast_with(tables.daily_events(spark, d), "mean_with_slope", 7))


@query("holt_winters_variants")
def holt_winters_variants(spark, d):
    points, out = tables.daily_events(spark, d), None
    for damped in (False, True):
        for multiplicative in (False, True):
            f = models.holt_winters(points, 7, 7, damped=damped, multiplicative=multiplicative).select("series_id", F.lit(damped).alias("damped"), F.lit(multiplicative).alias("multiplicative"), "h", "point", "lower", "upper")
            out = f if out is None else out.unionByName(f)
    return rounded(out)


@query("box_cox_forecast")
def box_cox_forecast(spark, d):
    return rounded(models.box_cox_forecast(tables.daily_events(spark, d), 7))


@query(
    "periodogram",
    f"""WITH {DAILY}, z AS (SELECT series_id, k, any_value(n) AS n, sum(value * cos(-2 * pi() * k * idx / 32)) AS re, sum(value * sin(-2 * pi() * k * idx / 32)) AS im FROM p, range(1, 16) r(k) GROUP BY 1, 2)
SELECT series_id, CAST(k AS INT) AS k, k / 32.0::DOUBLE AS frequency, round((re * re + im * im) / n, 2) AS power FROM z""",
)
def periodogram(spark, d):
    out = features.periodogram(tables.daily_events(spark, d))
    return out.withColumn("power", F.round("power", 2))


@query("elapsed_weekday", f"WITH {DAILY} SELECT series_id, idx, CAST(idx % 7 AS INT) AS weekday, CASE WHEN idx % 7 >= 5 THEN 1 ELSE 0 END AS weekend FROM p")
def elapsed_weekday(spark, d):
    return longs(features.elapsed_weekday(tables.daily_events(spark, d), 86_400_000).select("series_id", "idx", "weekday", "weekend"), "idx")


@query("last_points", f"WITH {DAILY} SELECT series_id, idx, round(value, 4) AS value FROM p WHERE idx >= n - 10")
def last_points(spark, d):
    return longs(rounded(features.last_points(tables.daily_events(spark, d), 10).select("series_id", "idx", "value")), "idx")


@query(
    "error_spikes",
    f"""WITH {DAILY}, e AS (SELECT series_id, avg(value) FILTER (idx >= n - 5) AS recent, avg(value) FILTER (idx < n - 5) AS before FROM p GROUP BY 1)
SELECT series_id, round(recent, 4) AS recent, round(before, 4) AS before, round(recent / before, 4) AS ratio FROM e WHERE recent / before >= 0.9""",
)
def error_spikes(spark, d):
    return rounded(features.error_spikes(tables.daily_events(spark, d), 0.9))


@query(
    "matched_windows",
    f"""WITH {DAILY}, a AS (SELECT series_id, idx AS place, n, avg(value) OVER w AS m, var_samp(value) OVER w AS s2, (last_value(value) OVER w - first_value(value) OVER w) / 4 AS slope FROM p WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
b AS (SELECT * FROM a WHERE place >= 5 AND place + 5 <= n), o AS (SELECT series_id, m AS m0, s2 AS s0, slope AS l0 FROM b WHERE place = 15),
d AS (SELECT series_id, place, sqrt(abs(m - m0) + 0.5 * abs(slope - l0) / (abs(l0) + 1e-9) + 0.3 * abs(s2 - s0) / (abs(s0) + 1e-9)) AS distance FROM b JOIN o USING (series_id) WHERE abs(place - 15) >= 10),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(distance, 9), place) AS rank FROM d)
SELECT series_id, place, round(distance, 4) AS distance, rank FROM r WHERE rank <= 3""",
)
def matched_windows(spark, d):
    return longs(rounded(causal.matched_windows(tables.daily_events(spark, d), 15, 5, 5)), "place", "rank")


@query(
    "natural_experiments",
    f"""WITH {DAILY}, j AS (SELECT *, value - lag(value) OVER w AS jump, avg(value) OVER b AS before, var_samp(value) OVER b AS vb, count(*) OVER b AS nb, avg(value) OVER c AS after, var_samp(value) OVER c AS va, count(*) OVER c AS nc FROM p
WINDOW w AS (PARTITION BY series_id ORDER BY idx), b AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), c AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
m AS (SELECT series_id, median(abs(jump)) AS typical FROM j GROUP BY 1)
SELECT series_id, idx, round(jump, 4) AS jump, round(before, 4) AS before, round(after, 4) AS after, round((after - before) / sqrt((vb + va) / 5), 4) AS t FROM j JOIN m USING (series_id) WHERE abs(jump) >= 1.5 * typical AND nb = 5 AND nc = 5""",
)
def natural_experiments(spark, d):
    return longs(rounded(causal.natural_experiments(tables.daily_events(spark, d), 5, 1.5)), "idx")
