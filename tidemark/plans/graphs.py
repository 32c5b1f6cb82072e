"""Queries of hierarchies as tables, of causal graphs, of factors and of routed repairs, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import holidays
from tidemark.operators import causal_graph, factor_models, hierarchy, routing, tuning
from tidemark.plans.more import DAILY, ORDERS, rounded
from tidemark.sources import tables
from tidemark.sources.snapshots import Snapshots
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


# eleven levels: the world, region, nation, segment, sign of the balance, five halvings of the customers, the customer
_LEVELS = ["'world'", "r_name", "n_name", "c_mktsegment", "CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END", *(f"CAST(c_custkey % {k} AS STRING)" for k in (2, 4, 8, 16, 32)), "CAST(c_custkey AS STRING)"]
DEEPEST = len(_LEVELS) - 1


def _paths(spark, d):
    """(c_custkey, n0 … n10): the names of a customer's node of each level, which hold those above."""
    c, n, r = (tables.table(spark, d, x) for x in ("customer", "nation", "region"))
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    parts = [F.expr(x) for x in _LEVELS]
    return rows.select("c_custkey", *(F.concat_ws("/", *parts[: k + 1]).alias(f"n{k}") for k in range(DEEPEST + 1)))


def _customer_tree(spark, d):
    """(edges, base, variances): inner nodes expect their own revenue of 1996 or 1997, customers the mean of their years; a level's variance is its height."""
    paths = _paths(spark, d)
    pairs = [F.struct(F.col(f"n{k}").alias("node"), (F.col(f"n{k - 1}") if k else F.lit(None).cast("string")).alias("parent"), F.lit(float(DEEPEST - k + 1)).alias("variance")) for k in range(DEEPEST + 1)]
    tree = paths.select(F.explode(F.array(*pairs)).alias("e")).select("e.*").distinct()
    years = tables.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("v"))
    per = paths.join(years, "c_custkey", "left")
    inner = per.filter(F.col("year").between(1996, 1997)).select((F.col("year") - 1995).alias("h"), "v", F.explode(F.array(*(f"n{k}" for k in range(DEEPEST)))).alias("node")).groupBy("node", "h").agg(F.sum("v").alias("point"))
    leaf = per.groupBy(F.col(f"n{DEEPEST}").alias("node")).agg(F.coalesce(F.sum("v") / 7, F.lit(0.0)).alias("point")).withColumn("h", F.explode(F.array(F.lit(1), F.lit(2)))).select("node", "h", "point")
    return tree.select("node", "parent"), inner.unionByName(leaf), tree.select("node", "variance")


_DUCK = [x.replace("STRING", "VARCHAR") for x in _LEVELS]
_NODES = ", ".join(f"concat_ws('/', {', '.join(_DUCK[: k + 1])}) AS n{k}" for k in range(DEEPEST + 1))
_PATHS = f"paths AS (SELECT c_custkey, {_NODES} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_YEARS = "years AS (SELECT o_custkey AS c_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), per AS (SELECT * FROM paths LEFT JOIN years USING (c_custkey))"


@query(
    "tree_totals",
    f"""WITH {_PATHS}, o AS (SELECT o_custkey AS c_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1), l AS (SELECT * FROM paths JOIN o USING (c_custkey))
{" UNION ALL ".join(f"SELECT n{k} AS node, round(sum(v), 2) AS value, count(*) AS leaves FROM l GROUP BY 1" for k in range(DEEPEST + 1))}""",
)
def tree_totals(spark, d):
    """Revenue of every node of a tree of eleven levels, by a join of the customers with their ancestors."""
    edges, _, _ = _customer_tree(spark, d)
    orders = tables.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("value"))
    leaves = _paths(spark, d).join(orders, "c_custkey").select(F.col(f"n{DEEPEST}").alias("node"), "value")
    return rounded(hierarchy.roll_up_tree(leaves, edges), 2)


def _reconcile_sql() -> str:
    parts = [_PATHS, _YEARS, "hs AS (SELECT unnest([1, 2]) AS h)"]
    for k in range(DEEPEST + 1):
        above = f"n{k - 1}" if k else "NULL::VARCHAR"
        own = f"sum(v) FILTER (y = 1995 + h)" if k < DEEPEST else "coalesce(sum(v) / 7, 0)"
        parts.append(f"g{k} AS (SELECT n{k} AS node, any_value({above}) AS parent, h, {own} AS point, {float(DEEPEST - k + 1)}::DOUBLE AS v FROM per, hs GROUP BY 1, 3)")
    for k in range(DEEPEST, -1, -1):
        if k == DEEPEST:
            parts.append(f"u{k} AS (SELECT *, NULL::DOUBLE AS m, NULL::DOUBLE AS s, point AS mean, v AS spread FROM g{k})")
        else:
            parts.append(f"u{k} AS (SELECT g.*, m, s, CASE WHEN point IS NULL THEN m ELSE (point * s + m * v) / (s + v) END AS mean, CASE WHEN point IS NULL THEN s ELSE s * v / (s + v) END AS spread FROM g{k} g JOIN (SELECT parent AS node, h, sum(mean) AS m, sum(spread) AS s FROM u{k + 1} GROUP BY 1, 2) USING (node, h))")
    parts.append("d0 AS (SELECT *, mean AS reconciled FROM u0)")
    parts += [f"d{k} AS (SELECT u.*, u.mean + u.spread / a.s * (a.reconciled - a.m) AS reconciled FROM u{k} u JOIN d{k - 1} a ON a.node = u.parent AND a.h = u.h)" for k in range(1, DEEPEST + 1)]
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT node, h, round(point, 2) AS point, round(reconciled, 2) AS reconciled FROM d{k}" for k in range(DEEPEST + 1))


@query("reconciled_tree", _reconcile_sql())
def reconciled_tree(spark, d):
    """Forecasts of two years of all nodes of a tree of eleven levels, made coherent."""
    edges, base, variances = _customer_tree(spark, d)
    return rounded(hierarchy.reconcile_tree(base, edges, variances), 2)


def causal_sql(points: str, max_lag: int, ar_lag: int) -> str:
    """CTEs that end in ``edge``: (a, b, lag, r, effect, f, df1, df2, p, stability, confidence) of the series in ``p``. The regressions are solved by elimination, a step for each column."""
    most, m = max(max_lag, ar_lag), 1 + ar_lag + max_lag + 2
    columns = ["1.0::DOUBLE", *(f"y{k}" for k in range(1, ar_lag + 1)), *(f"x{k}" for k in range(max_lag + 1)), "y0"]
    gram = ", ".join(f"sum({u} * {w})" for u in columns for w in columns)
    lagged = lambda c, n: ", ".join(f"lag(v, {k}) OVER w AS {c}{k}" for k in range(1, n + 1))
    parts = [
        points,
        "cut AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM p GROUP BY series_id))",
        "ln AS (SELECT series_id, regr_slope(value, idx) AS slope, regr_intercept(value, idx) AS level FROM p, cut WHERE idx < cut.n GROUP BY 1)",
        "v AS (SELECT series_id, idx, value - level - slope * idx AS v FROM p JOIN ln USING (series_id), cut WHERE idx < cut.n)",
        "sds AS (SELECT series_id, stddev_samp(v) AS sd FROM v GROUP BY 1)",
        f"xs AS (SELECT series_id AS a, idx, v AS x0, {lagged('x', max_lag)} FROM v WINDOW w AS (PARTITION BY series_id ORDER BY idx))",
        f"ys AS (SELECT series_id AS b, idx, v AS y0, {lagged('y', ar_lag)} FROM v WINDOW w AS (PARTITION BY series_id ORDER BY idx))",
        f"st AS (SELECT *, (idx - {most}) // ((cut.n - {most}) // 4) AS quarter FROM xs JOIN ys USING (idx), cut WHERE a <> b AND idx >= {most})",
        f"g0 AS (SELECT a, b, count(*) AS used, [{gram}] AS g FROM st GROUP BY 1, 2)",
    ]
    for k in range(m - 1):
        kept = f", g[{m * m}] AS small" if k == 1 + ar_lag else (", small" if k > 1 + ar_lag else "")
        parts.append(f"g{k + 1} AS (SELECT a, b, used, list_transform(range({m * m}), lambda x: g[x + 1] - g[(x // {m}) * {m} + {k + 1}] * g[{k * m} + x % {m} + 1] / g[{k * m + k + 1}]) AS g{kept} FROM g{k})")
    profile = " UNION ALL ".join(f"SELECT a, b, {k} AS lag, corr(x{k}, y0) AS r FROM st GROUP BY 1, 2" for k in range(max_lag + 1))
    pick = "CASE lag " + " ".join(f"WHEN {k} THEN x{k}" for k in range(max_lag + 1)) + " END"
    df1 = max_lag + 1
    parts += [
        f"pr AS ({profile})",
        "top AS (SELECT a, b, lag, r FROM pr QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY abs(r) DESC, lag) = 1)",
        f"qs AS (SELECT a, b, any_value(r) AS r, corr({pick}, y0) AS rq FROM st JOIN top USING (a, b) WHERE quarter < 4 AND (n - {most}) // 4 >= 8 GROUP BY a, b, quarter)",
        "sta AS (SELECT a, b, avg((sign(r) = sign(rq))::INT) AS stability FROM qs GROUP BY 1, 2)",
        f"ft AS (SELECT a, b, ((small - g[{m * m}]) / {df1}) / (g[{m * m}] / (used - {m - 1})) AS f, {df1} AS df1, used - {m - 1} AS df2 FROM g{m - 1})",
        "edge AS (SELECT a, b, lag, r, r * sb.sd / sa.sd AS effect, f, df1, df2, df2 / (df2 + df1 * f) AS x, coalesce(stability, 0.0) AS stability, least(1.0, 0.6 * abs(r) + 0.4 * coalesce(stability, 0.0)) AS confidence FROM top JOIN ft USING (a, b) LEFT JOIN sta USING (a, b) JOIN sds sa ON sa.series_id = a JOIN sds sb ON sb.series_id = b)",
        # the incomplete beta function of whole halves is a finite sum
        "told AS (SELECT *, CASE WHEN df1 % 2 = 0 THEN list_sum(list_transform(range(df1 // 2), lambda j: exp(lgamma((df1 + df2) / 2.0) - lgamma(j + 1) - lgamma((df1 + df2) / 2.0 - j) + j * ln(1 - x) + ((df1 + df2) / 2.0 - 1 - j) * ln(x)))) END AS p FROM edge)",
    ]
    return ", ".join(parts)


@query(
    "granger_edges",
    f"WITH {causal_sql(DAILY, 3, 2)} SELECT a, b, CAST(lag AS INT) AS lag, round(r, 4) AS r, round(effect, 4) AS effect, round(f, 4) AS f, CAST(df1 AS INT) AS df1, CAST(df2 AS INT) AS df2, round(p, 4) AS p FROM told",
)
def granger_edges(spark, d):
    out = causal_graph.edges(tables.daily_events(spark, d), 3, 2)
    return rounded(out.select("a", "b", "lag", "r", "effect", "f", "df1", "df2", "p"))


_HOURS = "hv AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS t, sum(value) AS value FROM events GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS idx FROM hv)"


@query(
    "causal_graph",
    f"""WITH {causal_sql(_HOURS, 5, 4)}, d AS (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY round(confidence, 12) DESC, a) AS place, p < 0.2 AS significant FROM told)
SELECT a, b, CAST(lag AS INT) AS lag, round(r, 4) AS r, round(effect, 4) AS effect, round(f, 4) AS f, round(p, 4) AS p, round(stability, 2) AS stability, round(confidence, 4) AS confidence, significant, CASE WHEN place = 1 THEN 'forward' ELSE 'reverse' END AS direction, true AS feedback FROM d""",
)
def causal_graph_edges(spark, d):
    """All edges between the event types' hourly totals, with direction; those with p below 0.2 are flagged."""
    points = tables.indexed(tables.table(spark, d, "events").groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("t")).agg(F.sum("value").alias("value")))
    found = causal_graph.discoveries(causal_graph.edges(points, 5, 4), 0.2, include_all=True)
    return rounded(found.select("a", "b", "lag", "r", "effect", "f", "p", F.round("stability", 2).alias("stability"), "confidence", "significant", "direction", "feedback"))


_NAMED = [(n.rsplit("-", 1)[0], f"{start:%Y-%m-%d}", days, decay) for n, start, days, decay in holidays.calendar_rows(1992, 1998)]
_CALENDAR = "hol AS (SELECT name, start::DATE AS start, dur, decay FROM (VALUES " + ", ".join(map(str, _NAMED)) + ") v(name, start, dur, decay))"


def _holidays(spark):
    """The calendar, holidays of all years under one name."""
    return holidays.holidays(spark, 1992, 1998).withColumn("name", F.expr("left(name, length(name) - 5)"))


@query("holidays", f"WITH {_CALENDAR} SELECT name, CAST(start AS VARCHAR) AS start, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS revenue FROM hol LEFT JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN start AND start + dur - 1 GROUP BY 1, 2")
def holiday_revenue(spark, d):
    """Orders and revenue of each holiday of seven years."""
    days = _holidays(spark).withColumn("day", F.explode(F.sequence("start", F.date_add("start", F.col("duration") - 1))))
    orders = tables.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))
    out = days.join(orders, "day", "left").groupBy("name", F.col("start").cast("string").alias("start")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orders"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("revenue"))
    return rounded(out, 2)


def factor_sql(last: str) -> str:
    """Daily revenue, in thousands, on a line, two harmonics of the year and the holidays, by elimination column by column."""
    names = sorted({n for n, *_ in _NAMED})
    at, half = "(idx - s)", "dur / 2.0"
    kernel = f"""CASE decay WHEN 'box' THEN 1.0 WHEN 'exponential' THEN exp(-{at} / greatest(dur / 3.0, 0.5)) WHEN 'triangular' THEN CASE WHEN {at} < {half} THEN {at} / greatest({half}, 0.5) ELSE (dur - {at}) / greatest({at} - {half}, 0.5) END
WHEN 'gaussian' THEN exp(-0.5 * pow(({at} - {half}) / greatest(dur / 4.0, 0.5), 2)) END"""
    waves = [f"{f}(2 * pi() * {k} / 365.25 * idx)" for k in (1, 2) for f in ("sin", "cos")]
    columns = ["1.0::DOUBLE", "idx::DOUBLE", *waves, *(f"coalesce(max(w) FILTER (name = '{n}'), 0)" for n in names), "any_value(value)"]
    labels = ["(intercept)", "(trend)", *(f"({f} {k})" for k in (1, 2) for f in ("sin", "cos")), *names]
    m = len(columns)
    gram = ", ".join(f"sum(c{i} * c{j})" for i in range(m) for j in range(m))
    parts = [
        ORDERS.replace("sum(o_totalprice)", "sum(o_totalprice) / 1000"),
        _CALENDAR,
        "pl AS (SELECT hol.*, (SELECT min(idx) FROM p WHERE p.t >= hol.start) AS s FROM hol, (SELECT min(t) AS lo, max(t) AS hi FROM p) WHERE start BETWEEN lo AND hi)",
        f"ws AS (SELECT idx, name, sum({kernel}) AS w FROM pl JOIN p ON (decay = 'gaussian' OR idx >= s) AND (decay NOT IN ('box', 'triangular') OR idx < s + dur) GROUP BY 1, 2)",
        f"x AS (SELECT {', '.join(f'{c} AS c{k}' for k, c in enumerate(columns))} FROM p LEFT JOIN ws USING (idx) GROUP BY idx)",
        f"raw AS (SELECT count(*) AS n, [{gram}] AS g FROM x)",
        f"g0 AS (SELECT n, g AS raw, list_transform(range({m * m}), lambda x: g[x + 1] / sqrt(g[(x // {m}) * {m + 1} + 1] * g[(x % {m}) * {m + 1} + 1])) AS g FROM raw)",
    ]
    parts += [f"g{k + 1} AS (SELECT n, raw, list_transform(range({m * m}), lambda x: CASE WHEN x // {m} = {k} THEN g[x + 1] / g[{k * m + k + 1}] ELSE g[x + 1] - g[(x // {m}) * {m} + {k + 1}] * g[{k * m} + x % {m} + 1] / g[{k * m + k + 1}] END) AS g FROM g{k})" for k in range(m - 1)]
    rows = " UNION ALL ".join(f"SELECT '{label}' AS factor, g[{j * m + m}] * sqrt(raw[{m * m}] / raw[{j * m + j + 1}]) AS coefficient, sqrt((raw[{j * m + j + 1}] - raw[{j + 1}] * raw[{j + 1}] / n) / (n - 1)) AS sd, 1 - g[{m * m}] * raw[{m * m}] / (raw[{m * m}] - raw[{m}] * raw[{m}] / n) AS r2 FROM g{m - 1}" for j, label in enumerate(labels))
    return f"WITH {', '.join(parts)}, f AS ({rows}) {last}"


@query(
    "factor_effects",
    factor_sql("SELECT 'orders' AS series_id, factor, 'kept' AS status, round(coefficient, 3) AS coefficient, round(abs(coefficient) * sd, 3) AS impact, row_number() OVER (ORDER BY round(abs(coefficient) * sd, 9) DESC, factor) AS rank, round(r2, 4) AS r2 FROM f WHERE factor NOT LIKE '(%'"),
)
def factor_effects(spark, d):
    """What each holiday does to daily revenue, in thousands, beside a line and two harmonics of the year; the strongest first."""
    points = tables.daily_orders(spark, d).withColumn("value", F.col("value") / 1000)
    fit = factor_models.factor_fit(factor_models.Design(points, _holidays(spark), season=365.25, harmonics=2))
    out = factor_models.ranked_factors(fit)
    return out.select("series_id", "factor", "status", F.round("coefficient", 3).alias("coefficient"), F.round("impact", 3).alias("impact"), F.col("rank").cast("bigint").alias("rank"), F.round("r2", 4).alias("r2"))


@query("common_factors")
def common_factors(spark, d):
    """Three factors of the revenue of 125 series by month: their value at each step, and the share of variance."""
    loadings, scores = factor_models.common_factors(tables.monthly_revenue(spark, d), 3)
    shares = loadings.groupBy("factor").agg(F.first("share").alias("share"), F.max_by("series_id", "loading").alias("largest"))
    return rounded(scores.join(shares, "factor"), 3)


# holes: of view six days in a row, of purchase every eleventh, of click every fourth
_HOLED = f"{DAILY}, h AS (SELECT series_id, idx, CASE WHEN series_id = 'view' AND idx BETWEEN 10 AND 15 OR series_id = 'purchase' AND idx % 11 = 3 OR series_id = 'click' AND idx % 4 = 1 THEN NULL ELSE value END AS value FROM p)"
_GATES = routing.Gates(coverage=75.0, outliers=0.1)


@query(
    "routed_series",
    f"""WITH {_HOLED}, r AS (SELECT *, CASE WHEN value IS NULL THEN idx - row_number() OVER (PARTITION BY series_id, value IS NULL ORDER BY idx) END AS run FROM h),
l AS (SELECT series_id, run, count(*) AS len FROM r WHERE value IS NULL GROUP BY 1, 2), z AS (SELECT *, abs(value - avg(value) OVER (PARTITION BY series_id)) / stddev_pop(value) OVER (PARTITION BY series_id) AS z FROM h),
c AS (SELECT series_id, count(*) AS n, count(*) - count(value) AS missing, count(*) FILTER (z > 2.5) AS outliers FROM z GROUP BY 1), g AS (SELECT series_id, count(*) FILTER (len > 2) AS gaps, max(len) AS longest FROM l GROUP BY 1),
f AS (SELECT c.*, coalesce(gaps, 0) AS gaps, coalesce(longest, 0) AS longest, concat_ws(',', CASE WHEN n < 10 THEN 'too_short' END, CASE WHEN 100 * (n - missing) < 75.0 * n THEN 'coverage' END, CASE WHEN gaps > 1 THEN 'gaps' END, CASE WHEN outliers > 0.1 * n THEN 'outliers' END) AS reasons FROM c LEFT JOIN g USING (series_id)),
t AS (SELECT *, CASE WHEN reasons <> '' THEN 'rejected' WHEN missing = 0 THEN 'clean' WHEN longest > 2 THEN 'seasonal' ELSE 'linear' END AS route FROM f),
w AS (SELECT h.*, avg(value) OVER (PARTITION BY series_id, idx % 7) AS phase, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, first_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM h),
x AS (SELECT w.series_id, coalesce(value, CASE route WHEN 'linear' THEN (coalesce(l, r) + coalesce(r, l)) / 2 WHEN 'seasonal' THEN coalesce(phase, (coalesce(l, r) + coalesce(r, l)) / 2) END) AS made, value FROM w JOIN t USING (series_id))
SELECT series_id, route, reasons, n, missing, gaps, outliers, round(100.0 * (n - missing) / n, 2) AS coverage, count(*) FILTER (value IS NULL AND made IS NOT NULL) AS repaired, CASE WHEN route = 'rejected' THEN 'inspect' WHEN outliers > 0 THEN 'review_outliers' ELSE 'forecast' END AS next_step, round(sum(made), 3) AS total
FROM t JOIN x USING (series_id) GROUP BY ALL""",
)
def routed_series(spark, d):
    """Daily totals with holes, each series by its own gates to its own repair; handed over as a version."""
    hole = F.expr("series_id = 'view' AND idx BETWEEN 10 AND 15 OR series_id = 'purchase' AND idx % 11 = 3 OR series_id = 'click' AND idx % 4 = 1")
    points = tables.daily_events(spark, d).select("series_id", "idx", F.when(~hole, F.col("value")).alias("value"))
    run = routing.Pipeline(Snapshots(spark, _folder(spark, "routed")), _GATES)
    report, left = run.run(points, "daily")
    if not report["ok"]:
        raise ValueError(", ".join(report["failed"]))
    totals = left.groupBy("series_id").agg(F.sum("value").alias("total"))
    known = points.groupBy("series_id").agg(F.sum("value").alias("known"))
    out = routing.routes(routing.routed(points, _GATES)).join(totals, "series_id", "left").join(known, "series_id")
    return out.select("series_id", "route", "reasons", "n", "missing", "gaps", "outliers", "coverage", "repaired", "next_step", F.round(F.coalesce("total", "known"), 3).alias("total"))


@query("halved_holt")
def halved_holt(spark, d):
    """Holt's parameters of the event types by successive halving over three rolling origins."""
    return rounded(tuning.halved_holt(tables.daily_events(spark, d), 3, 5))
