"""Parameters by cross-validation, allocation from the top, weights, prices, densities and cascades."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import norm_cdf
from tidemark.operators.models import FINE
from tidemark.sources import tables
from tidemark.sources.tables import arrays


def tuned_holt(points: DataFrame, folds: int, test: int) -> DataFrame:
    """(series_id, alpha, beta, rmse): the pair of least mean error over rolling origins, the first of equals.

    The last ``folds`` · ``test`` points are tested, ``test`` at a time, each after a fit of all before; shorter series are left out."""
    s = arrays(points).filter(F.col("n") >= folds * test + 4)
    grid = [F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for a in FINE for b in FINE]
    s = s.select("series_id", "n", "y", F.explode(F.array(*grid)).alias("g")).select("series_id", "n", "y", "g.*")
    s = s.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("cut", F.col("n") - (folds - F.col("fold")) * test)
    start = F.struct(F.element_at("y", 1).alias("level"), (F.element_at("y", 2) - F.element_at("y", 1)).alias("trend"))

    def step(state: Column, v: Column) -> Column:
        level = F.col("alpha") * v + (1 - F.col("alpha")) * (state["level"] + state["trend"])
        return F.struct(level.alias("level"), (F.col("beta") * (level - state["level"]) + (1 - F.col("beta")) * state["trend"]).alias("trend"))

    s = s.withColumn("r", F.aggregate(F.slice("y", 2, F.col("cut") - 1), start, step))
    error = F.transform(F.slice("y", F.col("cut") + 1, F.lit(test)), lambda v, i: F.pow(v - F.col("r.level") - (i + 1) * F.col("r.trend"), 2))
    s = s.withColumn("rmse", F.sqrt(F.aggregate(error, F.lit(0.0), lambda a, x: a + x) / test))
    per = s.groupBy("series_id", "alpha", "beta").agg(F.avg("rmse").alias("rmse"))
    best = F.min(F.struct(F.round("rmse", 6).alias("k"), "alpha", "beta", "rmse")).alias("b")
    return per.groupBy("series_id").agg(best).select("series_id", "b.alpha", "b.beta", "b.rmse")


def halved_holt(points: DataFrame, folds: int, test: int, start: int = 36, best: int = 3, seed: int = 1) -> DataFrame:
    """(series_id, alpha, beta, rmse, fits): parameters of Holt's method by successive halving, judged as by ``tuned_holt``.

    Rungs are the rolling origins, from the shortest history on: ``start`` candidates, spread over the grid, are tried on the first, and after each the better ones, fewer by an equal number, go on to the next; what a
    candidate got before counts on. At last the ``best`` ones make a proposal each nearby, tried on all origins. ``fits`` counts fits: with three origins a third of the grid's.
    Proposals depend on (seed, series, parameters) alone. Series of fewer than folds · test + 4 points are left out."""
    s = arrays(points).filter(F.col("n") >= folds * test + 4).select("series_id", "n", "y")
    spread = sorted(((a, b) for a in FINE for b in FINE), key=lambda p: (round(10 * p[0]) * 4 + round(10 * p[1]) * 7) % 9)[:start]
    spread = [F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for a, b in sorted(spread)]
    held = s.select("series_id", F.explode(F.array(*spread)).alias("g"), F.lit(0.0).alias("sum")).select("series_id", "g.*", "sum")
    begin = F.struct(F.element_at("y", 1).alias("level"), (F.element_at("y", 2) - F.element_at("y", 1)).alias("trend"))

    def step(state: Column, v: Column) -> Column:
        level = F.col("alpha") * v + (1 - F.col("alpha")) * (state["level"] + state["trend"])
        return F.struct(level.alias("level"), (F.col("beta") * (level - state["level"]) + (1 - F.col("beta")) * state["trend"]).alias("trend"))

    def tried(candidates: DataFrame, fold: int) -> DataFrame:
        """``candidates`` with the error of one origin added to ``sum``."""
        cut = F.col("n") - (folds - fold) * test
        runs = candidates.join(s, "series_id").withColumn("r", F.aggregate(F.slice("y", 2, cut - 1), begin, step))
        error = F.transform(F.slice("y", cut + 1, F.lit(test)), lambda v, i: F.pow(v - F.col("r.level") - (i + 1) * F.col("r.trend"), 2))
        rmse = F.sqrt(F.aggregate(error, F.lit(0.0), lambda a, x: a + x) / test)
        return runs.select("series_id", "alpha", "beta", (F.col("sum") + rmse).alias("sum"))

    order = Window.partitionBy("series_id").orderBy(F.round("sum", 6), "alpha", "beta")
    top = lambda rows, k: rows.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= k).drop("k")
    fits = 0
    for fold in range(folds):
        size = max(best, start * (folds - fold) // folds)
        held, fits = tried(top(held, size) if fold else held, fold), fits + size
    uniform = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "series_id", "alpha", "beta"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    near = lambda c, salt: F.least(F.greatest(F.col(c) + 0.1 * (uniform(salt) - 0.5), F.lit(0.02)), F.lit(0.98))
    more = top(held, best).select("series_id", near("alpha", 0).alias("alpha"), near("beta", 1).alias("beta"), F.lit(0.0).alias("sum"))
    for fold in range(folds):
        more, fits = tried(more, fold), fits + best
    return top(held.unionByName(more), 1).select("series_id", "alpha", "beta", (F.col("sum") / folds).alias("rmse"), F.lit(fits).alias("fits"))


def top_down(total: DataFrame, leaves: DataFrame, *levels: str) -> DataFrame:
    """(h, levels..., point): ``total`` (h, point) shared among leaves by their part of ``value``; null levels are sums."""
    per = leaves.groupBy(*levels).agg(F.sum("value").alias("v"))
    # the sums come from the leaves' own totals: one row, whatever the size of the history
    share = per.crossJoin(F.broadcast(per.agg(F.sum("v").alias("all")))).select(*levels, (F.col("v") / F.col("all")).alias("share"))
    return share.crossJoin(F.broadcast(total.select("h", "point"))).withColumn("part", F.col("point") * F.col("share")).rollup("h", *levels).agg(F.sum("part").alias("point")).filter("h is not null")


def inverse_variance(points: DataFrame) -> DataFrame:
    """(series_id, weight): weights in inverse proportion to the variance, of sum 1; a constant series has none."""
    per = points.groupBy("series_id").agg(F.var_pop("value").alias("v")).filter("v > 0").withColumn("w", 1 / F.col("v"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("w").alias("all")))).select("series_id", (F.col("w") / F.col("all")).alias("weight"))


def revenue_impact(rows: DataFrame, by: str) -> DataFrame:
    """(by, absolute, percent, quantity_percent) from rows (price, quantity, base_price, base_quantity)."""
    now, base = F.sum(F.col("price") * F.col("quantity")), F.sum(F.col("base_price") * F.col("base_quantity"))
    q, q0 = F.sum("quantity"), F.sum("base_quantity")
    return rows.groupBy(by).agg((now - base).alias("absolute"), (100 * (now - base) / base).alias("percent"), (100 * (q - q0) / q0).alias("quantity_percent"))


def optimal_price(price: Column, elasticity: float, quantity_ratio: float) -> Column:
    """The price that gives ``quantity_ratio`` times the quantity at a constant elasticity."""
    return price * F.pow(F.lit(quantity_ratio), F.lit(1 / elasticity))


def exceedance(forecasts: DataFrame, limit: Column, z: float) -> DataFrame:
    """Adds sd, density (at ``limit``) and p_above to normal forecasts (point, upper = point + z·sd)."""
    at = (limit - F.col("point")) / F.col("sd")
    out = forecasts.withColumn("sd", (F.col("upper") - F.col("point")) / z)
    return out.withColumn("density", F.exp(-at * at / 2) / (F.col("sd") * math.sqrt(2 * math.pi))).withColumn("p_above", 1 - norm_cdf(at))


def cascade(edges: DataFrame, start: DataFrame, seed: int = 1) -> DataFrame:
    """(node, round): what a disruption of ``start`` (node) reaches over ``edges`` (src, dst, p), each passed with its chance.

    Whether an edge passes depends on (seed, src, dst) alone. Every node is reached once, so that cycles end."""
    tables.shared_dir(edges.sparkSession)
    draw = (F.pmod(F.xxhash64(F.lit(seed), "src", "dst"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    open_edges = edges.filter(draw < F.col("p")).select("src", "dst")
    found = start.select("node", F.lit(0).alias("round")).distinct().checkpoint()
    front = found
    for k in itertools.count(1):  # ends when nothing new is reached
        front = open_edges.join(front, open_edges["src"] == front["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
        front = front.join(found, "node", "left_anti").withColumn("round", F.lit(k)).checkpoint()
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found
