"""Several series together: panels, hierarchies, lagged correlation, vector autoregression, factors, reconciliation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def panel(points: DataFrame, category: str) -> DataFrame:
    """(category, mean, median, std, min, max, n) over all and by category; the overall row's category is null."""
    v = F.col("value")
    stats = [F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count("*").alias("n")]
    return points.groupingSets([[F.col(category)], []], F.col(category)).agg(*stats).withColumnRenamed(category, "category")


def roll_up(leaves: DataFrame, *levels: str) -> DataFrame:
    """Sums of ``value`` of every node of the hierarchy ``levels``; levels below a node are null."""
    return leaves.rollup(*levels).agg(F.sum("value").alias("value"), F.grouping_id().alias("below"))


#: Steps of a block and series of a tile: a task holds two tiles of one block and its lags on either side.
STEPS, TILE = 2048, 256


def lagged_correlation(points: DataFrame, max_lag: int) -> DataFrame:
    """(a, b, lag, r, n) of all pairs a < b: b at t against a at t - lag, for lags of either sign. Null values are left out.

    Time is cut into blocks and series into tiles; a task multiplies two tiles of a block, so that sums per block are
    shuffled, never pairs of single steps. Values count from their series' mean, which keeps the sums exact enough."""
    mean = points.groupBy("series_id").agg(F.avg("value").alias("mean"))
    tiles = max(1, -(-mean.count() // TILE))
    v = points.join(mean, "series_id").filter("value is not null").select("series_id", "idx", (F.col("value") - F.col("mean")).alias("v"), F.pmod(F.xxhash64("series_id"), F.lit(tiles)).cast("int").alias("tile"))
    near = F.floor(F.col("idx") / STEPS)
    halo = F.sequence(F.floor((F.col("idx") - max_lag) / STEPS), F.floor((F.col("idx") + max_lag) / STEPS))
    x = v.select("series_id", "idx", "v", F.lit(0).alias("side"), near.alias("block"), F.col("tile").alias("i"), F.explode(F.sequence("tile", F.lit(tiles - 1))).alias("j"))
    y = v.withColumn("i", F.explode(F.sequence(F.lit(0), "tile"))).select("series_id", "idx", "v", F.lit(1).alias("side"), F.explode(halo).alias("block"), "i", F.col("tile").alias("j"))
    lags = range(-max_lag, max_lag + 1)

    def sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block, i, j = key
        held, names = [], []
        for side, width, before in ((0, STEPS, 0), (1, STEPS + 2 * max_lag, max_lag)):
            part = rows[rows["side"] == side]
            codes, order = pd.factorize(part["series_id"], sort=True)
            m = np.full((len(order), width), np.nan)
            m[codes, part["idx"].to_numpy() - block * STEPS + before] = part["v"].to_numpy()
            held.append(m)
            names.append(order.to_numpy(dtype=object))
        (p, q), (left, right) = held, names
        first = left[:, None] < right[None, :]
        wanted = first if i == j else np.ones_like(first)
        has, p = (~np.isnan(p)).astype(float), np.nan_to_num(p)
        has_q, q = (~np.isnan(q)).astype(float), np.nan_to_num(q)
        out = []
        for d in lags:
            at = slice(max_lag + d, max_lag + d + STEPS)
            n = has @ has_q[:, at].T
            r, c = np.nonzero(wanted & (n > 0))
            s = [m[r, c] for m in (n, p @ has_q[:, at].T, has @ q[:, at].T, (p * p) @ has_q[:, at].T, has @ (q[:, at] * q[:, at]).T, p @ q[:, at].T)]
            f = first[r, c]
            out.append(pd.DataFrame({"a": np.where(f, left[r], right[c]), "b": np.where(f, right[c], left[r]), "lag": np.where(f, d, -d), "n": s[0].astype("int64"), "x": np.where(f, s[1], s[2]), "y": np.where(f, s[2], s[1]), "xx": np.where(f, s[3], s[4]), "yy": np.where(f, s[4], s[3]), "xy": s[5]}))
        return pd.concat(out)

    parts = x.unionByName(y).groupBy("block", "i", "j").applyInPandas(sums, "a string, b string, lag int, n bigint, x double, y double, xx double, yy double, xy double")
    out = parts.groupBy("a", "b", "lag").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy"))).filter("n >= 3")
    spread = lambda s, ss: F.when(F.col("n") * F.col(ss) - F.col(s) * F.col(s) > 1e-12 * F.col("n") * F.col(ss), F.col("n") * F.col(ss) - F.col(s) * F.col(s))
    return out.select("a", "b", "lag", ((F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(spread("x", "xx")) / F.sqrt(spread("y", "yy"))).alias("r"), "n")


def best_lags(correlations: DataFrame) -> DataFrame:
    """(a, b, lag, r, strength): the lag of the largest |r|, of equals the nearest to 0."""
    order = Window.partitionBy("a", "b").orderBy(F.round(F.abs("r"), 9).desc(), F.abs("lag"), "lag")
    out = correlations.filter("r is not null").withColumn("k", F.row_number().over(order)).filter("k = 1")
    strength = F.when(F.abs("r") >= 0.9, "very strong").when(F.abs("r") >= 0.7, "strong").when(F.abs("r") >= 0.5, "moderate").otherwise("weak")
    return out.select("a", "b", "lag", "r", strength.alias("strength"))


def _wide(points: DataFrame, names: list[str]) -> DataFrame:
    return points.groupBy("idx").pivot("series_id", names).agg(F.first("value")).dropna()


def var_forecast(points: DataFrame, names: list[str], order: int, horizon: int) -> DataFrame:
    """(series_id, h, point) of a vector autoregression of the few series named.

    Each value goes to its own step and to the ``order`` steps after it, so that grouping by step gives rows with their lags:
    one shuffle, no order over the whole. Rows that lack a value, or one at a lag, teach nothing; h counts from the last step whose lags
    are all known. The normal equations are sums over all rows, made by Spark; the driver solves a matrix of 1 + names·order
    rows. Without a row that teaches, or without names, the result is empty."""
    k = len(names)
    lags = range(order + 1)
    schema = "series_id string, h int, point double"
    if not names:
        return points.sparkSession.createDataFrame([], schema)
    spread = points.filter(F.col("series_id").isin(names) & F.col("value").isNotNull()).select("series_id", "value", F.explode(F.array(*map(F.lit, lags))).alias("lag"), "idx")
    cell = lambda n, lag: F.max(F.when((F.col("series_id") == n) & (F.col("lag") == lag), F.col("value").cast("double")))
    wide = spread.groupBy((F.col("idx") + F.col("lag")).alias("idx")).agg(*(cell(n, lag).alias(f"x{lag}_{i}") for lag in lags for i, n in enumerate(names)))
    past = [f"x{lag}_{i}" for lag in range(1, order + 1) for i in range(k)]
    now = [f"x0_{i}" for i in range(k)]
    design = [F.lit(1.0), *map(F.col, past)]
    taught = F.forall(F.array(*map(F.col, now)), lambda v: v.isNotNull())
    m, every = len(design), design + [F.col(c) for c in now]
    sums = wide.dropna(subset=past).agg(F.count_if(taught).alias("n"), F.max_by(F.array(*map(F.col, past)), "idx").alias("last"), *(F.sum(F.when(taught, a * b)).alias(f"s{i}_{j}") for i, a in enumerate(design) for j, b in enumerate(every))).head()
    if not sums["n"]:
        return points.sparkSession.createDataFrame([], schema)
    xx = np.array([[sums[f"s{i}_{j}"] for j in range(m)] for i in range(m)], float)
    xy = np.array([[sums[f"s{i}_{m + j}"] for j in range(k)] for i in range(m)], float)
    beta = np.linalg.solve(xx + 1e-8 * np.trace(xx) / m * np.eye(m), xy)
    last = list(sums["last"])
    out = []
    for h in range(1, horizon + 1):
        y = np.concatenate([[1.0], last]) @ beta
        last = [*y, *last][: k * order]
        out += [(n, h, float(v)) for n, v in zip(names, y, strict=True)]
    return points.sparkSession.createDataFrame(out, schema)


def factors(points: DataFrame, names: list[str], k: int) -> DataFrame:
    """(factor, series_id, loading, share): principal components of the correlation matrix, of which the largest loading is positive."""
    wide = _wide(points, names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = wide.agg(*(F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs))).head()
    c = np.eye(len(names))
    for i, (a, b) in enumerate(pairs):
        c[names.index(a), names.index(b)] = c[names.index(b), names.index(a)] = row[f"{i}"]
    values, vectors = np.linalg.eigh(c)
    out = []
    for f, at in enumerate(np.argsort(-values)[:k]):
        v = vectors[:, at] * np.sign(vectors[np.argmax(np.abs(vectors[:, at])), at])
        out += [(f + 1, n, float(x), float(values[at] / len(names))) for n, x in zip(names, v, strict=True)]
    return points.sparkSession.createDataFrame(out, "factor int, series_id string, loading double, share double")


def reconcile(base: DataFrame, parents: dict[str, str | None], variances: dict[str, float] | None = None) -> DataFrame:
    """(node, h, point, reconciled): base forecasts (node, h, point) made coherent by weighted least squares on the hierarchy.

    ``parents`` names each node's parent (None for a top). An inner node without a forecast at a step follows from its
    children; a step that lacks a leaf has null in all rows. Steps are independent and spread over tasks. On a tree the
    least squares need no matrix: estimates are merged upwards by their variances and differences shared out downwards,
    in time and memory linear in the nodes."""
    children: dict[str, list[str]] = {n: [] for n in parents}
    for node, parent in parents.items():
        if parent is not None:
            children[parent].append(node)
    downward = [n for n, p in parents.items() if p is None]
    for node in downward:
        downward += children[node]
    if len(downward) < len(parents):
        raise ValueError("the hierarchy has a cycle")
    own = {n: (variances or {}).get(n, 1.0) for n in parents}

    def coherent(given: dict[str, float]) -> dict[str, float]:
        mean, spread, sums = {}, {}, {}
        for node in reversed(downward):
            y, v = given.get(node), own[node]
            if not children[node]:
                if y is None:
                    return {}
                mean[node], spread[node] = y, v
                continue
            m, s = sums[node] = sum(mean[c] for c in children[node]), sum(spread[c] for c in children[node])
            mean[node], spread[node] = (m, s) if y is None else ((y * s + m * v) / (s + v), s * v / (s + v))
        out = {}
        for node in downward:
            parent = parents[node]
            if parent is None:
                out[node] = mean[node]
            else:
                m, s = sums[parent]
                out[node] = mean[node] + spread[node] / s * (out[parent] - m)
        return out

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for h, got in zip(batch["h"], batch["got"], strict=True):
                by = {x["node"]: x["point"] for x in got if x["point"] is not None}
                fit = coherent(by)
                yield pd.DataFrame({"node": downward, "h": h, "point": [by.get(n) for n in downward], "reconciled": [fit.get(n) for n in downward]})

    grouped = base.groupBy("h").agg(F.collect_list(F.struct("node", "point")).alias("got"))
    return grouped.mapInPandas(solve, "node string, h int, point double, reconciled double")
