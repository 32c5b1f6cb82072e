"""A graph of lagged relations between all pairs of series, from sums of lagged products.

Everything a test of a pair needs (correlation by lag, the regression on the target's own past with and without the other's lags, signs by
quarter) follows from sums over time of products u[t-i]·w[t-j]. Time is cut into blocks and series into tiles; a task multiplies
two tiles of a block for every pair of lags, so that sums per block are shuffled, never steps of pairs. Pairs are then solved in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.significance import f_p_value
from tidemark.operators.hierarchy import _stored
from tidemark.operators.multi import STEPS, TILE

#: Quarters of time in which the sign of a correlation is looked at, and their least length.
QUARTERS, LEAST_QUARTER = 4, 8
#: Least steps and degrees of freedom of a test.
LEAST_USED, LEAST_FREE = 25, 8


def aligned(points: DataFrame, season: int | None = None) -> tuple[DataFrame, int]:
    """((series_id, idx, v), n): the first n steps of all series, n the shortest one's, less their line and, with ``season``, their phases' means. Null values become 0, the line."""
    n = points.groupBy("series_id").agg(F.count("*").alias("n")).agg(F.min("n")).head()[0] or 0
    p = points.filter(F.col("idx") < n).select("series_id", "idx", F.col("value").cast("double").alias("value"))
    x = F.col("idx").cast("double")
    line = p.groupBy("series_id").agg(F.regr_slope("value", x).alias("slope"), F.regr_intercept("value", x).alias("level"))
    p = p.join(line, "series_id").select("series_id", "idx", F.coalesce(F.col("value") - F.col("level") - F.col("slope") * x, F.lit(0.0)).alias("v"))
    if season:
        phase = F.col("idx") % season
        means = p.groupBy("series_id", phase.alias("phase")).agg(F.avg("v").alias("m"))
        centre = means.groupBy("series_id").agg(F.avg("m").alias("c"))
        p = p.withColumn("phase", phase).join(means, ["series_id", "phase"]).join(centre, "series_id").select("series_id", "idx", (F.col("v") - F.col("m") + F.col("c")).alias("v"))
    return p, n


def lagged_sums(rows: DataFrame, n: int, most: int) -> DataFrame:
    """(a, b, c, ab, ba, s, q) of all pairs a <= b of ``rows`` (series_id, idx, v), over t from ``most`` to n.

    c: sums of a[t-i]·b[t-j] for i, j up to ``most``, row by row. ab: by quarter and lag l, of a[t-l]·b[t]; ba of b[t-l]·a[t]. Where a is b also
    s and q, by quarter (and at last over all) and lag: sums of a[t-l] and of its square."""
    lags, quarter = most + 1, (n - most) // QUARTERS
    tiles = max(1, -(-rows.select("series_id").distinct().count() // TILE))
    v = rows.withColumn("tile", F.pmod(F.xxhash64("series_id"), F.lit(tiles)).cast("int")).withColumn("block", F.explode(F.sequence(F.floor(F.col("idx") / STEPS), F.floor((F.col("idx") + most) / STEPS))))
    left = v.select("block", F.col("tile").alias("i"), F.explode(F.sequence("tile", F.lit(tiles - 1))).alias("j"), F.lit(0).alias("side"), "series_id", "idx", "v")
    right = v.filter("tile > 0").select("block", F.explode(F.sequence(F.lit(0), F.col("tile") - 1)).alias("i"), F.col("tile").alias("j"), F.lit(1).alias("side"), "series_id", "idx", "v")
    fields = "a string, b string, " + ", ".join(f"{c} array<double>" for c in ("c", "ab", "ba", "s", "q"))

    def products(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        block, i, j = key
        begin = block * STEPS

        def matrix(side: int) -> tuple[np.ndarray, np.ndarray]:
            of = part[part["side"] == side]
            codes, names = pd.factorize(of["series_id"], sort=True)
            m = np.zeros((len(names), STEPS + most))
            m[codes, of["idx"].to_numpy() - begin + most] = of["v"].to_numpy()
            return m, names.to_numpy(dtype=object)

        p, first = matrix(0)
        q, second = (p, first) if i == j else matrix(1)
        # columns of time t and, among them, those of each quarter
        span = lambda low, high: slice(max(low - begin, 0), max(min(high - begin, STEPS), 0))
        all_t = span(most, n)
        parts = [span(most + w * quarter, most + (w + 1) * quarter) for w in range(QUARTERS)]
        back = lambda m, lag, t: m[:, most - lag + t.start : most - lag + t.stop]
        low = first[:, None] <= second[None, :]
        r, k = np.nonzero(low if i == j else np.ones_like(low))
        if not len(r):
            return pd.DataFrame({x: pd.Series(dtype=object) for x in ("a", "b", "c", "ab", "ba", "s", "q")})
        turned = ~low[r, k]
        of = lambda x, lx, y, ly, t: (back(x, lx, t) @ back(y, ly, t).T)[r, k]
        c = np.array([[of(p, x, q, y, all_t) for y in range(lags)] for x in range(lags)])
        ab = np.array([[of(p, x, q, 0, t) for x in range(lags)] for t in parts])
        ba = np.array([[of(p, 0, q, x, t) for x in range(lags)] for t in parts])
        c, ab, ba = np.where(turned, c.transpose(1, 0, 2), c), np.where(turned, ba, ab), np.where(turned, ab, ba)
        own = first[r] == second[k] if i == j else np.zeros(len(r), bool)
        s = np.array([[back(p, x, t).sum(1) for x in range(lags)] for t in [*parts, all_t]])
        squares = np.array([[(back(p, x, t) ** 2).sum(1) for x in range(lags)] for t in [*parts, all_t]])
        flat = lambda m: list(m.reshape(m.shape[0] * m.shape[1], len(r)).T)
        some = lambda m: [m[..., x].ravel() if o else np.zeros(m.shape[0] * m.shape[1]) for x, o in zip(r, own, strict=True)]
        return pd.DataFrame({"a": np.where(turned, second[k], first[r]), "b": np.where(turned, first[r], second[k]), "c": flat(c), "ab": flat(ab), "ba": flat(ba), "s": some(s), "q": some(squares)})

    sums = left.unionByName(right).groupBy("block", "i", "j").applyInPandas(products, fields)
    if n + most <= STEPS:  # one block: its sums are whole
        return sums
    length = {"c": lags * lags, "ab": QUARTERS * lags, "ba": QUARTERS * lags, "s": (QUARTERS + 1) * lags, "q": (QUARTERS + 1) * lags}
    return sums.groupBy("a", "b").agg(*(F.array(*(F.sum(F.get(c, F.lit(k))) for k in range(m))).alias(c) for c, m in length.items()))


_EDGE = "a string, b string, lag int, r double, effect double, f double, df1 int, df2 int, stability double, confidence double, profile array<double>"


def _correlation(n: float, sx, sy, sxx, syy, sxy):
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy = n * sxx - sx * sx, n * syy - sy * sy
        return np.where((vx > 1e-12 * n * sxx) & (vy > 1e-12 * n * syy), (n * sxy - sx * sy) / np.sqrt(vx * vy), np.nan)


def _tests(batch: pd.DataFrame, n: int, max_lag: int, ar_lag: int) -> pd.DataFrame:
    """Edges a -> b of a batch of pairs with the sums of both series."""
    most = max(max_lag, ar_lag)
    lags, used, quarter, size = most + 1, n - most, (n - most) // QUARTERS, len(batch)
    get = lambda c, *shape: np.stack(batch[c].to_numpy()).reshape(size, *shape)
    xy, xx, yy = get("xy", lags, lags), get("xx", lags, lags), get("yy", lags, lags)
    wxy, sx, qx, sy, qy = get("wxy", QUARTERS, lags), *(get(c, QUARTERS + 1, lags) for c in ("sx", "qx", "sy", "qy"))
    at = np.arange(max_lag + 1)
    r = _correlation(used, sx[:, -1, at], sy[:, -1, :1], qx[:, -1, at], qy[:, -1, :1], xy[:, at, 0])
    best = np.argmax(np.where(np.isnan(r), -1.0, np.abs(r)), axis=1)
    rows = np.arange(size)
    top = r[rows, best]
    # columns of the regression: constant, own past, the other's lags, target
    own = np.arange(1, ar_lag + 1)
    m = 1 + ar_lag + max_lag + 1
    g = np.empty((size, m + 1, m + 1))
    places = [("1", 0), *(("y", k) for k in own), *(("x", k) for k in at), ("y", 0)]
    total = {"x": sx[:, -1], "y": sy[:, -1]}
    for u, (su, ku) in enumerate(places):
        for w, (sw, kw) in enumerate(places):
            if su == sw == "1":
                g[:, u, w] = used
            elif "1" in (su, sw):
                g[:, u, w] = total[sw if su == "1" else su][:, kw if su == "1" else ku]
            else:
                g[:, u, w] = xx[:, ku, kw] if su == sw == "x" else yy[:, ku, kw] if su == sw == "y" else xy[:, ku, kw] if su == "x" else xy[:, kw, ku]
    scale = np.sqrt(np.maximum(np.einsum("kii->ki", g), 1e-300))
    unit = g / scale[:, :, None] / scale[:, None, :]

    def rss(k: int) -> np.ndarray:
        """Of the target on the first k columns, as a share of its sum of squares."""
        beta = np.linalg.pinv(unit[:, :k, :k], rcond=1e-11, hermitian=True) @ unit[:, :k, m, None]
        return np.maximum(1 - np.einsum("ki,ki->k", unit[:, :k, m], beta[:, :, 0]), 0)

    small, full = rss(1 + ar_lag), rss(m)
    df1, df2 = max_lag + 1, used - m
    with np.errstate(divide="ignore", invalid="ignore"):
        f = np.where(full > 1e-12, (small - full) / df1 / (full / df2), np.nan)
        effect = top * batch["sd_y"].to_numpy() / batch["sd_x"].to_numpy()
    stability = np.zeros(size)
    if quarter >= LEAST_QUARTER:
        w = np.arange(QUARTERS)
        part = _correlation(quarter, sx[rows[:, None], w, best[:, None]], sy[:, :QUARTERS, 0], qx[rows[:, None], w, best[:, None]], qy[:, :QUARTERS, 0], wxy[rows[:, None], w, best[:, None]])
        known = ~np.isnan(part) & ~np.isnan(top)[:, None]
        stability = ((np.sign(part) == np.sign(top)[:, None]) & known).sum(1) / np.maximum(known.sum(1), 1)
    confidence = np.where(np.isnan(top), 0.0, np.minimum(1, 0.6 * np.abs(top) + 0.4 * stability))
    return pd.DataFrame({"a": batch["x"], "b": batch["y"], "lag": best, "r": top, "effect": effect, "f": f, "df1": df1, "df2": df2, "stability": stability, "confidence": confidence, "profile": list(r)})


def edges(points: DataFrame, max_lag: int = 12, ar_lag: int = 4, season: int | None = None) -> DataFrame:
    """(a, b, lag, r, effect, f, df1, df2, p, stability, confidence, profile) of every ordered pair: do a's lags 0 to ``max_lag`` tell of b beyond b's own past?

    ``lag`` has the largest |r| (first of equals), ``profile`` r by lag, ``effect`` is r in units of b per unit of a, ``stability`` the share of quarters whose r has its
    sign, ``confidence`` 0.6·|r| + 0.4·stability. No rows if the shortest series has under 30 steps, or too few for the lags."""
    rows, n = aligned(points, season)
    max_lag = max(1, min(max_lag, n // 5))
    ar_lag = max(1, min(ar_lag, (n - max_lag - 4) // 2))
    most = max(max_lag, ar_lag)
    if n < 30 or n - most < LEAST_USED or n - most - ar_lag - (max_lag + 1) - 1 < LEAST_FREE:
        return points.sparkSession.createDataFrame([], _EDGE).withColumn("p", F.lit(None).cast("double"))
    # read three times: pairs, and the sums of either series
    sums = _stored(lagged_sums(rows, n, most), "lagged-sums")
    spread = rows.groupBy("series_id").agg(F.stddev_samp("v").alias("sd"))
    own = sums.filter("a = b").join(spread, F.col("a") == F.col("series_id")).select("a", "c", "s", "q", "sd")
    x, y = (own.select(F.col("a").alias(k), F.col("c").alias(k + k), F.col("s").alias(f"s{k}"), F.col("q").alias(f"q{k}"), F.col("sd").alias(f"sd_{k}")) for k in "xy")
    lags = most + 1
    turned = F.transform(F.sequence(F.lit(0), F.lit(lags * lags - 1)), lambda k: F.get("c", (k % lags) * lags + F.floor(k / lags).cast("int")))
    pairs = sums.filter("a <> b")
    both = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y"), F.col("c").alias("xy"), F.col("ab").alias("wxy")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"), turned.alias("xy"), F.col("ba").alias("wxy"))))
    full = pairs.select(both.alias("e")).select("e.*").join(x, "x").join(y, "y")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 4096):
                yield _tests(batch.iloc[low : low + 4096].reset_index(drop=True), n, max_lag, ar_lag)

    out = full.mapInPandas(solve, _EDGE)
    out = out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("r", "effect", "f")})
    return out.withColumn("p", f_p_value(F.col("f"), F.col("df1"), F.col("df2")))


def discoveries(found: DataFrame, alpha: float = 0.05, control: bool = False, include_all: bool = False) -> DataFrame:
    """``found`` edges with ``significant``, direction (forward, reverse) and feedback; only significant ones unless ``include_all``.

    Of two edges between the same series the more confident one is forward. With ``control`` the share of false ones among the discoveries
    is held at ``alpha`` (Benjamini-Hochberg): ranks come from counts of bins of p and ranks within a bin, so that nothing is sorted as a whole."""
    limit: Column = F.lit(alpha)
    if control:
        p = found.filter("p is not null").select("p").withColumn("bin", F.floor(F.least(-F.log10(F.greatest("p", F.lit(1e-300))), F.lit(300.0)) * 20))
        bins = p.groupBy("bin").agg(F.count("*").alias("n"))
        # at most 6,001 bins
        before = bins.select("bin", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("m"))
        ranked = p.join(F.broadcast(before), "bin").withColumn("rank", F.col("before") + F.rank().over(Window.partitionBy("bin").orderBy("p")))
        held = ranked.filter(F.col("p") * F.col("m") <= alpha * F.col("rank")).agg(F.max("p")).head()[0]
        limit = F.lit(held if held is not None else -1.0)
    told = F.coalesce((F.col("p") <= limit) if control else (F.col("p") < limit), F.lit(False))
    out = found.withColumn("significant", told)
    out = out if include_all else out.filter("significant")
    pair = Window.partitionBy(F.least("a", "b"), F.greatest("a", "b"))
    place = F.row_number().over(pair.orderBy(F.desc(F.round("confidence", 12)), "a"))
    return out.withColumn("direction", F.when(place == 1, "forward").otherwise("reverse")).withColumn("feedback", F.count("*").over(pair) > 1)
