"""All pairs of series at the same steps: correlations, and whether their sign holds over time.

Time is cut into blocks and series into tiles, as in ``multi.lagged_correlation``: a task multiplies two tiles of a block, so
that what is shuffled are sums of pairs, never their steps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.multi import STEPS, TILE

_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def _tiles(points: DataFrame) -> tuple[DataFrame, int]:
    """(rows (block, i, j, side, series_id, idx, v), number of tiles): each known value once for each pair of tiles it takes part in, counted from its series' mean."""
    mean = points.groupBy("series_id").agg(F.avg("value").alias("mean"))
    tiles = max(1, -(-mean.count() // TILE))
    v = points.join(mean, "series_id").filter("value is not null").select("series_id", "idx", (F.col("value") - F.col("mean")).cast("double").alias("v"), _tile(F.col("series_id"), tiles).alias("tile"), F.floor(F.col("idx") / STEPS).alias("block"))
    x = v.select("block", F.col("tile").alias("i"), F.explode(F.sequence("tile", F.lit(tiles - 1))).alias("j"), F.lit(0).alias("side"), "series_id", "idx", "v")
    y = v.filter("tile > 0").select("block", F.explode(F.sequence(F.lit(0), F.col("tile") - 1)).alias("i"), F.col("tile").alias("j"), F.lit(1).alias("side"), "series_id", "idx", "v")
    return x.unionByName(y), tiles


def _tile(series: Column, tiles: int) -> Column:
    return F.pmod(F.xxhash64(series), F.lit(tiles)).cast("int")


def _matrices(rows: pd.DataFrame, begin: int, same: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(names, known, values) of the two tiles of a task, which are one where ``same``."""
    out = []
    for side in (0,) if same else (0, 1):
        part = rows[rows["side"] == side]
        codes, names = pd.factorize(part["series_id"], sort=True)
        m = np.full((len(names), STEPS), np.nan)
        m[codes, part["idx"].to_numpy() - begin] = part["v"].to_numpy()
        out.append((names.to_numpy(dtype=object), (~np.isnan(m)).astype(float), np.nan_to_num(m)))
    return out * 2 if same else out


def _correlation() -> Column:
    spread = lambda s, ss: F.when(F.col("n") * F.col(ss) - F.col(s) * F.col(s) > 1e-12 * F.col("n") * F.col(ss), F.col("n") * F.col(ss) - F.col(s) * F.col(s))
    return (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(spread("x", "xx")) / F.sqrt(spread("y", "yy"))


def _whole(rows: DataFrame) -> DataFrame:
    """(a, b, n, low, r) of all pairs with a step in common; low is their first."""

    def sums(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        block, i, j = key
        (left, has, p), (right, has_q, q) = _matrices(part, block * STEPS, i == j)
        first = left[:, None] < right[None, :]
        n = has @ has_q.T
        r, c = np.nonzero((first if i == j else np.ones_like(first)) & (n > 0))
        # the first step in common: of a row with all others at once
        low = np.concatenate([np.argmax(has[k] * has_q[c[r == k]], axis=1) for k in np.unique(r)] or [np.zeros(0, int)])
        s = [m[r, c] for m in (n, p @ has_q.T, has @ q.T, (p * p) @ has_q.T, has @ (q * q).T, p @ q.T)]
        f = first[r, c]
        swap = lambda u, w: np.where(f, u, w)
        return pd.DataFrame({"a": swap(left[r], right[c]), "b": swap(right[c], left[r]), "low": block * STEPS + low, "n": s[0].astype("int64"), "x": swap(s[1], s[2]), "y": swap(s[2], s[1]), "xx": swap(s[3], s[4]), "yy": swap(s[4], s[3]), "xy": s[5]})

    parts = rows.groupBy("block", "i", "j").applyInPandas(sums, "a string, b string, low bigint, n bigint, x double, y double, xx double, yy double, xy double")
    whole = parts.groupBy("a", "b").agg(F.min("low").alias("low"), *(F.sum(c).alias(c) for c in _SUMS))
    return whole.select("a", "b", "n", "low", _correlation().alias("r"))


def pair_correlations(points: DataFrame) -> DataFrame:
    """(a, b, n, r) of all pairs a < b of ``points`` (series_id, idx, value) with n steps in common; r is null where a series is constant. Null values are left out."""
    return _whole(_tiles(points)[0]).drop("low")


def stable_signs(points: DataFrame, windows: int = 4, least: int = 8) -> DataFrame:
    """(a, b, r, stability): share of ``windows`` spans of the steps in common whose correlation has the sign of the whole; 0 if spans are shorter than ``least``.

    A span has floor(n / windows) steps and the first begins at the first step in common. The bounds of a pair go back to the
    tasks of its tiles, which take sums between them from running sums; constant spans don't count."""
    rows, tiles = _tiles(points)
    whole = _whole(rows)
    size = F.floor(F.col("n") / windows)
    i, j = _tile(F.col("a"), tiles), _tile(F.col("b"), tiles)
    bounds = whole.filter(size >= least).select("a", "b", "low", size.alias("size"), F.least(i, j).alias("i"), F.greatest(i, j).alias("j"))
    bounds = bounds.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / STEPS), F.floor((F.col("low") + windows * F.col("size") - 1) / STEPS))))

    def sums(key: tuple, part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        block, i, j = key
        if part.empty or asked.empty:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("a", "b", "span", *_SUMS)})
        (left, has, p), (right, has_q, q) = _matrices(part, block * STEPS, i == j)
        place, other = {s: k for k, s in enumerate(left)}, {s: k for k, s in enumerate(right)}
        # a pair's first series may be in either tile
        turned = np.array([a not in place or b not in other for a, b in zip(asked["a"], asked["b"], strict=True)])
        u, w = np.where(turned, asked["b"], asked["a"]), np.where(turned, asked["a"], asked["b"])
        known = np.array([s in place and t in other for s, t in zip(u, w, strict=True)])
        asked, u, w = asked[known], u[known], w[known]
        r, c = np.array([place[s] for s in u], int), np.array([other[s] for s in w], int)
        low, size = asked["low"].to_numpy() - block * STEPS, asked["size"].to_numpy()
        edges = np.clip(low[:, None] + size[:, None] * np.arange(windows + 1), 0, STEPS)
        out = []
        for k in np.unique(r):
            at = np.flatnonzero(r == k)
            of = c[at]
            here = [has[k] * has_q[of], p[k] * has_q[of], has[k] * q[of], p[k] ** 2 * has_q[of], has[k] * q[of] ** 2, p[k] * q[of]]
            running = [np.concatenate([np.zeros((len(of), 1)), np.cumsum(m, axis=1)], axis=1) for m in here]
            held = [np.diff(np.take_along_axis(m, edges[at], axis=1), axis=1).ravel() for m in running]
            frame = pd.DataFrame(dict(zip(_SUMS, held, strict=True)))
            frame["n"] = frame["n"].round().astype("int64")
            names = asked.iloc[np.repeat(at, windows)]
            frame.insert(0, "a", names["a"].to_numpy())
            frame.insert(1, "b", names["b"].to_numpy())
            frame.insert(2, "span", np.tile(np.arange(windows), len(at)))
            out.append(frame[frame["n"] > 0])
        return pd.concat(out) if out else pd.DataFrame({x: pd.Series(dtype=object) for x in ("a", "b", "span", *_SUMS)})

    spans = rows.groupBy("block", "i", "j").cogroup(bounds.groupBy("block", "i", "j")).applyInPandas(sums, "a string, b string, span int, n bigint, x double, y double, xx double, yy double, xy double")
    spans = spans.groupBy("a", "b", "span").agg(*(F.sum(c).alias(c) for c in _SUMS)).select("a", "b", _correlation().alias("part")).filter("part is not null")
    agree = spans.join(whole.select("a", "b", "r"), ["a", "b"]).groupBy("a", "b").agg(F.avg((F.signum("part") == F.signum("r")).cast("double")).alias("stability"))
    return whole.select("a", "b", "r").join(agree, ["a", "b"], "left").select("a", "b", "r", F.coalesce("stability", F.lit(0.0)).alias("stability"))
