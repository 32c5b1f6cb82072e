"""Least squares with test statistics, analysis of variance, tests of pairs. All sums are partial aggregates; a row per group is left to solve."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.significance import f_p_value, t_p_value
from tidemark.functions.stats import norm_cdf


def ols(rows: DataFrame, y: str, xs: tuple[str, ...], by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(by…, term, n, beta, se, t, p, r2, regularised, degenerate) of y on a constant and ``xs`` for each group.

    Rows with a null in any variable are left out; groups of fewer than k + 3 rows give none. A singular system is solved
    again with a ridge of 1e-8 of its scale and flagged; without residuals (rss <= 1e-10 tss) errors are null and flagged."""
    names = ("intercept", *xs)
    full = rows.dropna(subset=[y, *xs]).select(*by, F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("_0"), *(F.col(x).cast("double").alias(f"_{k + 1}") for k, x in enumerate(xs)))
    k = len(names)
    gram = F.array(*(F.sum(F.col(f"_{i}") * F.col(f"_{j}")) for i in range(k) for j in range(k)))
    sums = full.groupBy(*by).agg(F.count("*").alias("n"), gram.alias("g"), F.array(*(F.sum(F.col(f"_{i}") * F.col("_y")) for i in range(k))).alias("b"), F.sum(F.col("_y") * F.col("_y")).alias("yy"), F.avg("_y").alias("mean"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                g, b = np.array(row.g).reshape(k, k), np.array(row.b)
                scale = np.abs(g).max()
                regular = np.linalg.matrix_rank(g, tol=1e-12 * scale * k) == k
                inverse = np.linalg.inv(g if regular else g + 1e-8 * scale * np.eye(k))
                beta = inverse @ b
                tss = row.yy - row.n * row.mean**2
                rss = max(0.0, row.yy - beta @ b)
                degenerate = rss <= 1e-10 * tss
                se = np.full(k, np.nan) if degenerate else np.sqrt(rss / (row.n - k) * np.diag(inverse))
                key = [getattr(row, c) for c in by]
                out += [(*key, term, row.n, beta[i], se[i], beta[i] / se[i], 1 - rss / tss if tss > 0 else np.nan, not regular, bool(degenerate)) for i, term in enumerate(names)]
            yield pd.DataFrame(out, columns=[*by, "term", "n", "beta", "se", "t", "r2", "regularised", "degenerate"])

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*by).schema)
    found = sums.filter(F.col("n") >= k + 3).mapInPandas(solve, f"{keys}, term string, n bigint, beta double, se double, t double, r2 double, regularised boolean, degenerate boolean")
    clean = found.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("se", "t", "r2")})
    return clean.select(*by, "term", "n", "beta", "se", "t", t_p_value(F.col("t"), F.col("n") - k).alias("p"), "r2", "regularised", "degenerate")


def anova(rows: DataFrame, value: str, group: str, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(by…, f, df1, df2, p): whether the means of ``group`` differ."""
    per = rows.groupBy(*by, group).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    out = per.groupBy(*by).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    f = F.try_divide((F.col("between") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1), (F.col("q") - F.col("between")) / (F.col("n") - F.col("k")))
    out = out.filter("k > 1 and n > k").select(*by, f.alias("f"), (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"))
    return out.withColumn("p", f_p_value(F.col("f"), F.col("df1"), F.col("df2")))


def correlated_pairs(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b, n, r, p, relation, cluster) of pairs (a, b, n, r): p by a normal approximation of r's t; relations from ``threshold``, whose clusters are named by their kind.

    A cluster's number comes from a rank of first series, of which there is one row for each kind, not one for each pair."""
    t = F.abs("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r")))
    relation = F.when(F.col("r") >= threshold, "positive").when(F.col("r") <= -threshold, "negative").otherwise("weak")
    known = pairs.select("a", "b", "n", F.nullif(F.col("r"), F.lit(float("nan"))).alias("r"))
    out = known.select("a", "b", "n", "r", (2 * (1 - norm_cdf(t))).alias("p"), relation.alias("relation"))
    firsts = out.filter("relation <> 'weak'").select("relation", "a").distinct()
    ranks = firsts.withColumn("cluster", F.row_number().over(Window.partitionBy("relation").orderBy("a")))
    return out.join(ranks, ["relation", "a"], "left").select("a", "b", "n", "r", "p", "relation", "cluster")
