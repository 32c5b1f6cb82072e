"""External factors of series by regression on sums, and common factors of many series by a randomised range finder.

Both move sums only: of external factors a Gram matrix for each series, of common factors a vector of ``k + extra`` numbers for each series and step.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.significance import t_p_value
from tidemark.functions.stats import decay_kernel
from tidemark.sources.tables import shared_dir

#: Most columns of a regression: its sums are as many as their pairs.
MOST_COLUMNS = 40
KERNELS = ("box", "exponential", "triangular", "gaussian", "step")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# external factors


def event_places(points: DataFrame, events: DataFrame) -> DataFrame:
    """(series_id, name, start, duration, decay): ``events`` (name, start, duration, decay) placed at the first point at or after their start.

    start is null for an event before the first point or after the last; an unknown decay is a box, and a duration below 1 is 1."""
    spans = points.groupBy("series_id").agg(F.min(F.col("t").cast("timestamp")).alias("low"), F.max(F.col("t").cast("timestamp")).alias("high"))
    asked = events.select("name", F.col("start").cast("timestamp").alias("at"), F.greatest(F.coalesce("duration", F.lit(1)), F.lit(1)).alias("duration"), F.when(F.col("decay").isin(*KERNELS), F.col("decay")).otherwise("box").alias("decay"))
    listed = asked.agg(F.collect_list(F.struct("name", "at", "duration", "decay")).alias("asked"))
    inside = spans.crossJoin(F.broadcast(listed)).select("series_id", "low", "high", F.explode("asked").alias("e")).select("series_id", "low", "high", "e.*")
    # the next point of each day is found by day, over as many days as lie between two points
    known = points.select("series_id", F.col("t").cast("timestamp").alias("t"), "idx")
    before = known.select("series_id", "t", "idx", F.lag("t").over(Window.partitionBy("series_id").orderBy("t")).alias("previous"))
    days = before.select("series_id", "t", "idx", "previous", F.explode(F.sequence(F.to_date(F.coalesce("previous", "t")), F.to_date("t"))).alias("day"))
    placed = inside.withColumn("day", F.to_date("at")).join(days, ["series_id", "day"], "left").filter(F.col("t").isNull() | (F.col("t") >= F.col("at")) & (F.col("previous").isNull() | (F.col("previous") < F.col("at"))))
    start = F.when(F.col("at").between(F.col("low"), F.col("high")), F.col("idx"))
    found = placed.groupBy("series_id", "name", "at", "duration", "decay").agg(F.min(start).alias("start"))
    return inside.join(found, ["series_id", "name", "at", "duration", "decay"], "left").select("series_id", "name", "start", "duration", "decay")


class Design:
    """The columns of a regression of every series of ``points`` (series_id, idx, t, value) on a constant, a line, harmonics of ``season``, ``covariates`` (columns of ``points``) and
    ``events`` (name, start, duration, decay; events of one name are one factor)."""

    def __init__(self, points: DataFrame, events: DataFrame | None = None, season: float | None = None, harmonics: int = 3, trend: bool = True, covariates: tuple[str, ...] = ()):
        self.points, self.covariates = points, covariates
        self.controls = ["(intercept)", *(["(trend)"] if trend else [])]
        i = F.col("idx").cast("double")
        self.columns: list[Column] = [F.lit(1.0), *([i] if trend else [])]
        for k in range(1, max(1, min(harmonics, 6)) + 1) if season and season >= 2 else ():
            self.controls += [f"(sin {k})", f"(cos {k})"]
            self.columns += [F.sin(2 * math.pi * k / season * i), F.cos(2 * math.pi * k / season * i)]
        self.events = sorted(r["name"] for r in events.select("name").distinct().limit(MOST_COLUMNS + 1).collect()) if events is not None else []
        self.names = [*self.controls, *covariates, *self.events]
        if len(self.names) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} columns")
        self.kinds = ["control"] * len(self.controls) + ["series"] * len(covariates) + ["event"] * len(self.events)
        self.places = event_places(points, events) if events is not None else None

    def weights(self, steps: int = 0) -> DataFrame:
        """(series_id, idx, name, w): the events' weights at the steps they touch, ``steps`` beyond the last point as well."""
        last = self.points.groupBy("series_id").agg((F.max("idx") + steps).alias("last"))
        rows = self.places.filter("start is not null").join(last, "series_id")
        low = F.when(F.col("decay") == "gaussian", 0).otherwise(F.col("start"))
        high = F.when(F.col("decay").isin("box", "triangular"), F.least(F.col("start") + F.col("duration") - 1, F.col("last"))).otherwise(F.col("last"))
        rows = rows.withColumn("idx", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
        weight = F.lit(None).cast("double")
        for kind in KERNELS:
            weight = F.when(F.col("decay") == kind, decay_kernel(kind, F.col("idx") - F.col("start"), F.col("duration"))).otherwise(weight)
        return rows.withColumn("w", weight).filter("w <> 0").groupBy("series_id", "idx", "name").agg(F.sum("w").alias("w"))

    def rows(self, steps: int = 0) -> DataFrame:
        """(series_id, idx, value, x): the design; with ``steps`` also that many beyond the last point, whose value is null. Null covariates become their series' mean."""
        rows = self.points.select("series_id", F.col("idx").cast("int").alias("idx"), F.col("value").cast("double").alias("value"), *self.covariates)
        if steps:
            beyond = rows.groupBy("series_id").agg(F.max("idx").alias("last")).select("series_id", F.explode(F.sequence(F.col("last") + 1, F.col("last") + steps)).alias("idx"))
            rows = rows.unionByName(beyond, allowMissingColumns=True)
        if self.covariates:
            means = rows.groupBy("series_id").agg(*(F.avg(c).alias(f"_{c}") for c in self.covariates))
            rows = rows.join(means, "series_id").withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.col(f"_{c}"), F.lit(0.0)) for c in self.covariates})
        x = [*self.columns, *(F.col(c).cast("double") for c in self.covariates)]
        if self.events:
            each = [F.sum(F.when(F.col("name") == n, F.col("w")).otherwise(0.0)).alias(f"_e{k}") for k, n in enumerate(self.events)]
            rows = rows.join(self.weights(steps).groupBy("series_id", "idx").agg(*each), ["series_id", "idx"], "left")
            x += [F.coalesce(f"_e{k}", F.lit(0.0)) for k in range(len(self.events))]
        return rows.select("series_id", "idx", "value", F.array(*x).alias("x"))


_FIT = "series_id string, factor string, kind string, status string, depends string, n bigint, df bigint, coefficient double, std_error double, t double, impact double, r2 double, sigma double"


def _solved(g: np.ndarray, n: int, names: list[str], kinds: list[str], tolerance: float = 1e-10) -> list[tuple]:
    """Coefficients from the Gram matrix of the columns and, last, the target. A column that those before it make (all but ``tolerance`` of its square) is swept out and told."""
    k = len(names)
    scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
    a = g / np.outer(scale, scale)
    kept: list[int] = []
    status, depends = ["kept"] * k, [""] * k
    variance = np.maximum(np.diag(g)[:k] - g[0, :k] ** 2 / n, 0) / max(n - 1, 1)
    for j in range(k):
        if j and variance[j] <= max(1e-24, 1e-13 * g[j, j] / n):
            status[j] = "constant"
            continue
        if kept:
            on = np.linalg.solve(a[np.ix_(kept, kept)], a[kept, j])
            if a[j, j] - a[kept, j] @ on < tolerance:
                status[j], depends[j] = "collinear", ",".join(names[i] for i, w in zip(kept, on, strict=True) if abs(w) > 1e-6)
                continue
        kept.append(j)
    inverse = np.linalg.inv(a[np.ix_(kept, kept)])
    unit = inverse @ a[kept, k]
    rest = max(1 - a[kept, k] @ unit, 0.0) * g[k, k]
    mean = g[0, k] / n
    total, df = g[k, k] - n * mean * mean, n - len(kept)
    sigma = math.sqrt(rest / df) if df > 0 else math.nan
    beta = dict(zip(kept, unit * scale[k] / scale[kept], strict=True))
    error = dict(zip(kept, sigma * np.sqrt(np.diag(inverse)) / scale[kept], strict=True))
    r2 = 1 - rest / total if total > 0 else math.nan
    exact = rest <= 1e-10 * total
    out = []
    for j in range(k):
        b, e = beta.get(j, math.nan), error.get(j, math.nan)
        out.append((names[j], kinds[j], status[j], depends[j], n, df, b, math.nan if exact else e, math.nan if exact or not e > 0 else b / e, abs(b) * math.sqrt(variance[j]) if j in beta else 0.0, r2, sigma))
    return out


def factor_fit(design: Design) -> DataFrame:
    """(series_id, factor, kind, status, depends, n, df, coefficient, std_error, t, p, impact, r2, sigma) of every column for each series.

    status: kept; constant (doesn't vary, as an event outside the series); collinear (made of the columns in ``depends``). ``impact`` is the coefficient's size times
    the column's deviation. Series with fewer than three rows more than columns are left out."""
    k = len(design.names) + 1
    z = [F.get("x", F.lit(i)) for i in range(k - 1)] + [F.col("value")]
    sums = design.rows().filter("value is not null and not isnan(value)").groupBy("series_id").agg(F.count("*").alias("n"), F.array(*(F.sum(z[i] * z[j]) for i in range(k) for j in range(i, k))).alias("g"))
    names, kinds = design.names, design.kinds
    at = np.triu_indices(k)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, n, flat in zip(batch["series_id"], batch["n"], batch["g"], strict=True):
                g = np.zeros((k, k))
                g[at] = flat
                g.T[at] = flat
                out += [(key, *row) for row in _solved(g, int(n), names, kinds)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _FIT.split(", ")])

    found = sums.filter(F.col("n") >= k + 2).mapInPandas(solve, _FIT)
    found = found.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("coefficient", "std_error", "t", "r2", "sigma")})
    return found.withColumn("p", t_p_value(F.col("t"), F.col("df")))


def ranked_factors(fit: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The factors that are no controls, by impact: adds rank and significant."""
    place = Window.partitionBy("series_id").orderBy(F.desc(F.round("impact", 9)), "factor")
    return fit.filter("kind <> 'control'").withColumn("rank", F.row_number().over(place)).withColumn("significant", F.coalesce(F.col("p") < alpha, F.lit(False)))


def factor_predict(design: Design, fit: DataFrame, steps: int = 0) -> DataFrame:
    """(series_id, idx, value, fitted) of every row of the design and ``steps`` beyond; columns that were not kept count nothing."""
    order = F.array(*(F.coalesce(F.first(F.when(F.col("factor") == n, F.col("coefficient")), ignorenulls=True), F.lit(0.0)) for n in design.names))
    beta = fit.groupBy("series_id").agg(order.alias("beta"))
    dot = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return design.rows(steps).join(beta, "series_id").select("series_id", "idx", "value", dot.alias("fitted"))


def apply_factor(baseline: DataFrame, fit: DataFrame, factor: str, start: int, duration: int = 1, decay: str = "box") -> DataFrame:
    """``baseline`` (series_id, h, point) with ``adjusted``: a factor's effect from step ``start`` on (h from 0), by its kernel; 0 where it wasn't kept."""
    effect = fit.filter((F.col("factor") == factor) & F.col("coefficient").isNotNull()).select("series_id", F.col("coefficient").alias("_c"))
    kernel = decay_kernel(decay if decay in KERNELS else "box", F.col("h") - start, F.lit(max(1, duration)))
    return baseline.join(effect, "series_id", "left").withColumn("adjusted", F.col("point") + F.coalesce("_c", F.lit(0.0)) * kernel).drop("_c")


# common factors


def _turned(column: str, matrix: np.ndarray) -> Column:
    """``column`` (a row vector) times ``matrix``."""
    return F.array(*(sum((F.get(column, F.lit(i)) * float(matrix[i, j]) for i in range(matrix.shape[0])), F.lit(0.0)) for j in range(matrix.shape[1])))


def _gram(df: DataFrame, column: str, width: int) -> np.ndarray:
    flat = df.agg(*(F.sum(F.get(column, F.lit(i)) * F.get(column, F.lit(j))) for i in range(width) for j in range(i, width))).head()
    g = np.zeros((width, width))
    g[np.triu_indices(width)] = [x or 0.0 for x in flat]
    return g + np.triu(g, 1).T


def common_factors(points: DataFrame, k: int, extra: int = 6, rounds: int = 6, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(loadings, scores): the first ``k`` principal components of the series' correlations. loadings: factor, series_id, loading, share (of all variance); scores: factor, idx, score.

    Series are standardised; steps that a series lacks count as its mean, and series that don't vary are left out. A random block of ``k + extra`` vectors, one number a series
    and vector, goes through the data and back ``rounds`` times and is made orthonormal in between; the components are found inside what is left. The driver sees
    matrices of ``k + extra`` rows. With up to that many series the result is exact. The largest loading of a factor is positive."""
    width = k + extra
    stats = points.groupBy("series_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).filter("sd > 0")
    z = _stored(points.filter("value is not null").join(stats, "series_id").select("series_id", "idx", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("z")), "factor-z")
    steps = z.agg(F.count_distinct("idx")).head()[0]
    many = z.select("series_id").distinct().count()
    if not many:
        empty = z.limit(0)
        return empty.selectExpr("1 AS factor", "series_id", "z AS loading", "z AS share"), empty.selectExpr("1 AS factor", "idx", "z AS score")
    uniform = lambda j, salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(j), F.lit(salt), "series_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    block = [F.sqrt(-2 * F.ln(uniform(j, 0))) * F.cos(2 * F.pi() * uniform(j, 1)) for j in range(width)]
    v = z.select("series_id").distinct().select("series_id", F.array(*block).alias("v"))

    def through(x: DataFrame, key: str, by: str, size: int) -> DataFrame:
        """Sums of z times x (``key``, v) for each ``by``."""
        return z.join(x, key).groupBy(by).agg(F.array(*(F.sum(F.col("z") * F.get("v", F.lit(j))) for j in range(size))).alias("v"))

    size = width
    for _ in range(rounds):
        w = _stored(through(through(v, "series_id", "idx", size), "idx", "series_id", size), "factor-block")
        values, vectors = np.linalg.eigh(_gram(w, "v", size))
        good = values > values[-1] * 1e-12
        v, size = _stored(w.select("series_id", _turned("v", vectors[:, good] / np.sqrt(values[good])).alias("v")), "factor-block"), int(good.sum())
    seen = _stored(through(v, "series_id", "idx", size), "factor-steps")
    values, vectors = np.linalg.eigh(_gram(seen, "v", size))
    order = np.argsort(-values)[: min(k, size)]
    turned = vectors[:, order]
    loadings = v.select("series_id", F.posexplode(_turned("v", turned)).alias("f", "loading"))
    signs = {r["f"]: 1.0 if r["x"] >= 0 else -1.0 for r in loadings.groupBy("f").agg(F.max_by("loading", F.struct(F.round(F.abs("loading"), 9), "series_id")).alias("x")).collect()}
    flipped = turned * np.array([signs[j] for j in range(len(order))])
    shares = F.array(*(F.lit(float(values[j] / (steps - 1) / many)) for j in order))
    loadings = v.select("series_id", F.posexplode(_turned("v", flipped)).alias("f", "loading")).select((F.col("f") + 1).alias("factor"), "series_id", "loading", F.get(shares, F.col("f")).alias("share"))
    scores = seen.select("idx", F.posexplode(_turned("v", flipped)).alias("f", "score")).select((F.col("f") + 1).alias("factor"), "idx", "score")
    return loadings, scores
