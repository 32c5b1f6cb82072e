"""Lagged responses and interventions with bands, further kinds of simulated paths, sums of paths, a light additive model, Markdown reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.inference import ols
from tidemark.operators.prepare import detrended
from tidemark.operators.report import naive_baseline


def lag_response(points: DataFrame, cause: str, target: str, lags: int = 12) -> DataFrame:
    """(lag, coefficient, n, r2, sigma): least squares of the detrended target on the detrended cause at lags 0 to ``lags``, a fifth of the shorter series at most.

    Rows of both series meet by their place; fewer than lags + 5 common rows give none."""
    both = points.filter(F.col("series_id").isin(cause, target))
    counts = {r["series_id"]: r["count"] for r in both.groupBy("series_id").count().collect()}  # two rows
    lags = max(1, min(lags, min(counts.get(cause, 0), counts.get(target, 0)) // 5))
    v = detrended(both).select("series_id", "idx", F.col("detrended").alias("v"))
    w = Window.partitionBy("series_id").orderBy("idx")
    names = [f"x{k}" for k in range(lags + 1)]
    x = v.filter(F.col("series_id") == cause).select("idx", *(F.lag("v", k).over(w).alias(c) for k, c in enumerate(names)))
    y = v.filter(F.col("series_id") == target).select("series_id", "idx", F.col("v").alias("y"))
    rows = y.join(x, "idx").dropna()
    spread = rows.groupBy("series_id").agg(F.var_pop("y").alias("variance"))
    fit = ols(rows, "y", tuple(names)).join(spread, "series_id").filter("term <> 'intercept'")
    left = F.greatest((1 - F.col("r2")) * F.col("variance"), F.lit(0.0)) * F.col("n") / (F.col("n") - (lags + 2))
    return fit.select(F.substring("term", 2, 9).cast("int").alias("lag"), F.col("beta").alias("coefficient"), "n", "r2", F.sqrt(left).alias("sigma"))


def intervention(points: DataFrame, response: DataFrame, target: str, change: float, start: int = 0, duration: int | None = None, horizon: int = 24, z: float = 1.28) -> DataFrame:
    """(h, baseline, counterfactual, delta, cumulative, lower, upper): ``change`` units from step ``start`` on for ``duration`` steps, through ``response``.

    The baseline is the last value with the drift of the last quarter; its band is z sample deviations of the history,
    moved by delta and widened by the response's sigma times the root of the number of terms that act (one at least)."""
    last = min(horizon, start + (duration or horizon))
    acts = response.select("lag", "coefficient", "sigma", F.explode(F.sequence(F.lit(start), F.lit(last - 1))).alias("at")) if last > start else response.limit(0).withColumn("at", F.lit(0))
    moved = acts.select((F.col("at") + F.col("lag")).alias("step"), (change * F.col("coefficient")).alias("part")).groupBy("step").agg(F.sum("part").alias("delta"), F.count("*").alias("active"))
    history = points.filter(F.col("series_id") == target)
    spread = history.groupBy("series_id").agg(F.stddev_samp("value").alias("sd"))
    noise = response.agg(F.max("sigma").alias("sigma")).withColumn("series_id", F.lit(target))
    base = naive_baseline(history, horizon).withColumnRenamed("point", "baseline").join(spread, "series_id").join(noise, "series_id")
    steps = base.withColumn("step", F.col("h") - 1).join(moved, "step", "left")
    delta = F.coalesce("delta", F.lit(0.0))
    half = z * F.coalesce("sd", "sigma") + F.col("sigma") * F.sqrt(F.greatest(F.coalesce("active", F.lit(1)), F.lit(1)))
    to_date = Window.partitionBy("series_id").orderBy("h")
    out = steps.select("series_id", "h", "baseline", (F.col("baseline") + delta).alias("counterfactual"), delta.alias("delta"), half.alias("half"))
    return out.select("h", "baseline", "counterfactual", "delta", F.sum("delta").over(to_date).alias("cumulative"), (F.col("counterfactual") - F.col("half")).alias("lower"), (F.col("counterfactual") + F.col("half")).alias("upper"))


def cumulative_intervals(paths: DataFrame, length: int, confidence: float = 0.95, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """(by…, paths, estimate, lower, upper) of the sums of the first ``length`` steps (from 1) of each path (by…, path, step, value).

    Limits are the sums at the places floor(n(1 - c)/2) and ceil(n(1 + c)/2), from 0, the largest at most."""
    sums = paths.filter(F.col("step") <= length).groupBy(*by, "path").agg(F.sum("value").alias("s"))
    ranked = sums.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("s")) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    low, high = F.floor(F.col("n") * (1 - confidence) / 2), F.least(F.ceil(F.col("n") * (1 + confidence) / 2), F.col("n") - 1)
    return ranked.groupBy(*by).agg(F.count("*").alias("paths"), F.avg("s").alias("estimate"), F.min(F.when(F.col("k") == low, F.col("s"))).alias("lower"), F.min(F.when(F.col("k") == high, F.col("s"))).alias("upper"))


def random_paths(spark: SparkSession, kind: str, last: float, volatility: float, horizon: int, drift: float = 0.0, sims: int = 10_000, seed: int = 1, phi: float = 0.95, dt: float = 1 / 252) -> DataFrame:
    """(path, step, value), steps from 1. ``kind``: autoregressive (phi · value + noise), geometric (log steps of (drift - volatility²/2)·dt and
    volatility·sqrt(dt)), multiplicative (log steps of volatility). Draws depend on (seed, path, step) alone.

    Each is a prefix sum; the autoregressive one is of noise by powers of 1/phi, so that ``horizon`` times ln(1/phi) must stay below 600."""
    uniform = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "path", "step"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = F.sqrt(-2 * F.ln(uniform(0))) * F.cos(2 * F.pi() * uniform(1))
    grid = spark.range(sims).select(F.col("id").alias("path"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")).withColumn("noise", normal)
    so_far = lambda c: F.sum(c).over(Window.partitionBy("path").orderBy("step"))
    if kind == "autoregressive":
        value = F.pow(F.lit(phi), F.col("step")) * (last + so_far(volatility * F.col("noise") * F.pow(F.lit(phi), -F.col("step"))))
    elif kind == "geometric":
        value = last * F.exp(so_far((drift - volatility**2 / 2) * dt + volatility * dt**0.5 * F.col("noise")))
    elif kind == "multiplicative":
        value = last * F.exp(so_far(volatility * F.col("noise")))
    else:
        raise ValueError(f"no kind of path: {kind}")
    return grid.select("path", "step", value.alias("value"))


def path_percentiles(paths: DataFrame, shares: tuple[float, ...] = (0.025, 0.5, 0.975)) -> DataFrame:
    """(step, low, middle, high): of the values of each step, those at the places floor(n · share)."""
    ranked = paths.withColumn("k", F.row_number().over(Window.partitionBy("step").orderBy("value")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("step")))
    at = lambda share: F.min(F.when(F.col("k") == F.least(F.floor(F.col("n") * share), F.col("n") - 1), F.col("value")))
    return ranked.groupBy("step").agg(*(at(share).alias(c) for c, share in zip(("low", "middle", "high"), shares, strict=True)))


def light_additive(points: DataFrame, season: int, horizon: int) -> DataFrame:
    """(series_id, h, point, lower, upper): mean of the last w = min(7, n/10) values, a tenth of their slope times (season + h), and the mean of the
    phase over whole seasons (0 without one), all added up as the reference's numbers have it; the band is 1.96 · (h/2 + 1).

    Series of fewer than 10 points take all values as the last ones. Only sums leave the rows of a series."""
    n = points.groupBy("series_id").agg(F.count("*").alias("n"))
    rows = points.join(n, "series_id").withColumn("w", F.least(F.lit(7), F.floor(F.col("n") / 10)))
    recent = rows.filter((F.col("w") == 0) | (F.col("idx") >= F.col("n") - F.col("w")))
    fit = recent.groupBy("series_id").agg(F.avg("value").alias("base"), F.coalesce(F.regr_slope("value", F.col("idx").cast("double")), F.lit(0.0)).alias("slope"))
    whole = rows.filter(F.col("idx") < F.floor(F.col("n") / season) * season)
    phases = whole.groupBy("series_id", (F.col("idx") % season).alias("phase")).agg(F.avg("value").alias("seasonal"))
    steps = fit.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("phase", (F.col("h") - 1) % season)
    out = steps.join(phases, ["series_id", "phase"], "left")
    point = F.col("base") + 0.1 * F.col("slope") * (season + F.col("h")) + F.coalesce("seasonal", F.lit(0.0))
    half = 1.96 * (F.col("h") * 0.5 + 1)
    return out.select("series_id", "h", point.alias("point"), (point - half).alias("lower"), (point + half).alias("upper"))


def markdown_reports(forecasts: DataFrame, interval: int = 80, shown: int = 24) -> DataFrame:
    """(series_id, report): a title and a table of the first ``shown`` steps of (series_id, h, point, lower, upper), with a line on how many there are if more."""
    line = F.format_string("| %d | %.2f | %.2f | %.2f |", F.col("h").cast("int"), "point", "lower", "upper")
    per = forecasts.groupBy("series_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("h") <= shown, F.struct("h", line.alias("line"))))).alias("rows"))
    head = F.concat(F.lit("# "), F.col("series_id"), F.lit(f"\n\n| Step | Forecast | Lower {interval}% | Upper {interval}% |\n|---|---|---|---|\n"))
    more = F.when(F.col("n") > shown, F.concat(F.lit(f"\n\nShowing the first {shown} of "), F.col("n"), F.lit(" steps."))).otherwise("")
    return per.select("series_id", F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), more).alias("report"))
