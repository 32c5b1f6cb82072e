"""Data quality: missing runs, outliers, shifts, imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def _series() -> WindowSpec:
    return Window.partitionBy("series_id")


def _by_idx() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("idx")


def missing_runs(points: DataFrame) -> DataFrame:
    """(series_id, first, last, duration, kind): runs of null values; up to two are a scattered_hole, more a complete_time_gap."""
    null = points.filter("value is null").withColumn("run", F.col("idx") - F.row_number().over(_by_idx()))
    runs = null.groupBy("series_id", "run").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("duration")).drop("run")
    return runs.withColumn("kind", F.when(F.col("duration") <= 2, "scattered_hole").otherwise("complete_time_gap"))


def coverage(points: DataFrame) -> DataFrame:
    return points.groupBy("series_id").agg(F.count_if(F.col("value").isNull()).alias("missing"), F.round(100 * F.count("value") / F.count("*"), 2).alias("coverage"))


def zscore_outliers(points: DataFrame, threshold: float = 2.5) -> DataFrame:
    """(series_id, idx, value, score, confidence): |z| above the threshold, by population deviation."""
    v = points.filter("value is not null")
    z = F.abs(F.col("value") - F.avg("value").over(_series())) / F.when(F.stddev_pop("value").over(_series()) > 0, F.stddev_pop("value").over(_series())).otherwise(1.0)
    out = v.withColumn("score", z).filter(F.col("score") > threshold)
    return out.withColumn("confidence", F.least(F.lit(0.95), F.exp(-2 / F.col("score")))).select("series_id", "idx", "value", "score", "confidence")


def iqr_outliers(points: DataFrame, k: float = 1.5) -> DataFrame:
    """(series_id, idx, value, low, high) outside the quartiles by k times their distance; quartiles are sorted[floor(n·p)]."""
    from tidemark.operators.prepare import floor_quantile

    q = floor_quantile(points.filter("value is not null"), 0.25, 0.75)
    q = q.select("series_id", (F.col("q25") - k * (F.col("q75") - F.col("q25"))).alias("low"), (F.col("q75") + k * (F.col("q75") - F.col("q25"))).alias("high"))
    return points.join(q, "series_id").filter("value < low or value > high").select("series_id", "idx", "value", "low", "high")


def mad_outliers(points: DataFrame, threshold: float = 3.5) -> DataFrame:
    """(series_id, idx, value, score): modified z-score by the median absolute deviation."""
    med = points.groupBy("series_id").agg(F.percentile("value", F.lit(0.5)).alias("med"))
    d = points.join(med, "series_id").withColumn("d", F.abs(F.col("value") - F.col("med")))
    mad = d.groupBy("series_id").agg(F.percentile("d", F.lit(0.5)).alias("mad"))
    out = d.join(mad, "series_id").withColumn("score", F.try_divide(0.6745 * F.col("d"), F.col("mad")))
    return out.filter(F.col("score") > threshold).select("series_id", "idx", "value", "score")


def trend_shifts(points: DataFrame) -> DataFrame:
    """(series_id, idx, before, after, magnitude): means of neighbouring blocks that differ by over half a deviation."""
    n = F.count("*").over(_series())
    # frames can't depend on a row, so block means come from running sums
    p = points.withColumn("n", n).withColumn("w", F.greatest(F.lit(5), F.floor(F.col("n") / 10)).cast("int"))
    p = p.withColumn("sd", F.stddev_pop("value").over(_series())).withColumn("run", F.sum("value").over(_by_idx().rowsBetween(Window.unboundedPreceding, 0)))
    edge = p.select("series_id", F.col("idx").alias("at"), F.col("run").alias("upto"))
    at = p.filter((F.col("idx") >= F.col("w")) & (F.col("idx") < F.col("n") - F.col("w")) & (F.col("n") >= 3 * F.col("w")))
    hops = at.select("series_id", "idx", "w", "sd", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.col("idx") - 1 + F.col("w") * d).alias("at")) for k, d in (("a", -1), ("b", 0), ("c", 1))))).alias("e"))
    hops = hops.select("series_id", "idx", "w", "sd", "e.k", "e.at").join(edge, ["series_id", "at"], "left")
    wide = hops.groupBy("series_id", "idx", "w", "sd").agg(*(F.coalesce(F.max(F.when(F.col("k") == k, F.col("upto"))), F.lit(0.0)).alias(k) for k in "abc"))
    out = wide.select("series_id", "idx", "sd", ((F.col("b") - F.col("a")) / F.col("w")).alias("before"), ((F.col("c") - F.col("b")) / F.col("w")).alias("after"))
    out = out.withColumn("magnitude", F.col("after") - F.col("before"))
    return out.filter(F.abs("magnitude") > 0.5 * F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).drop("sd")


def outlier_clusters(points: DataFrame, sds: float = 2.0) -> DataFrame:
    """(series_id, first, last, size): runs of at least two values beyond ``sds`` population deviations."""
    far = points.withColumn("far", F.abs(F.col("value") - F.avg("value").over(_series())) > sds * F.stddev_pop("value").over(_series())).filter("far")
    runs = far.withColumn("run", F.col("idx") - F.row_number().over(_by_idx()))
    return runs.groupBy("series_id", "run").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("size")).filter("size >= 2").drop("run")


def hampel_outliers(points: DataFrame, k: int = 5, times: float = 5.0) -> DataFrame:
    """(series_id, idx, value, median, mad): values far from the median of their k neighbours on either side."""
    sides = [F.collect_list("value").over(_by_idx().rowsBetween(-k, -1)), F.collect_list("value").over(_by_idx().rowsBetween(1, k))]
    med = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    p = points.withColumn("near", F.array_sort(F.concat(*sides))).withColumn("median", med(F.col("near")))
    p = p.withColumn("off", F.array_sort(F.transform("near", lambda x: F.abs(x - F.col("median"))))).withColumn("mad", med(F.col("off")))
    limit = times * F.greatest(1.4826 * F.col("mad"), F.lit(1e-9) * F.greatest(F.abs("median"), F.lit(1.0)))
    return p.filter(F.abs(F.col("value") - F.col("median")) > limit).select("series_id", "idx", "value", "median", "mad")


def impute(points: DataFrame, method: str = "linear", season: int = 7, window: int = 3) -> DataFrame:
    """``points`` with null values filled: linear (mean of the nearest known neighbours), seasonal (mean of the phase),
    neighbor_avg (mean of ``window`` on either side) or last (mean of the ten known values before)."""
    before, after = _by_idx().rowsBetween(Window.unboundedPreceding, -1), _by_idx().rowsBetween(1, Window.unboundedFollowing)
    left, right = F.last("value", True).over(before), F.first("value", True).over(after)
    fill = {
        "linear": F.when(left.isNull(), right).when(right.isNull(), left).otherwise((left + right) / 2),
        "seasonal": F.avg("value").over(Window.partitionBy("series_id", F.col("idx") % season)),
        "neighbor_avg": F.avg("value").over(_by_idx().rowsBetween(-window, window)),
        "last": F.avg("value").over(_by_idx().rowsBetween(-10, -1)),
    }[method]
    return points.withColumn("filled", fill).withColumn("value", F.coalesce("value", "filled")).drop("filled")


def season_breaks(points: DataFrame, season: int = 7, least: float = 0.7) -> DataFrame:
    """(series_id, block, r): correlation of neighbouring blocks of ``season`` values below ``least``; a constant block has none."""
    p = points.select("series_id", F.floor(F.col("idx") / season).alias("block"), (F.col("idx") % season).alias("phase"), "value")
    after = p.select("series_id", (F.col("block") - 1).alias("block"), "phase", F.col("value").alias("after"))
    r = p.join(after, ["series_id", "block", "phase"]).groupBy("series_id", "block").agg(F.try_divide(F.covar_pop("value", "after"), F.stddev_pop("value") * F.stddev_pop("after")).alias("r"), F.count("*").alias("n"))
    return r.filter((F.col("n") == season) & (F.col("r") < least)).select("series_id", "block", "r")


def human_errors(points: DataFrame) -> DataFrame:
    """(series_id, kind, severity, count): jumps of scale, many multiples of ten, and values with one decimal place at most."""
    text = F.regexp_replace(F.col("value").cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    decimals = F.when(F.instr(text, ".") > 0, F.length(text) - F.instr(text, "."))
    p = points.withColumn("ratio", F.when(F.lag("value").over(_by_idx()) > 0, F.col("value") / F.lag("value").over(_by_idx()))).withColumn("decimals", decimals)
    common = p.filter("decimals > 0").groupBy("series_id", "decimals").count().groupBy("series_id").agg(F.max_by("decimals", F.struct("count", "decimals")).alias("common"))
    per = p.groupBy("series_id").agg(F.count("*").alias("n"), F.count_if((F.col("ratio") > 10) | (F.col("ratio") < 0.1)).alias("jumps"), F.count_if(F.col("value") % 10 == 0).alias("tens")).join(common, "series_id", "left")
    kinds = F.array_compact(
        F.array(
            F.when(F.coalesce("common", F.lit(2)) <= 1, F.struct(F.lit("excessive_rounding").alias("kind"), F.lit("medium").alias("severity"), F.col("n").alias("count"))),
            F.when(F.col("jumps") > 0, F.struct(F.lit("potential_unit_mismatch").alias("kind"), F.lit("high").alias("severity"), F.col("jumps").alias("count"))),
            F.when(F.col("tens") > 0.3 * F.col("n"), F.struct(F.lit("human_adjustment_pattern").alias("kind"), F.lit("low").alias("severity"), F.col("tens").alias("count"))),
        )
    )
    return per.select("series_id", F.explode(kinds).alias("k")).select("series_id", "k.*")


def gates(points: DataFrame, least_coverage: float = 95.0, most_gaps: int = 1, most_outliers: float = 0.05) -> DataFrame:
    """(series_id, coverage, gaps, outliers, health, passed): health is the share of weight (error 3, warning 1) that issues leave."""
    base = coverage(points).join(missing_runs(points).filter("kind = 'complete_time_gap'").groupBy("series_id").agg(F.count("*").alias("gaps")), "series_id", "left")
    far = zscore_outliers(points).groupBy("series_id").agg(F.count("*").alias("outliers"))
    n = points.groupBy("series_id").agg(F.count("*").alias("n"))
    all_ = base.join(far, "series_id", "left").join(n, "series_id").na.fill(0, ["gaps", "outliers"])
    errors, warnings = (F.col("gaps") > 0).cast("int"), (F.col("outliers") > 0).cast("int") + (F.col("coverage") < 100).cast("int")
    health = F.when(errors + warnings > 0, 100 * (1 - (3 * errors + warnings) / (3 * (errors + warnings)))).otherwise(100.0)
    passed = (F.col("coverage") >= least_coverage) & (F.col("gaps") <= most_gaps) & (F.col("outliers") <= most_outliers * F.col("n"))
    return all_.select("series_id", "coverage", "gaps", "outliers", F.round(health, 1).alias("health"), passed.alias("passed"))
