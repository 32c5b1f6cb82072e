"""Accuracy of forecasts: metrics, hold-out and rolling backtests, tests of residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.functions.stats import norm_cdf
from tidemark.operators.models import forecast
from tidemark.operators.prepare import autocorrelation, train_test


def _by_idx() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("idx")


def metric_columns(actual: Column, predicted: Column) -> list[Column]:
    """mae, rmse, mape (zero actuals left out), smape (zero denominators count as 0)."""
    e = F.abs(actual - predicted)
    return [
        F.avg(e).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (100 * F.avg(F.try_divide(e, F.abs(actual)))).alias("mape"),
        (100 * F.sum(F.coalesce(F.try_divide(e, (F.abs(actual) + F.abs(predicted)) / 2), F.lit(0.0))) / F.count("*")).alias("smape"),
    ]


def scored(actuals: DataFrame, forecasts: DataFrame, by: tuple[str, ...], naive: DataFrame | None = None) -> DataFrame:
    """Metrics of ``forecasts`` (by..., h, point) against ``actuals`` (series_id, h, value); with ``naive`` (series_id, naive) also mase."""
    joined = forecasts.join(actuals, [c for c in ("series_id", "fold", "h") if c in actuals.columns])
    out = joined.groupBy(*by).agg(*metric_columns(F.col("value"), F.col("point")))
    return out if naive is None else out.join(naive, "series_id", "left").withColumn("mase", F.try_divide("mae", F.when(F.col("naive") != 0, F.col("naive")))).drop("naive")


def backtest(points: DataFrame, test: int, season: int | None = None, methods: tuple[str, ...] = ("naive", "snaive", "mean", "drift", "linear", "holt")) -> DataFrame:
    """(series_id, method, mae, rmse, mape, smape, mase, rank): methods fitted without the last ``test`` points."""
    split = train_test(points, test)
    train = split.filter("not is_test")
    sizes = train.groupBy("series_id").agg(F.count("*").alias("n"))
    actuals = split.filter("is_test").join(sizes, "series_id").select("series_id", (F.col("idx") - F.col("n") + 1).alias("h"), "value")
    naive = train.withColumn("d", F.abs(F.col("value") - F.lag("value").over(_by_idx()))).groupBy("series_id").agg(F.avg("d").alias("naive"))
    out = scored(actuals, forecast(train, test, season=season, methods=methods), ("series_id", "method"), naive)
    order = F.array_position(F.array(*map(F.lit, methods)), F.col("method"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("series_id").orderBy(F.round("rmse", 6), order)))


def rolling_origin(points: DataFrame, folds: int, test: int, methods: tuple[str, ...] = ("naive", "mean", "drift", "linear"), interval: int = 80) -> DataFrame:
    """(series_id, fold, method, mae, rmse, mape, smape, coverage): fold k is trained on (k + 1)·test points, tested on the next ``test``."""
    f = points.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    cut = (F.col("fold") + 1) * test
    key = F.concat_ws("#", "series_id", F.col("fold").cast("string"))
    train = f.filter(F.col("idx") < cut).withColumn("series_id", key)
    actuals = f.filter((F.col("idx") >= cut) & (F.col("idx") < cut + test)).select(key.alias("series_id"), (F.col("idx") - cut + 1).alias("h"), "value")
    fc = forecast(train, test, interval=interval, methods=methods).join(actuals, ["series_id", "h"])
    out = fc.groupBy("series_id", "method").agg(*metric_columns(F.col("value"), F.col("point")), (100 * F.avg(F.col("value").between(F.col("lower"), F.col("upper")).cast("double"))).alias("coverage"))
    return out.withColumn("fold", F.substring_index("series_id", "#", -1).cast("int")).withColumn("series_id", F.expr("left(series_id, length(series_id) - length(fold) - 1)"))


def fold_scales(points: DataFrame, folds: int, test: int) -> DataFrame:
    """(series_id, fold, scale): mean absolute step of the values that train a fold of ``rolling_origin``; errors over it are scaled errors."""
    step = points.select("series_id", "idx", F.abs(F.col("value") - F.lag("value").over(_by_idx())).alias("step"))
    f = step.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).filter(F.col("idx") < (F.col("fold") + 1) * test)
    return f.groupBy("series_id", "fold").agg(F.avg("step").alias("scale"))


def fold_report(points: DataFrame, folds: int, test: int, methods: tuple[str, ...] = ("naive", "mean", "drift", "linear"), interval: int = 80) -> DataFrame:
    """(series_id, method, folds, rmse, rmse_sd, mae, mae_sd, mape, mase, promised, coverage, rank) over the folds of ``rolling_origin``.

    Means of each metric; deviations are those of a sample, 0 for a single fold. Folds without a percentage (all actuals 0) or
    without a scale (constant training) are left out of mape and mase, which are null if none is left. Coverage is the mean share of
    actuals within the bands, beside the promised one. Rank 1 has the least mean rmse, of equals the method named first."""
    rolled = rolling_origin(points, folds, test, methods, interval).join(fold_scales(points, folds, test), ["series_id", "fold"], "left")
    mase = F.try_divide(F.col("mae"), F.when(F.col("scale") > 0, F.col("scale")))
    sd = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    out = rolled.groupBy("series_id", "method").agg(
        F.count("rmse").alias("folds"), F.avg("rmse").alias("rmse"), sd("rmse").alias("rmse_sd"), F.avg("mae").alias("mae"), sd("mae").alias("mae_sd"),
        F.avg("mape").alias("mape"), F.avg(mase).alias("mase"), F.lit(float(interval)).alias("promised"), F.avg("coverage").alias("coverage"),
    )
    order = F.array_position(F.array(*map(F.lit, methods)), F.col("method"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("series_id").orderBy(F.round("rmse", 6), order)))


def diebold_mariano(folds: DataFrame, metric: str = "rmse") -> DataFrame:
    """(series_id, method_a, method_b, n, mean_diff, statistic, p_value) of all pairs of methods over their folds."""
    a = folds.select("series_id", "fold", F.col("method").alias("method_a"), F.col(metric).alias("x"))
    b = folds.select("series_id", "fold", F.col("method").alias("method_b"), F.col(metric).alias("y"))
    d = a.join(b, ["series_id", "fold"]).filter("method_a < method_b").withColumn("d", F.col("x") - F.col("y"))
    out = d.groupBy("series_id", "method_a", "method_b").agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd")).filter("n >= 3")
    t = F.when(F.abs("mean_diff") < 1e-6, 0.0).otherwise(F.try_divide("mean_diff", F.col("sd") / F.sqrt("n")))
    return out.withColumn("statistic", t).withColumn("p_value", 2 * (1 - norm_cdf(F.abs("statistic")))).drop("sd")


def ljung_box(points: DataFrame, lags: int = 10, textbook: bool = False) -> DataFrame:
    """(series_id, statistic, p_value) of the values taken as residuals; the default weighs lags by (n + 2)(n + 1) / ((n - k) k)."""
    acf = autocorrelation(points, lags).join(points.groupBy("series_id").agg(F.count("*").alias("n")), "series_id")
    weight = F.col("n") * (F.col("n") + 2) / (F.col("n") - F.col("lag")) if textbook else (F.col("n") + 2) * (F.col("n") + 1) / ((F.col("n") - F.col("lag")) * F.col("lag"))
    out = acf.groupBy("series_id").agg(F.sum(F.col("acf") * F.col("acf") * weight).alias("statistic"))
    z = (F.pow(F.col("statistic") / lags, 1 / 3) - (1 - 2 / (9 * lags))) / (2 / (9 * lags)) ** 0.5
    return out.withColumn("p_value", 1 - norm_cdf(z))


def business_metrics(pairs: DataFrame, alpha: float = 0.9, sla: float = 0.9, top: float = 1.2, over: float = 1.0, under: float = 2.0) -> DataFrame:
    """Per series of (series_id, idx, value, point): weighted MAPE, service level, peak error, direction, cost."""
    w = pairs.withColumn("prev_v", F.lag("value").over(_by_idx())).withColumn("prev_p", F.lag("point").over(_by_idx())).withColumn("avg_v", F.avg("value").over(Window.partitionBy("series_id")))
    e, a = F.abs(F.col("value") - F.col("point")), F.col("value")
    weight = F.pow(F.lit(alpha), F.col("idx"))
    same = (F.col("value") > F.col("prev_v")) == (F.col("point") > F.col("prev_p"))
    return w.groupBy("series_id").agg(
        (100 * F.sum(weight * F.try_divide(e, F.abs(a))) / F.sum(weight)).alias("weighted_mape"),
        (100 * F.avg((F.try_divide(e, F.abs(a)) <= 1 - sla).cast("double"))).alias("service_level"),
        F.avg(F.when(a >= F.col("avg_v") * top, e)).alias("peak_mae"),
        (100 * F.avg(F.when(F.col("prev_v").isNotNull(), same.cast("double")))).alias("direction"),
        F.avg(F.when(F.col("point") > a, over * e).otherwise(under * e)).alias("cost"),
    )
