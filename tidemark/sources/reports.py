"""Forecasts as CSV files and reports as JSON, one for each series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import evaluate, models, prepare


def write_forecast_csv(forecasts: DataFrame, path: str, interval: int = 80) -> None:
    """Writes (series_id, method, step, point, lower_Npct, upper_Npct), a folder for each series."""
    out = forecasts.select("series_id", "method", F.col("h").alias("step"), "point", F.col("lower").alias(f"lower_{interval}pct"), F.col("upper").alias(f"upper_{interval}pct"))
    out.repartition("series_id").sortWithinPartitions("series_id", "method", "step").write.partitionBy("series_id").csv(path, header=True)


def json_reports(points: DataFrame, test: int, horizon: int, methods: tuple[str, ...] = ("naive", "mean", "drift", "linear")) -> DataFrame:
    """(series_id, report): JSON of the summary, the hold-out errors and the best method's forecast."""
    errors = evaluate.backtest(points, test, methods=methods)
    best = errors.filter("rank = 1").select("series_id", "method")
    steps = models.forecast(points, horizon, methods=methods).join(best, ["series_id", "method"])
    listed = lambda df, *cs: df.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(*cs))).alias("x"))
    held = listed(errors, "rank", "method", "mae", "rmse", "mape", "smape", "mase").withColumnRenamed("x", "backtest")
    ahead = listed(steps, "h", "method", "point", "lower", "upper").withColumnRenamed("x", "forecast")
    data = prepare.summary(points)
    data = data.select("series_id", F.struct(*(c for c in data.columns if c != "series_id")).alias("dataset"))
    return data.join(held, "series_id").join(ahead, "series_id").select("series_id", F.to_json(F.struct("dataset", "backtest", "forecast")).alias("report"))
