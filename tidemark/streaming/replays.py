"""Recorded points fed through a stream part by part, with a restart between the parts."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.streaming.engine import _folder
from tidemark.streaming.forecaster import ROCKS


@contextmanager
def state_store(spark: SparkSession):
    """The session's state store is RocksDB meanwhile, and state has as many partitions as the session shuffles to."""
    held = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(ROCKS[0])
        else:
            spark.conf.set(ROCKS[0], held)


def run_once(stream: DataFrame, out: str, marks: str) -> None:
    """Runs what there is; each batch replaces its own folder, so that one that is repeated counts once."""
    store = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    stream.writeStream.foreachBatch(store).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()


def replay_parts(parts: list[DataFrame], make: Callable[[DataFrame], DataFrame], folder: str | None = None) -> tuple[DataFrame, str]:
    """(all results of ``make`` over the parts as one stream, the checkpoint's path). Each part arrives after the query over those before has ended."""
    spark = parts[0].sparkSession
    base = folder or _folder(spark, "replay")
    with state_store(spark):
        for k, part in enumerate(parts):
            part.write.mode("append").parquet(f"{base}/feed")
            stream = spark.readStream.schema(parts[0].schema).parquet(f"{base}/feed")
            run_once(make(stream), f"{base}/out", f"{base}/marks")
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out").drop("batch"), f"{base}/marks"


def by_time(points: DataFrame, parts: int) -> list[DataFrame]:
    """``points`` cut into parts of equal spans of time."""
    low, high = points.agg(F.min(F.unix_micros("t")), F.max(F.unix_micros("t"))).head()
    at = lambda k: low + (high + 1 - low) * k // parts
    return [points.filter(F.unix_micros("t").between(at(k), at(k + 1) - 1)) for k in range(parts)]


def snapshots(spark: SparkSession, marks: str) -> DataFrame:
    """(series_id, points, mean, sd, refreshes, method, next, values) of each series of a forecaster, from its checkpoint: read as a table, the stream needs not run."""
    read = lambda name: spark.read.format("statestore").option("path", marks).option("stateVarName", name)
    with state_store(spark):
        moments = read("moments").load().select("key.series_id", "value.*")
        values = read("values").option("flattenCollectionTypes", "false").load()
        values = values.select("key.series_id", F.transform("list_value", lambda x: x["value"]).alias("values"))
    sd = F.sqrt(F.col("m2") / F.when(F.col("points") > 1, F.col("points") - 1))
    return moments.join(values, "series_id", "left").select("series_id", "points", "mean", F.coalesce(sd, F.lit(0.0)).alias("sd"), "refreshes", "method", "next", "values")
