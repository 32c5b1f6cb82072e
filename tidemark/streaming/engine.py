"""Series as streams: watermarked daily totals, and a forecaster with state for each series.

State of a series is bounded: the last ``window`` values, running count, mean and squares, and the latest forecast's
inputs. Points at or before the last time of their series are dropped as repeats.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources import tables
from tidemark.sources.tables import table

_OUT = "series_id string, points long, dropped long, mean double, sd double, drift boolean, next double"
_STATE = "values array<double>, last long, n long, mean double, m2 double, dropped long"


class IncrementalState:
    """What is kept of a series between batches: bounded values, running moments (Welford), the last time, repeats dropped."""

    def __init__(self, values=(), last: int = -1, n: int = 0, mean: float = 0.0, m2: float = 0.0, dropped: int = 0, window: int = 2000):
        self.values, self.last, self.n, self.mean, self.m2, self.dropped, self.window = list(values), last, n, mean, m2, dropped, window

    def add(self, t: int, v: float) -> bool:
        """Takes a point; False if its time isn't after the last one."""
        if t <= self.last:
            self.dropped += 1
            return False
        self.last, self.n = t, self.n + 1
        step = v - self.mean
        self.mean += step / self.n
        self.m2 += step * (v - self.mean)
        self.values = [*self.values[-(self.window - 1) :], v] if len(self.values) >= self.window else [*self.values, v]
        return True

    def sd(self) -> float:
        return float(np.sqrt(self.m2 / (self.n - 1))) if self.n > 1 else 0.0

    def drifted(self, recent: int = 30, threshold: float = 3.0) -> bool:
        late = self.values[-recent:]
        return bool(self.n >= 20 and len(late) >= 10 and self.sd() > 0 and abs(np.mean(late) - self.mean) / self.sd() > threshold)

    def smoothed(self, alpha: float = 0.3) -> float:
        level = self.values[0] if self.values else 0.0
        for v in self.values[1:]:
            level += alpha * (v - level)
        return level

    def row(self) -> tuple:
        return self.values, self.last, self.n, self.mean, self.m2, self.dropped


def _folder(spark: SparkSession, name: str) -> str:
    return f"{tables.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _event_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``events`` as a stream; its files are read where they are."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").option("maxFilesPerTrigger", 1).format("parquet").load(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t, n, value) of windows of a day, written in append mode as the watermark passes them and at the end of input."""
    events = _event_stream(spark, sf_dir, "events").withWatermark("ts", "1 hour")
    per = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    per = per.select(F.col("event_type").alias("series_id"), F.col("window.start").alias("t"), "n", "value")
    out, marks = _folder(spark, "stream-daily"), _folder(spark, "stream-daily-marks")
    store = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    query = per.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    latest = spark.read.parquet(out)
    # update mode writes a window once for each batch that changed it: the last one stands
    return latest.groupBy("series_id", "t").agg(F.max_by("n", "batch").alias("n"), F.max_by("value", "batch").alias("value"))


def replay(spark: SparkSession, sf_dir: str, window: int = 2000, drift_window: int = 30, threshold: float = 3.0) -> DataFrame:
    """(series_id, points, dropped, mean, sd, drift, next): state of each series after all hourly totals went through the forecaster."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = IncrementalState(*(state.get if state.exists else ()), window=window)
        for t, v in sorted((int(t), float(v)) for b in batches for t, v in zip(b["t"], b["value"], strict=True)):
            held.add(t, v)
        state.update(held.row())
        yield pd.DataFrame([(key[0], held.n, held.dropped, held.mean, held.sd(), held.drifted(drift_window, threshold), held.smoothed())], columns=["series_id", "points", "dropped", "mean", "sd", "drift", "next"])

    events = table(spark, sf_dir, "events")
    hourly = events.groupBy(F.col("event_type").alias("series_id"), F.unix_seconds(F.date_trunc("hour", "ts")).alias("t")).agg(F.sum("value").alias("value"))
    feed = _folder(spark, "stream-feed")
    hourly.repartitionByRange(4, "t").write.parquet(feed)
    points = spark.readStream.schema(hourly.schema).parquet(feed)
    states = points.groupBy("series_id").applyInPandasWithState(update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
    out, marks = _folder(spark, "stream-states"), _folder(spark, "stream-states-marks")
    store = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    states.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    latest = spark.read.parquet(out)
    return latest.groupBy("series_id").agg(*(F.max_by(c, "batch").alias(c) for c in ("points", "dropped", "mean", "sd", "drift", "next")))
