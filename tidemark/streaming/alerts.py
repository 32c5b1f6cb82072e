"""Alerts over a series of readings: thresholds with escalation and cooldown, on the readings' own clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def threshold_alerts(points: DataFrame, limit: float, above: bool = True, cooldown_seconds: int = 60, escalate: tuple[int, int] = (3, 6)) -> DataFrame:
    """(series_id, t, value, hits, level): readings beyond ``limit`` that fire.

    ``hits`` counts neighbouring readings beyond the limit; the level rises at ``escalate`` hits. A rise of the level always
    fires; else a reading fires when it begins a new cooldown period of its run."""
    w = Window.partitionBy("series_id").orderBy("t")
    beyond = F.col("value") > limit if above else F.col("value") < limit
    p = points.withColumn("run", F.sum((~beyond).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(beyond)
    run = Window.partitionBy("series_id", "run").orderBy("t")
    p = p.withColumn("hits", F.row_number().over(run))
    level = F.when(F.col("hits") >= escalate[1], "critical").when(F.col("hits") >= escalate[0], "warning").otherwise("info")
    period = F.floor((F.unix_seconds(F.col("t").cast("timestamp")) - F.min(F.unix_seconds(F.col("t").cast("timestamp"))).over(Window.partitionBy("series_id", "run"))) / cooldown_seconds)
    p = p.withColumn("level", level).withColumn("period", period)
    fires = (F.col("hits") == 1) | F.col("hits").isin(*escalate) | (F.col("period") > F.lag("period").over(run))
    return p.withColumn("fires", fires).filter("fires").select("series_id", "t", "value", "hits", "level")
