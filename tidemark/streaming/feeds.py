"""Points from JSON lines, of batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that a feed may give to the time and the series; the first present counts.
TIMES = ("t", "time", "timestamp", "iso", "date")
NAMES = ("seriesId", "series")


def _time(text: Column) -> Column:
    """Numbers below 10^12 are seconds, others milliseconds; all else is a time text."""
    n = text.try_cast("double")
    return F.when(n.isNull(), text.try_cast("timestamp")).when(n < 1e12, F.timestamp_millis((n * 1000).cast("bigint"))).otherwise(F.timestamp_millis(n.cast("bigint")))


def points_from_json(lines: DataFrame, column: str = "line", default_id: str = "default") -> DataFrame:
    """(series_id, t, value) of the lines that hold a finite value; a line without time has a null ``t``."""
    schema = ", ".join(f"`{c}` string" for c in (*NAMES, *TIMES, "value"))
    p = lines.select(F.from_json(column, schema).alias("p")).select("p.*")
    value = F.col("value").try_cast("double")
    out = p.select(F.coalesce(*NAMES, F.lit(default_id)).alias("series_id"), _time(F.coalesce(*TIMES)).alias("t"), value.alias("value"))
    return out.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
