"""Tables of the test data and the series made of them; a CSV reader for series.

A series is rows (series_id, t, value); operators add ``idx``, the place by time within the series, and never rely on
the order of rows. Session time zone is UTC.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: column names that are looked for, in this order
TIME_NAMES = ("timestamp", "time", "date", "datetime", "dt")
VALUE_NAMES = ("value", "y", "amount", "count", "total", "sales", "demand", "price", "quantity", "load", "temperature", "level")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its zone-less times as UTC timestamps, as watermarks need them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz})


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, also set for checkpoints. Where none is set, a new local one if Spark runs in one process, else an error."""
    held = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        held = tempfile.mkdtemp(prefix="tidemark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(held)
    return held.rstrip("/")


def indexed(points: DataFrame, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """Adds ``idx``: 0, 1, ... by time within the series."""
    return points.withColumn("idx", F.row_number().over(Window.partitionBy("series_id").orderBy(*order)) - 1)


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sum of value by event type."""
    events = table(spark, sf_dir, "events")
    return indexed(events.groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("t")).agg(F.sum("value").alias("value")))


def steady_sum(column: str) -> F.Column:
    """Sum of doubles that doesn't depend on the order of rows: whole parts add without error (below 2^53), and the error of the fractions' sum is far below a unit in the last place of the total."""
    whole = F.floor(column).cast("double")
    return F.sum(whole) + F.sum(F.col(column) - whole)


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily revenue as one series."""
    orders = table(spark, sf_dir, "orders")
    return indexed(orders.groupBy(F.lit("orders").alias("series_id"), F.to_date("o_orderdate").alias("t")).agg(steady_sum("o_totalprice").alias("value")))


def monthly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly revenue by segment (category) and nation."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    per = orders.groupBy("c_mktsegment", "c_nationkey", F.trunc("o_orderdate", "month").alias("t")).agg(F.sum("o_totalprice").alias("value"))
    return indexed(per.withColumn("series_id", F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string"))))


def arrays(points: DataFrame) -> DataFrame:
    """One row per series: its values in order (``y``) and their number (``n``). A series fits in a row."""
    y = F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda p: p["value"])
    return points.groupBy("series_id").agg(y.alias("y")).withColumn("n", F.size("y"))


def parsed_time(raw) -> F.Column:
    """Epoch milliseconds (13 digits or more), epoch seconds, or a time text."""
    n = F.expr(f"try_cast({raw} AS BIGINT)")
    return F.when(n.isNotNull() & (F.length(F.trim(F.col(raw))) >= 13), F.timestamp_millis(n)).when(n.isNotNull(), F.timestamp_seconds(n)).otherwise(F.expr(f"try_cast({raw} AS TIMESTAMP)"))


def read_series_csv(spark: SparkSession, path: str, time_column: str | None = None, value_column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, skipped) of a CSV with header. Rows with an empty value are skipped and told; other bad rows raise."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    names = {c.strip().lower(): c for c in raw.columns}

    def find(given: str | None, wanted: tuple[str, ...], place: int) -> str:
        if given is not None:
            if given.strip().lower() not in names:
                raise ValueError(f"no column {given}; there are {', '.join(raw.columns)}")
            return names[given.strip().lower()]
        for w in wanted:
            if w in names:
                return names[w]
        if len(raw.columns) == 2:
            return raw.columns[place]
        raise ValueError(f"no column found among {', '.join(wanted)}")

    t, v = find(time_column, TIME_NAMES, 0), find(value_column, VALUE_NAMES, 1)
    rows = raw.select(F.col(f"`{t}`").alias("raw_t"), F.col(f"`{v}`").alias("raw_v"), F.monotonically_increasing_id().alias("line"))
    rows = rows.select("line", "raw_t", "raw_v", parsed_time("raw_t").alias("t"), F.expr("try_cast(raw_v AS DOUBLE)").alias("value"))
    empty = F.coalesce(F.trim("raw_v"), F.lit("")) == ""
    bad = rows.filter(~empty & (F.col("t").isNull() | F.col("value").isNull() | F.isnan("value"))).orderBy("line").head()
    if bad:
        raise ValueError(f"bad row: time {bad['raw_t']!r}, value {bad['raw_v']!r}")
    points = rows.filter(~empty).select(F.lit("series").alias("series_id"), "t", "value", "line")
    return indexed(points, ("t", "line")), rows.filter(empty).select("line", F.lit("empty value").alias("reason"))


def read_wide_csv(spark: SparkSession, path: str, time_column: str | None = None, value_columns: list[str] | None = None) -> tuple[DataFrame, int]:
    """(rows in order of time: t and one double for each value column, number of rows left out because a chosen cell is empty) of a CSV with header.

    The first column is the time and all others are values unless named; other bad cells raise."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    time = time_column or raw.columns[0]
    names = value_columns or [c for c in raw.columns if c != time]
    if unknown := [c for c in (time, *names) if c not in raw.columns]:
        raise ValueError(f"no column {unknown[0]}; there are {', '.join(raw.columns)}")
    cells = [F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in (time, *names)]
    rows = raw.select(F.array(*cells).alias("cells"), F.col(f"`{time}`").alias("raw_t"))
    rows = rows.select("cells", parsed_time("raw_t").alias("t"), *(F.expr(f"try_cast(cells[{k + 1}] AS DOUBLE)").alias(c) for k, c in enumerate(names)))
    full = ~F.array_contains("cells", "")
    bad = rows.filter(full & (F.col("t").isNull() | F.greatest(*(F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`")) for c in names), F.lit(False)))).head()
    if bad:
        raise ValueError(f"bad row: {', '.join(bad['cells'])}")
    return rows.filter(full).drop("cells").orderBy("t"), rows.filter(~full).count()
