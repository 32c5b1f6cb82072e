"""What the operators of this folder share: tables, scratch folders, broadcasts behind a size check."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A small side is broadcast only when its counted rows and bytes are at most this many.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a new local one if Spark runs in one process, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext.getCheckpointDir()
        if not held:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
            held = spark.sparkContext.getCheckpointDir()
        folder = held
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bytes_of(column: str, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    c = F.col(f"`{column}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        each = F.aggregate(c, F.lit(0), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0))) if isinstance(kind.elementType, (T.StringType, T.BinaryType)) else F.lit(0)
        return F.coalesce(F.size(c) * 8 * (len(kind.elementType) if isinstance(kind.elementType, T.StructType) else 1) + each, F.lit(0)) + 16
    return F.lit(8)


def small(df: DataFrame) -> DataFrame:
    """``df``, a stored table, marked for broadcast if its rows and bytes, which are counted, are few; else as it is, for a shuffled join."""
    width = sum((_bytes_of(f.name, f.dataType) for f in df.schema), F.lit(0))
    rows, size = df.agg(F.count("*"), F.sum(width)).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def slices(batch: pa.RecordBatch, column: str, rows: int = 1000, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most so many rows and bytes of ``column``; a row that is larger stands alone."""
    total, at = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)), 0
    while at < batch.num_rows:
        end = max(at + 1, min(at + rows, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right"))))
        yield batch.slice(at, end - at)
        at = end


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, gone: DataFrame, key: Column, kind: str = "left_anti") -> DataFrame:
    """``docs``, all columns, without the rows whose (doc_id, ``key``) is in ``gone``: two columns, stored. With ``kind`` left_semi, only those."""
    i, k, gi, gk = fresh(docs, "_i", "_k", "_gi", "_gk")
    keyed = docs.withColumn(i, F.col("doc_id").cast("bigint")).withColumn(k, key)
    gone = small(gone.toDF(gi, gk))
    return keyed.join(gone, keyed[i].eqNullSafe(gone[gi]) & (keyed[k] == gone[gk]), kind).drop(i, k)


def one_each(rows: DataFrame, key: Column) -> DataFrame:
    """One row for each (doc_id, ``key``), all columns."""
    (k,) = fresh(rows, "_k")
    return rows.withColumn(k, key).dropDuplicates(["doc_id", k]).drop(k)
