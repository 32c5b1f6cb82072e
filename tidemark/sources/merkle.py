"""Tables that can be compared without reading them: rows dealt to buckets by their key's hash, with a tree of digests above.

A bucket's digest is a sum of its rows' hashes, which doesn't depend on their order; a node's digest is the hash of its children's. Two tables
are compared from the root down; only children of nodes that differ are looked at, and only buckets that differ are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits of a bucket's name: 16 to their power is the number of buckets.
DIGITS = 3


def _row_hash(columns: list[str]) -> Column:
    """Of all columns by name; doubles by their bits' text, so that any change counts."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def _summed(h: Column) -> Column:
    halves = [F.sum(F.conv(F.substring(h, a, 12), 16, 10).cast("decimal(38,0)")).cast("string") for a in (1, 13, 25, 37, 49)]
    return F.sha2(F.concat_ws("|", *halves, F.count("*").cast("string")), 256)


def write_hashed(df: DataFrame, path: str, key: tuple[str, ...], digits: int = DIGITS) -> str:
    """Writes ``df`` below ``path``, in a folder for each bucket of the key's hash, and the tree of digests; returns the root's digest."""
    spark = df.sparkSession
    bucket = F.substring(F.sha2(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), 256), 1, digits)
    df.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/rows")
    rows = spark.read.schema(df.schema.add("_bucket", "string")).parquet(f"{path}/rows")
    level = rows.groupBy(F.col("_bucket").alias("node")).agg(_summed(_row_hash(df.columns)).alias("digest"), F.count("*").alias("n"))
    level.write.parquet(f"{path}/tree/level={digits}")
    for d in range(digits - 1, -1, -1):
        below = spark.read.schema("node string, digest string, n bigint").parquet(f"{path}/tree/level={d + 1}")
        parts = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat(x["node"], F.lit(":"), x["digest"]))
        # a node has at most 16 children
        below.groupBy(F.substring("node", 1, d).alias("node")).agg(F.sha2(F.array_join(parts, ","), 256).alias("digest"), F.sum("n").alias("n")).write.parquet(f"{path}/tree/level={d}")
    return root(spark, path)


def _level(spark: SparkSession, path: str, level: int) -> DataFrame:
    return spark.read.schema("node string, digest string, n bigint").parquet(f"{path}/tree/level={level}")


def root(spark: SparkSession, path: str) -> str | None:
    """The digest of a whole table; None if it has no row."""
    found = _level(spark, path, 0).head()
    return found["digest"] if found else None


def differing(spark: SparkSession, a: str, b: str, digits: int = DIGITS) -> list[str]:
    """The buckets that differ, from the root down: each step joins the children of the nodes found so far only."""
    nodes = [""]
    for level in range(digits + 1):
        of = lambda path: _level(spark, path, level).filter(F.substring("node", 1, max(level - 1, 0)).isin(nodes) if level > 1 else F.lit(True)).select("node", "digest")  # noqa: B023, E731
        left, right = of(a), of(b).withColumnRenamed("digest", "other")
        nodes = sorted(r["node"] for r in left.join(right, "node", "full").filter(~F.col("digest").eqNullSafe(F.col("other"))).select("node").collect())
        if not nodes:
            return []
    return nodes


def located_changes(spark: SparkSession, a: str, b: str, schema: str, key: tuple[str, ...], digits: int = DIGITS) -> DataFrame:
    """(key…, change, before, after) of the rows that differ between two tables written with ``write_hashed``: added, removed or changed, rows as JSON. Only buckets that differ are read."""
    buckets = differing(spark, a, b, digits)
    columns = [c.split()[0] for c in schema.split(", ")]

    def rows(path: str, name: str) -> DataFrame:
        read = spark.read.schema(f"{schema}, _bucket string").parquet(f"{path}/rows").filter(F.col("_bucket").isin(buckets) if buckets else F.lit(False))
        text = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
        return read.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(text)), ",").alias(name))

    before, after = rows(a, "before").alias("x"), rows(b, "after").alias("y")
    on = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in key]
    both = before.join(after, on, "full").filter(~F.col("before").eqNullSafe(F.col("after")))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return both.select(*(F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in key), change.alias("change"), "before", "after")


def reproduced(report: DataFrame, again: DataFrame, key: tuple[str, ...], values: tuple[str, ...], tolerance: float = 1e-10) -> DataFrame:
    """(key…, status, difference): same, changed, missing or new, for each row of a ``report`` and of the same run ``again``. ``difference`` is the largest of the values, relative where they exceed 1."""
    left, right = report.select(*key, *values).alias("x"), again.select(*key, *values).alias("y")
    both = left.withColumn("_x", F.lit(True)).join(right.withColumn("_y", F.lit(True)), list(key), "full")
    far = [F.when(F.col(f"x.{v}").isNull() & F.col(f"y.{v}").isNull(), 0.0).otherwise(F.coalesce(F.abs(F.col(f"x.{v}") - F.col(f"y.{v}")) / F.greatest(F.abs(F.col(f"x.{v}")), F.lit(1.0)), F.lit(float("inf")))) for v in values]
    difference = F.greatest(*far) if len(far) > 1 else far[0]
    status = F.when(F.col("_x").isNull(), "new").when(F.col("_y").isNull(), "missing").when(difference <= tolerance, "same").otherwise("changed")
    return both.select(*key, status.alias("status"), F.when(F.col("_x").isNotNull() & F.col("_y").isNotNull(), difference).alias("difference"))
