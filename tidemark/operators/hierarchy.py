"""Hierarchies as tables: (node, parent) rows of any number and depth, parent null at a top.

Depths and ancestors come from pointer doubling, in rounds that are the logarithm of the depth. Reconciliation passes once up and once
down the levels; a level is a shuffle of its rows and a table in the shared folder, so that no task holds a tree.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import shared_dir


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def depths(edges: DataFrame) -> DataFrame:
    """(node, parent, top, depth, children) of every node of ``edges`` (node, parent); tops have depth 0.

    Each round doubles how far pointers reach. A cycle, a node with two rows and a parent without a row of its own raise."""
    edges = _stored(edges.select("node", "parent"), "edges")
    nodes, names = edges.agg(F.count("*"), F.count_distinct("node")).head()
    if nodes != names:
        raise ValueError("a node of the hierarchy has several rows, or no name")
    if edges.filter("parent is not null").join(edges.select(F.col("node").alias("parent")), "parent", "left_anti").limit(1).count():
        raise ValueError("a parent of the hierarchy has no row of its own")
    at = edges.select("node", F.coalesce("parent", "node").alias("up"), F.col("parent").isNotNull().cast("int").alias("far"))
    reach, total = 1, None
    while True:
        further = at.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"))
        after = _stored(at.join(further, "up").select("node", F.col("up2").alias("up"), (F.col("far") + F.col("far2")).alias("far")), "pointers")
        # pointers that stand at a top go on no more
        before, total = total, after.agg(F.sum("far")).head()[0]
        at, reach = after, 2 * reach
        if total == before or not total:
            break
        if reach > 4 * nodes:
            raise ValueError("the hierarchy has a cycle")
    children = edges.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    out = edges.join(at.select("node", F.col("up").alias("top"), F.col("far").alias("depth")), "node").join(children, "node", "left")
    return out.select("node", "parent", "top", "depth", F.coalesce("children", F.lit(0)).alias("children"))


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, ancestor, distance) of all pairs, each node's own at distance 0 among them. As many rows as depths add up to."""
    exact = edges.filter("parent is not null").select("node", F.col("parent").alias("ancestor"))
    found, reach = edges.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")), 1
    while True:
        # ``exact`` has the ancestors at distance reach, ``found`` those below it
        hop = exact.select("node", F.col("ancestor").alias("middle"))
        beyond = hop.join(found.withColumnRenamed("node", "middle"), "middle").select("node", "ancestor", (F.col("distance") + reach).alias("distance"))
        found = _stored(found.unionByName(beyond), "ancestors")
        exact = _stored(hop.join(exact.withColumnRenamed("node", "middle"), "middle").select("node", "ancestor"), "ancestors-exact")
        reach *= 2
        if exact.isEmpty():
            return found


def roll_up_tree(leaves: DataFrame, edges: DataFrame, *by: str) -> DataFrame:
    """(node, by…, value, leaves): sums of ``value`` of the leaves (node, by…, value) below every node, by a join with the ancestors."""
    per = leaves.groupBy("node", *by).agg(F.sum("value").alias("value"))
    return per.join(ancestors(edges), "node").groupBy(F.col("ancestor").alias("node"), *by).agg(F.sum("value").alias("value"), F.count("*").alias("leaves"))


def reconcile_tree(base: DataFrame, edges: DataFrame, variances: DataFrame | None = None) -> DataFrame:
    """(node, h, point, reconciled): base forecasts (node, h, point) of a hierarchy (node, parent) made coherent by weighted least squares.

    ``variances`` (node, variance) are 1 where not given. An inner node without a forecast follows from its children; a step that lacks
    a leaf has null in all rows of that leaf's tree. Upwards, a node's own forecast and the sum of its children are merged by
    their variances; downwards, what a parent got more is shared out by the children's. The driver holds the steps and the number of levels only."""
    spark = base.sparkSession
    nodes = depths(edges)
    steps = sorted(r["h"] for r in base.select("h").distinct().collect())
    grid = nodes.withColumn("h", F.explode(F.array(*map(F.lit, steps)).cast(f"array<{dict(base.dtypes)['h']}>"))).join(base.select("node", "h", "point"), ["node", "h"], "left")
    known = variances.select("node", F.col("variance").alias("v")) if variances is not None else None
    grid = grid.join(known, "node", "left").withColumn("v", F.coalesce("v", F.lit(1.0))) if known is not None else grid.withColumn("v", F.lit(1.0))
    folder = f"{shared_dir(spark)}/reconciled-{uuid.uuid4().hex}"
    grid.write.partitionBy("depth").parquet(f"{folder}/grid")
    grid = spark.read.schema(grid.schema).parquet(f"{folder}/grid")
    deepest = nodes.agg(F.max("depth")).head()[0]
    if deepest is None:
        return base.select("node", "h", "point", F.col("point").alias("reconciled")).limit(0)
    up: dict[int, DataFrame] = {}
    for level in range(deepest, -1, -1):
        rows = grid.filter(F.col("depth") == level)
        if level < deepest:
            sums = up[level + 1].groupBy(F.col("parent").alias("node"), "h").agg(F.sum("mean").alias("m"), F.sum("spread").alias("s"), F.count("mean").alias("got"))
            rows = rows.join(sums, ["node", "h"], "left")
        else:
            rows = rows.withColumns({"m": F.lit(None).cast("double"), "s": F.lit(None).cast("double"), "got": F.lit(0).cast("bigint")})
        whole = F.col("got") == F.col("children")
        both = F.col("s") + F.col("v")
        mean = F.when(F.col("children") == 0, F.col("point")).when(~whole, None).when(F.col("point").isNull(), F.col("m")).otherwise(F.try_divide(F.col("point") * F.col("s") + F.col("m") * F.col("v"), both))
        spread = F.when(F.col("children") == 0, F.col("v")).when(F.col("point").isNull(), F.col("s")).otherwise(F.try_divide(F.col("s") * F.col("v"), both))
        up[level] = _stored(rows.select("node", "parent", "h", "point", "m", "s", mean.alias("mean"), spread.alias("spread")), "reconcile-up")
    out = _stored(up[0].withColumn("reconciled", F.col("mean")), "reconcile-down")
    done = [out]
    for level in range(1, deepest + 1):
        above = out.select(F.col("node").alias("parent"), "h", (F.col("reconciled") - F.col("m")).alias("more"), F.col("s").alias("shared"))
        out = _stored(up[level].join(above, ["parent", "h"]).withColumn("reconciled", F.col("mean") + F.try_divide("spread", "shared") * F.col("more")).drop("more", "shared"), "reconcile-down")
        done.append(out)
    return reduce(DataFrame.unionByName, (d.select("node", "h", "point", "reconciled") for d in done))


def coherence(reconciled: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, h, gap): what each inner node's reconciled value differs from its children's sum by."""
    sums = reconciled.join(edges, "node").filter("parent is not null").groupBy(F.col("parent").alias("node"), "h").agg(F.sum("reconciled").alias("below"))
    return reconciled.join(sums, ["node", "h"]).select("node", "h", (F.col("reconciled") - F.col("below")).alias("gap"))
