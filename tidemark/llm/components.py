"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b: bigint); root is the component's smallest node.

    Each round links larger neighbours (large star), then smaller ones (small star), to the smallest neighbour; rounds are
    logarithmic in the longest path. Tables of a round are written to the shared folder."""
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        # each node's larger neighbours go to its smallest; a root, to which a third of all may be linked, has none and needs no group
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        large = edges.join(least.select(F.col("a").alias("b"), "m"), "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        # then each node and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = stored(small.select("e.*").filter("a <> b").distinct(), name)
        # done when every node has one edge and no root is a node itself
        open_ends = after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count() + after.groupBy("a").count().filter("count > 1").limit(1).count()
        edges = after
        if not open_ends:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
