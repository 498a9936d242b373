"""Connected components by hooking to the least neighbour and contracting, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import durable


def _follow(pairs: DataFrame, parents: DataFrame, column: str) -> DataFrame:
    """Replace a column by its parent where it has one."""
    step = parents.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    joined = pairs.join(step, pairs[column] == F.col("_node"), "left")
    return joined.withColumn(column, F.coalesce("_root", column)).drop("_node", "_root")


def components(edges: DataFrame) -> DataFrame:
    """The least node that each node of the edges (u, v) can reach: node, root.  Nodes that are their own root may be absent.

    Each round hooks every node to its least neighbour, jumps pointers once, renames the edges and drops loops and
    repeats, so edges shrink each round; all tables stay distributed and each round ends in written tables.
    """
    edges = durable(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mapping = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooked = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).filter("root < node")
        parents = durable(_follow(hooked, hooked, "root"))
        mapping = parents if mapping is None else durable(_follow(mapping, parents, "root").unionByName(parents.join(mapping.select("node"), "node", "left_anti")))
        renamed = _follow(_follow(edges, parents, "u"), parents, "v").filter("u <> v")
        edges = durable(renamed.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")) if mapping is None else mapping
