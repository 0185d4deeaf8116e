"""Connected components of a distributed edge list.

Every node hooks onto its smallest smaller neighbour, the resulting trees are
flattened by pointer jumping, and edges are rewritten to tree roots; this is
repeated until no edge joins two roots.  Each round is a few aggregations and
equi-joins over staged tables, so a hub with a third of the edges is only a
skewed join key, and no component is ever gathered.  Staged tables take files by
the number of edges left, which falls with every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.llm.common import stage


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _flatten(parents: DataFrame, at_most: int) -> DataFrame:
    """(node, up): follow ``up`` to the root by doubling; ``at_most`` bounds the nodes."""
    while True:
        above = parents.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
        parents = stage(parents.select("node", "up").join(above, F.col("up") == F.col("_n"), "left").select(
            "node", F.coalesce("_u", "up").alias("up"), F.col("_u").isNotNull().alias("moved")), "cc-up", at_most)
        if parents.where("moved").isEmpty():
            return parents.select("node", "up")


def components(edges: DataFrame, at_most: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the component's smallest node.

    ``at_most`` bounds the number of edges, if one is known."""
    edges = stage(_tidy(edges), "cc-edges", at_most)
    nodes = 2 * (left := edges.count())
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct() \
        .select("node", F.col("node").alias("root"))
    while left:
        up = _flatten(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), left)
        jump = up.select(F.col("node").alias("_node"), F.col("up").alias("_up"))
        labels = stage(labels.join(jump, F.col("root") == F.col("_node"), "left").select(
            "node", F.coalesce("_up", "root").alias("root")), "cc-labels", nodes)
        for end in ("a", "b"):
            edges = edges.join(jump, F.col(end) == F.col("_node"), "left").withColumn(
                end, F.coalesce("_up", end)).select("a", "b")
        edges = stage(_tidy(edges), "cc-edges", left)
        left = edges.count()
    return labels
