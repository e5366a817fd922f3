"""Connected components of an edge table in a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import NO_BROADCAST, dropped, settings, written


def components(edges: DataFrame, counted: list[int] | None = None) -> DataFrame:
    """edges: a, b of one ordered type. Returns node, label: each node with an edge and the smallest node it reaches.

    Each round every node hooks onto its smallest neighbour, if that is smaller than itself. The hooks form trees;
    pointers are doubled until every node points at its tree's root, and edges are drawn between roots. A root either
    took a neighbour into its tree, or all its neighbours hooked onto smaller nodes, so that it hooks itself in the
    next round: two rounds leave half of the nodes at most, 2 log2(nodes) rounds none. A round takes log2(depth)
    doublings, for paths in key order as well.

    Both sides of every join are written tables, which adaptive execution can split where one node has a large share
    of the edges, and none is broadcast: the driver would collect one for every doubling. Null ends and loops are ignored; no edges give no rows. counted: gets the doublings of every round.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    with settings(edges.sparkSession, NO_BROADCAST):
        return _contracted(edges, counted)


def _contracted(edges: DataFrame, counted: list[int] | None) -> DataFrame:
    labels = None
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        up = written(ends.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("up")))
        jumps = 0
        while True:
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = written(up.select("node", "up").join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            dropped(up)
            up, jumps = jumped, jumps + 1
            if up.where("moved").isEmpty():
                break
        if counted is not None:
            counted.append(jumps)
        root = up.select("node", "up")
        drawn = (
            edges.join(root.toDF("a", "x"), "a")
            .join(root.toDF("b", "y"), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        new_edges = written(drawn)
        if labels is None:
            new_labels = written(root.withColumnRenamed("up", "label"))
        else:
            new_labels = written(labels.join(root.toDF("label", "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label")))
        dropped(edges, labels, up)
        edges, labels = new_edges, new_labels
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    dropped(edges)
    return labels
