"""Connected components of an undirected graph, without gathering any of it in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewalk.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reached.

    Each round maps every node to its smallest neighbour and rewrites the edges accordingly; edges
    whose ends meet disappear, so rounds grow with the logarithm of path lengths. The maps are
    then applied one after the other. Rows of one node meet only in a pre-aggregated minimum and in
    joins against one row a node.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
        .select("node", F.least("node", "component").alias("component")),
        "labels",
    )
    step = labels
    while True:
        left = step.select(F.col("node").alias("a"), F.col("component").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("component").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x <> y")
        moved = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if moved.isEmpty():
            return labels
        edges = moved
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialize(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
            .select("node", F.least("node", "component").alias("component")),
            "labels",
        )
        onward = step.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = materialize(
            labels.join(onward, "component", "left").select("node", F.coalesce("next", "component").alias("component")),
            "labels",
        )
