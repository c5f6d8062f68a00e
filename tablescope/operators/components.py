"""Connected components of an edge table by smallest label, with pointer shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.session import materialize


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node id reachable over ``edges`` (a, b), both ways.

    Every round takes the smallest label among the neighbours, then the label's own label,
    so long paths shrink quickly. Stops when no label changes.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(nodes.select("node", F.col("node").alias("component")))
    while True:
        offered = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("low"))
        step = materialize(labels.join(offered.withColumnRenamed("a", "node"), "node", "left").select(
            "node", F.col("component").alias("old"), F.least("component", F.coalesce("low", "component")).alias("component")
        ))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = materialize(step.join(jump, "component", "left").select("node", "old", F.coalesce("next", "component").alias("component")))
        if labels.filter(F.col("old") != F.col("component")).isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
