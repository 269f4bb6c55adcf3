"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import table


def star(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: edges that join the same nodes as ``edges`` (a, b), the dense ones' far fewer.

    A node's smaller neighbours are joined to the smallest of them instead of to the node, which keeps its edge to that one.
    Taken twice, it leaves a group in which each knows 25 others, or all others, about an edge a node.
    """
    ordered = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    least = ordered.withColumn("a", F.min("lo").over(Window.partitionBy("hi")))
    ends = F.explode(F.when(F.col("lo") == F.col("a"), F.array("hi")).otherwise(F.array("lo", "hi")))
    return least.select("a", ends.alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b), component being the smallest node reached.

    Each round takes the smallest label among a node and its neighbours and then that label's own
    label, so paths halve; a round's labels are a written table.  Ends when no label moves.
    """
    edges = table(star(star(edges)), "star")
    both = table(edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("near"))).distinct(), "links")
    labels = table(both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("near"), "component"), "near").groupBy("node").agg(F.min("component").alias("least"))
        step = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "least").alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("component").alias("further"))
        moved = table(step.join(jump, "now", "left").select("node", "old", F.least("now", F.coalesce("further", "now")).alias("component")), "labels")
        labels = moved.select("node", "component")
        if moved.filter("old <> component").isEmpty():
            return labels
