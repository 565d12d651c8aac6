"""Connected components of a large graph, by labels that travel along edges and jump along labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import drop_table, materialize


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges(a, b), component being the least node reachable.

    Each round takes the least label among a node's neighbours, then the label of that label. All
    steps are joins and minima; each round is a written table.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(rounds):
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("__heard"))
        near = labels.join(heard, "node").select("node", F.col("label").alias("__was"), F.least("label", "__heard").alias("__near"))
        jump = labels.select(F.col("node").alias("__near"), F.col("label").alias("__far"))
        after = materialize(near.join(jump, "__near").select("node", "__was", F.least("__near", "__far").alias("label")), "labels")
        moved = after.where("label <> __was").limit(1).count()
        drop_table(labels)
        labels = after.drop("__was")
        if not moved:
            drop_table(both)
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
