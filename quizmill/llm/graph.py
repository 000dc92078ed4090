"""Connected components by label spreading and pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm.textkit import drop, stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for the nodes of undirected edges; component is the smallest node that can be reached.

    Each round every node takes the smallest label among its neighbours and itself, then the label of its label. Labels
    go to the shared folder after each round, so no lineage grows and no executor holds the only copy.
    """
    both = stage(edges.select(F.col(a).alias("s"), F.col(b).alias("d")).unionByName(edges.select(F.col(b).alias("s"), F.col(a).alias("d"))).where("s <> d").distinct(), "edges")
    labels = stage(both.groupBy("s").agg(F.least(F.min("d"), F.col("s")).alias("l")).withColumnRenamed("s", "node"), "labels")
    while True:
        near = both.join(labels, both["s"] == labels["node"]).groupBy("d").agg(F.min("l").alias("m"))
        step = labels.join(near, labels["node"] == near["d"]).select("node", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        step = stage(step, "spread")
        up = step.select(F.col("node").alias("u"), F.col("l").alias("ul"))
        new = stage(step.join(up, step["l"] == up["u"], "left").select("node", "old", F.least("l", F.coalesce("ul", "l")).alias("l")), "labels")
        moved = new.where("l <> old").limit(1).count()
        drop(step)
        drop(labels)
        labels = new.select("node", "l")
        if not moved:
            drop(both)
            return labels.withColumnRenamed("l", "component")
