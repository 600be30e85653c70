"""Connected components of a link table, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.llm.staging import stage


def components(links: DataFrame, name: str) -> DataFrame:
    """``node, component`` of every node in ``links`` (a, b); the component is its least node.

    Each round takes the least label among neighbours, then the label of that
    label; every round is written to the shared folder. No edge is collected
    and no group gathered: each node's neighbours meet in a minimum only.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
                 .select("a", "b"), f"{name}-links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                   .select("node", F.least("node", "low").alias("component")), f"{name}-labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low")))
        hooked = labels.join(near, "node").select("node", F.col("component").alias("old"),
                                                  F.least("component", "low").alias("new"))
        parents = labels.select(F.col("node").alias("new"), F.col("component").alias("up"))
        moved = stage(hooked.join(parents, "new").select("node", "old", F.least("new", "up").alias("component")),
                      f"{name}-labels")
        labels = moved.select("node", "component")
        if moved.where("component <> old").isEmpty():
            return labels
