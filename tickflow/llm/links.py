"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.runtime import written


def components(links: DataFrame) -> DataFrame:
    """node, component for every node of the links (a, b); the component is its smallest node.

    Every round a node takes the smallest label among its neighbours and then that label's own label, so
    labels travel twice as far each round and stars are done in two. Each round is written to the shared
    folder; only the number of changed labels comes to the driver.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                    .distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.min("b").alias("low")).select(
        F.col("a").alias("node"), F.least("a", "low").alias("component")), "labels")
    while True:
        near = (edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("component").alias("low")))
        moved = labels.join(near, labels.node == near.a).select(
            "node", F.col("component").alias("was"), F.least("component", "low").alias("component"))
        moved = written(moved, "moved")
        jump = moved.select(F.col("node").alias("at"), F.col("component").alias("further"))
        new = written(moved.join(jump, moved.component == jump.at).select(
            "node", "was", F.least("component", "further").alias("component")), "labels")
        changed = new.where(F.col("was") != F.col("component")).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
