"""Connected components of a table of links, by label passing with pointer jumping in checkpointed rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b): component is the smallest node that links reach."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct()
    both = materialise(both, "edges")
    labels = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component"))
    labels = materialise(labels, "labels")
    while True:
        near = labels.select(F.col("node").alias("other"), F.col("component").alias("_near"))
        seen = both.join(near, "other").groupBy("node").agg(F.min("_near").alias("_seen"))
        passed = labels.join(seen, "node").select("node", F.col("component").alias("_old"), F.least("component", "_seen").alias("_to"))
        up = labels.select(F.col("node").alias("_to"), F.col("component").alias("_up"))
        jumped = passed.join(up, "_to").select("node", "_old", F.least("_to", "_up").alias("component"))
        jumped = materialise(jumped, "labels")
        labels = jumped.select("node", "component")
        if jumped.where(F.col("_old") != F.col("component")).isEmpty():
            return labels
