"""Connected components by least labels: neighbours and labels of labels, so that long chains close in few rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import saved


def components(edges: DataFrame, by: str = "topic_id") -> DataFrame:
    """by, node, component (its least node) for every node of edges (by, a, b)."""
    links = saved(edges.select(by, "a", "b").union(edges.select(by, F.col("b"), F.col("a"))).distinct())
    labels = saved(links.groupBy(by, F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")))
    while True:
        near = links.join(labels.select(by, F.col("node").alias("b"), F.col("component").alias("c")), [by, "b"]).groupBy(by, F.col("a").alias("node")).agg(F.min("c").alias("c"))
        step = labels.join(near, [by, "node"]).select(by, "node", "component", F.least("component", "c").alias("c"))
        of = labels.select(by, F.col("node").alias("c"), F.col("component").alias("cc"))
        new = saved(step.join(of, [by, "c"]).select(by, "node", "component", F.least("c", "cc").alias("now")))
        moved = new.where("component <> now").limit(1).count()
        labels = new.select(by, "node", F.col("now").alias("component"))
        if not moved:
            return labels
