"""Connected components by joins: labels shrink to the smallest node until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskspark.llm.stored import stored


def component_labels(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node in ``links``; the root is the smallest node of its component.

    Each round hooks the root of a node to the smallest root next to it and then
    shortens the chains, so rounds grow with the logarithm of the longest path.
    Only counts reach the driver; each round is stored. Nodes in no link are not
    returned, an empty input gives an empty result.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    edges = stored(both.union(both.select("other", "node")).where("node <> other").distinct(), "links")
    labels = stored(
        edges.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "labels"
    )
    while True:
        near = labels.select(F.col("node").alias("other"), F.col("root").alias("other_root"))
        lowest = edges.join(near, "other").groupBy("node").agg(F.min("other_root").alias("low"))
        # A root takes the lowest root seen by any of its nodes.
        hooks = (
            labels.join(lowest, "node")
            .groupBy("root")
            .agg(F.min("low").alias("low"))
            .select("root", F.least("root", "low").alias("lower"))
        )
        moved = stored(labels.join(hooks, "root").select("node", F.col("lower").alias("root")), "hooked")
        jump = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = moved.join(jump, "root", "left").select("node", "root", F.coalesce("next", "root").alias("next"))
        after = stored(step.select("node", F.col("next").alias("root")), "labels")
        changed = after.join(labels.withColumnRenamed("root", "before"), "node").where("root <> before")
        if changed.isEmpty():
            return after
        labels = after
