"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import cut_plan


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of undirected links (a, b): the smallest node that can be reached.

    A round sends each node the smallest label next to it and then follows the label's own label, so star-shaped
    links take a few rounds whatever their size.  Joins are plain ones, so that a node with a large share of all
    links can be split at run time, and minima are aggregated before the shuffle.  Rounds are checkpointed.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b")
    both = cut_plan(both.distinct())
    labels = cut_plan(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = (
            both.join(labels.withColumnsRenamed({"node": "b", "component": "seen"}), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        )
        moved = labels.join(near, "node").select("node", F.least("component", "seen").alias("next"), F.col("component").alias("was"))
        after = moved.join(labels.select(F.col("node").alias("next"), F.col("component").alias("jump")), "next").select(
            "node", F.least("next", "jump").alias("component"), "was"
        )
        after = cut_plan(after)
        labels = after.select("node", "component")
        if after.filter("component != was").isEmpty():
            return labels
