"""Connected components as joins: labels move along links and jump to their label's label until none changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component): the smallest node reachable, for every node that has a link.

    Each round joins narrow tables that were written to the shared folder, so that Spark can split the partition of
    a node with very many links. Jumping halves the distances, so the rounds grow with the logarithm of the longest chain.
    """
    both = materialise(
        links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links"
    )
    labels = materialise(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")),
        "labels",
    )
    while True:
        near = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy(F.col("a").alias("near_node"))
            .agg(F.min("component").alias("near"))
        )
        moved = labels.join(near, F.col("node") == F.col("near_node"), "left").select(
            "node",
            F.col("component").alias("before"),
            F.least("component", F.coalesce("near", "component")).alias("component"),
        )
        target = moved.select(F.col("node").alias("target"), F.col("component").alias("jump"))
        labels = materialise(
            moved.join(target, F.col("component") == F.col("target"), "left").select(
                "node", F.least("component", F.coalesce("jump", "component")).alias("component"), "before"
            ),
            "labels",
        )
        if labels.filter("component <> before").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
