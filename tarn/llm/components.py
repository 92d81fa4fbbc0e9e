"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, dealt, hot_keys


def connected(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of `links` (a, b).

    Each round takes the smallest label among neighbours, then follows that label's own label, so a path of n nodes
    takes about log n rounds. Labels that a node with very many links receives are combined before the shuffle; those that
    it sends are dealt over parts.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct())
    hubs = hot_keys(both.groupBy("b").agg(F.count("*").alias("links")), "b", "links")
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).select(F.col("a").alias("node"), "component"))
    while True:
        near = dealt(both, labels.select(F.col("node").alias("b"), "component"), "b", hubs).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        least = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("lower"))
        after = cut(least.join(jump, "low", "left").select("node", "old", F.least("low", "lower").alias("component")))
        labels = after.select("node", "component")
        if after.filter("old != component").isEmpty():
            return labels
