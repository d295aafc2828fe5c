"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def components(links: DataFrame) -> DataFrame:
    """links: (lo, hi), longs with lo < hi. Returns (node, label) for every node of a link; label is the smallest node reachable.

    Every node first stands in for itself or its smallest lower neighbour, which leaves few links between unlike ones
    where stars are common; labels then spread over those.
    """
    up = links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("up"))
    nodes = links.select(F.col("lo").alias("node")).union(links.select("hi")).distinct().join(up, "node", "left")
    nodes = cut(nodes.select("node", F.coalesce("up", "node").alias("up")), "nodes")
    named = links.join(nodes.select(F.col("node").alias("lo"), F.col("up").alias("a")), "lo").join(nodes.select(F.col("node").alias("hi"), F.col("up").alias("b")), "hi")
    between = named.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct()
    labels = _spread(cut(between, "between")).select(F.col("node").alias("up"), "label")
    return cut(nodes.join(labels, "up", "left").select("node", F.coalesce("label", "up").alias("label")), "labels")


def _spread(links: DataFrame) -> DataFrame:
    """Each round takes the smallest label among a node and its neighbours, then the label of that label, so the rounds
    grow with the logarithm of the longest shortest path. A round is written to the shared folder.
    """
    if links.isEmpty():
        return links.select(F.col("lo").alias("node"), F.col("hi").alias("label"))
    both = links.select(F.col("lo").alias("src"), F.col("hi").alias("dst")).union(links.select("hi", "lo"))
    both = cut(both, "links")
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = step.join(up, "label").select("node", "was", F.least("label", "up").alias("label"))
        step = cut(step, "labels")
        labels = step.select("node", "label")
        if step.where("label < was").isEmpty():
            return labels
