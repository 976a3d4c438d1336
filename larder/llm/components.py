"""Connected components of a distributed set of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import saved, sided


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (node, label) for every node of a link; the label is the smallest node.

    Each round every node joins its smallest neighbour and the links are contracted to
    the nodes that are left; a component shrinks by at least half, so the rounds grow as
    the logarithm of its size. All tables stay distributed and are written each round.
    """
    c = F.col
    edges = saved(links.select("a", "b").filter("a <> b").distinct(), "links")
    labels = edges.select(c("a").alias("node")).union(edges.select(c("b").alias("node"))).distinct().withColumn("label", c("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select(c("b").alias("a"), c("a").alias("b")))
        low = both.groupBy(c("a").alias("u")).agg(F.min("b").alias("v")).select("u", F.least("u", "v").alias("v"))
        low = sided(saved(low, "lowest"))
        labels = saved(labels.join(low, c("label") == c("u"), "left").select("node", F.coalesce("v", "label").alias("label")), "labels")
        x = low.select(c("u").alias("u2"), c("v").alias("v2"))
        edges = saved(edges.join(low, c("a") == c("u")).join(x, c("b") == c("u2")).select(c("v").alias("a"), c("v2").alias("b"))
                      .filter("a <> b").distinct(), "links")
    return labels
