"""Connected components of a table of links, by Spark joins and aggregations; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlab.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): the least node that it reaches.

    Each round takes the least label among neighbours (a partial minimum per task first, so a node with very many links
    sends one row per task) and then the label of that label, which halves the depth of chains. Every round is written
    to the shared folder: a lost executor costs one round at most.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.filter("a <> b").distinct(), "links")
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
        "node", F.least("node", "least").alias("component")), "labels")
    while True:
        near = both.join(labels, both["a"] == labels["node"]).groupBy("b").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["b"], "left").select(
            "node", F.col("component").alias("old"),
            F.least("component", F.coalesce("near", "component")).alias("component"))
        lower = cut_lineage(lower, "labels")
        heads = lower.select(F.col("node").alias("head"), F.col("component").alias("above"))
        jumped = lower.join(heads, lower["component"] == heads["head"], "left").select(
            "node", "old", F.least("component", F.coalesce("above", "component")).alias("component"))
        jumped = cut_lineage(jumped, "labels")
        labels = jumped.select("node", "component")
        if not jumped.filter("old <> component").limit(1).count():
            return labels
