"""Connected components of links by distributed union-find: hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, label) for every linked node; label: the smallest node of its component.

    Each round takes the smallest label among a node's neighbours, then the
    label's own label, so that the rounds grow with the logarithm of a chain. A
    node with very many links only meets them in partial minima and in joins
    that adaptive execution splits. No links give an empty result.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.filter("a <> b").distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    labels = materialize(labels.select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        hooked = labels.join(near, "node").select("node", F.least("label", "least").alias("label"), F.col("label").alias("old"))
        hooked = materialize(hooked, "hooked")
        roots = hooked.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = hooked.join(roots, "label").select("node", F.col("root").alias("label"), "old")
        jumped = materialize(jumped, "labels")
        changed = jumped.filter("label <> old").count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels
