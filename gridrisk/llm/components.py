"""Connected components of an edge table, by grouped minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``label`` (the least node of its component) of every node in ``a`` or ``b`` of ``edges``.

    Each round takes the least label among a node's neighbours and then the label's own label, so
    the number of rounds follows the logarithm of the longest chain.  Every round reads tables."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = scratch.table(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))))
    labels = scratch.table(both.groupBy("node").agg(F.least(F.min("other"), F.min("node")).alias("label")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("seen")), "other")
                    .groupBy("node").agg(F.min("seen").alias("seen")))
        new = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = scratch.table(new.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")))
        labels = new.select("node", "label")
        if not new.filter("label != old").limit(1).count():
            return labels
