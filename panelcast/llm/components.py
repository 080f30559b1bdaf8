"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.session import discard, stage


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node it can reach, for every node of ``a``-``b``.

    Each round takes the smallest label among the neighbours, then the label of that label, so
    chains halve. Labels are written as a table each round; only a changed-or-not bit is collected.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = both.unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    first = both.groupBy("node").agg(F.min("other").alias("low"))
    labels = stage(first.select("node", F.least("node", "low").alias("component")), "components")
    while True:
        other = labels.select(F.col("node").alias("other"), F.col("component").alias("theirs"))
        near = both.join(other, "other").groupBy("node").agg(F.min("theirs").alias("near"))
        lower = labels.join(near, "node").select(
            "node", "component", F.least("component", "near").alias("lower")
        )
        jump = labels.select(F.col("node").alias("lower"), F.col("component").alias("jump"))
        after = lower.join(jump, "lower").select(
            "node", F.least("lower", "jump").alias("component"), (F.least("lower", "jump") < F.col("component")).alias("moved")
        )
        after = stage(after, "components")
        discard(labels)
        labels = after.drop("moved")
        if not after.where("moved").limit(1).count():
            return labels
