"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) of every node in `links` (a, b).

    Each turn a node takes the smallest label beside it, then the label of that
    label, so chains shorten by more than half. A node with many links is
    pre-aggregated on the map side; only (node, label) rows travel.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label"))
    labels = stored(labels)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("label").alias("next"))
        turn = stored(step.join(jump, "now", "left").select("node", "was", F.least("now", F.coalesce("next", "now")).alias("label")))
        changed = not turn.filter("was <> label").isEmpty()
        labels = turn.select("node", "label")
        if not changed:
            return labels
