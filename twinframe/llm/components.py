"""Connected components of a link table, as joins and groupings in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.llm.base import keep


def components(links: DataFrame) -> DataFrame:
    """(node, label): for every node of links (a, b), the smallest node it can reach; nodes without links are not in it.

    Each round a node takes the smallest label among itself and its neighbours, then the label of that label, so paths
    shorten by doubling. A round is two equi joins and a grouping, and its result is written to the shared folder.
    Loops, repeated links, and rows with a null end do no harm.
    """
    both = links.filter("a is not null and b is not null and a <> b").select("a", "b")
    both = keep(both.union(both.select("b", "a")).distinct())
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        around = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        lower = labels.join(around, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = keep(lower.join(hop, "label", "left").select("node", "was", F.least("label", "next").alias("label")))
        labels = moved.select("node", "label")
        if moved.filter("was <> label").isEmpty():
            return labels
