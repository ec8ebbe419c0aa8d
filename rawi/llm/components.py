"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """Smallest vertex reachable from each vertex of ``links`` (columns a, b): columns v, label.

    Every round takes the smallest label among the neighbours and then jumps to
    the label's own label, so the number of rounds grows with the logarithm of
    the longest chain.  Labels are written to a shared table each round; only the
    number of changes reaches the driver.  An empty table gives no rows.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("low"))
        lower = labels.join(near, F.col("v") == F.col("a")).select("v", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        lower = written(lower)
        to = lower.select(F.col("v").alias("to"), F.col("label").alias("jump"))
        after = written(lower.join(to, F.col("label") == F.col("to")).select("v", "old", F.col("jump").alias("label")))
        changed = after.filter("old <> label").limit(1).count()
        labels = after.select("v", "label")
        if not changed:
            return labels
