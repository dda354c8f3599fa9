"""Connected components of a graph of document ids, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of (a, b): component is its smallest node.

    Each round hooks: every node learns the smallest label at its ends and that
    label's own label, so labels travel twice as far each time.  Stars are kept shallow by
    linking to smallest ids only, so no node gathers more than its own edges.  Ends when
    no label changes; rounds follow the logarithm of the longest path.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a != b").distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(seen, "node").select("node", "component", F.least("component", "near").alias("next"))
        # The label's own label: pointers double.
        roots = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        moved = cut(
            hooked.join(roots, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("component"), (F.least("next", F.coalesce("far", "next")) < F.col("component")).alias("moved")),
            "labels",
        )
        labels = moved.select("node", "component")
        if moved.where("moved").limit(1).count() == 0:
            return labels
