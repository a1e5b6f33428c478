"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillworks.llm.common import discard, spread_join, store


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, of the edges (a, b), which are longs.

    Every round takes the smallest label among the neighbours and then the label's own label, until nothing changes; each
    round's labels are written to the shared folder. The rows of a node with many neighbours, and of a label with many nodes,
    are dealt over several tasks.
    """
    both = store(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = spread_join(both, labels.withColumnRenamed("node", "b"), "b", by="a").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = store(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "lower")
        of = lower.select(F.col("node").alias("label"), F.col("label").alias("of"))
        jumped = spread_join(lower, of, "label", by="node", how="left").withColumn("new", F.least("label", "of"))
        moved = store(jumped.select("node", F.col("new").alias("label"), (F.col("new") != F.col("old")).alias("moved")), "labels")
        changed = not moved.where("moved").isEmpty()
        discard(labels, lower)
        labels = moved
        if not changed:
            discard(both)
            out = labels.select("node", "label")
            out._stored_at = labels._stored_at
            return out
