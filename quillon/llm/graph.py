"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import discard, stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b): the smallest node of its component.

    Each round takes the least label among neighbours and then the label of the label, so that chains halve. Labels are
    written to the shared folder every round; the driver sees only whether any changed.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        jumped = hooked.join(labels.select(F.col("node").alias("next"), F.col("label").alias("far")), "next", "left")
        moved = stage(jumped.select("node", F.least("next", F.coalesce("far", "next")).alias("label"), "old"), "labels")
        done = moved.filter("label <> old").isEmpty()
        discard(labels)
        labels = moved.select("node", "label")
        if done:
            discard(both)
            return labels
