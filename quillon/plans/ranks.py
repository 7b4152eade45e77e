"""Row numbers within groups without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.lineage import cut


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with `name`, from 0 in each group by the order: a range sort whose parts are written; the counts that a group has in
    earlier parts shift the places in its own, so a hot group spreads over parts."""
    sort = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = cut(sort.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")))
    held = placed.groupBy(group, "__part").agg(F.min("__at").alias("first"), F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    shift = cut(held.select(group, "__part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("__shift")))
    return placed.join(shift, [group, "__part"]).withColumn(name, F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")
