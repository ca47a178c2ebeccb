"""Places and running sums within groups of any size.

Rows are dealt by ranges of (group, order) and sorted within their partition, so a group's
rows are in as many partitions as they fill. What each partition holds of a group is summed,
those sums are added up in order of partition (a row per group and partition), and each
partition goes on from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import materialise


def placed(rows: DataFrame, group: list[str], order: list[Column], size: str) -> DataFrame:
    """_g (the group), _row (the row), _size, _at (the row's place in its group, from 1), _sum (sizes up to and with it), as a table. A null size is 0; rows of equal order are in an order that is found once."""
    dealt = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    dealt = dealt.select(F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)]).alias("_g"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rows.columns)]).alias("_row"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))
    numbered = materialise(dealt.withColumns({"_id": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}), "placed")
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = numbered.groupBy("_g", "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"), F.sum("_size").alias("_s"))
    parts = parts.select("_g", "_part", "_first", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("_n", "_before"), ("_s", "_so_far"))])
    met = numbered.join(parts, ["_g", "_part"])
    within = Window.partitionBy("_g", "_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    return materialise(met.select("_g", "_row", "_size", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("_at"), (F.col("_so_far") + F.sum("_size").over(within)).alias("_sum")), "placed")
