"""Places in a sorted order, found without putting all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised


def positions(df: DataFrame, order: Sequence[str], out: str = "position") -> DataFrame:
    """df with the place of each row in the order, from 0; null comes first.

    Range partitions are sorted and stored, a row's place is its place in the partition plus the rows of the partitions
    before. Only the sizes of the partitions are put in order in one task. Rows that are equal in `order` have neighbouring places.
    """
    local = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = materialised(local.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # One row per partition of the sort, a number that the session's settings bound.
    offsets = F.broadcast(sizes.select("_part", (before - F.col("_rows") - F.col("_first")).alias("_off")))
    return local.join(offsets, "_part").withColumn(out, F.col("_at") + F.col("_off")).drop("_part", "_at", "_off")


def dense_ranks(df: DataFrame, column: str, out: str = "rank") -> DataFrame:
    """(column, out): the place of each distinct value that is not null among them, from 0."""
    return positions(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], out)
