"""Numbers for the rows of a table, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrava.plans.storage import materialize


def numbered(rows: DataFrame, column: str, order: list[Column] | None = None) -> DataFrame:
    """``rows`` with their place from 0 in ``column``: in ``order``, or as they lie.

    Ordered rows are sorted by ranges. They are written once; a row's place is its place in its partition and how many rows the partitions before it hold, of which there is one
    number a partition.
    """
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(rows.withColumn("_n", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_n", 33)
    before = F.coalesce(F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_k")).select("_part", before.alias("_before"))
    placed = rows.join(F.broadcast(starts), part == F.col("_part"))  # a row a partition
    return placed.withColumn(column, F.col("_before") + F.col("_n").bitwiseAND((1 << 33) - 1)).drop("_n", "_part", "_before")
