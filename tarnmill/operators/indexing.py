"""Dense numbers for all rows of a table, without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import shuffle_partitions, stage


def number_rows(df: DataFrame, *order: str | Column, name: str = "idx", start: int = 0) -> DataFrame:
    """`df` with `name`: start, start + 1, ... by `order`. Rows are sorted by ranges; each range's
    size shifts the numbers of the ranges after it."""
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return number_in_order(ranged, name, start)


def number_in_order(df: DataFrame, name: str = "idx", start: int = 0) -> DataFrame:
    """`df` with `name`: start, start + 1, ... in the order that its rows are in, as after a sort."""
    placed = stage(df.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    shift = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("__part", shift.alias("__shift"))  # one row for each range
    return placed.withColumn("__part", part).join(F.broadcast(shifts), "__part").withColumn(name, within + F.col("__shift") + F.lit(start)).drop("__part", "__shift", "__id")
