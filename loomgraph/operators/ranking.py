"""Places in a total order, without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.sources.shared import materialise


def placed(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """``rows`` with the place of each, from 1. They are sorted by range and written; a place is the row's number in its range plus
    the sizes of the ranges before, which are as few as the partitions."""
    numbered = materialise(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    ranges = numbered.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(ranges.select("_range", before.alias("_before")))
    full = numbered.withColumn("_range", F.shiftright("_at", 33)).join(offsets, "_range")
    return full.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_range", "_at", "_before")
