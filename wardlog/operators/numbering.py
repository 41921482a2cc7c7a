"""Places of rows in a global order, without bringing them into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlog.lineage import settle, sized

# monotonically_increasing_id keeps the number of the partition above this many bits, and the row in it below.
ROW_BITS = 33


def in_order(frame: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """`frame` with the place of each row, from 1, in the given order (rows that tie are in any order among themselves).

    The rows are dealt out by ranges and kept; one row per range says how many rows come before it. The sorted rows are
    kept in the checkpoint folder, so the ranges cannot change between counting and numbering.
    """
    placed = settle(frame.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, a row each
    starts = settle(sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")))
    return (placed.join(sized(starts), part == F.col("_part"))
            .withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1)
            .drop("_id", "_part", "_before"))
