"""Row positions inside ordered slices, without one task per slice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written


def number_rows(df: DataFrame, slices: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Add ``out``: the 1-based position of a row in its slice under ``order``.

    The rows are range-partitioned over (slices, order), so a slice that holds a
    third of the table spreads over as many tasks as it needs.  A position is the
    rows before it in its own range plus the sizes of the slice's earlier ranges;
    only those sizes (one row per range and slice) are ranked by a window.
    The order should be total: break ties with a unique column.
    """
    by_slice = [F.col(c) for c in slices]
    ordered = df.repartitionByRange(*by_slice, *order).sortWithinPartitions(*by_slice, *order)
    # The upper bits of this id are the range, the lower 33 the row inside it.
    fixed = written(ordered.withColumn("_id", F.monotonically_increasing_id()))
    placed = fixed.withColumn("_range", F.shiftright("_id", 33))
    sizes = placed.groupBy(*slices, "_range").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")
    )
    earlier = Window.partitionBy(*slices).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *slices, "_range", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    # At most (number of ranges + number of slices) rows, whatever the table holds.
    joined = placed.join(offsets, [*slices, "_range"])
    position = F.col("_id") - F.col("_first") + F.col("_before") + 1
    return joined.withColumn(out, position.cast("int")).drop("_id", "_range", "_first", "_before")
