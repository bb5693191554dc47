"""Running totals and ranks in groups of which no task sorts one whole.

A group is cut into slices along its order; rows are summed or numbered inside (group,
slice) and shifted by the sizes of the slices before. An empty table gives an empty
result; rows whose group or slice is null have no place and are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(rows: DataFrame, group: Sequence[str], order: Sequence[Column], part: Column, amount: Column, name: str) -> DataFrame:
    """Sum of ``amount`` over the rows of the group that come before, by ``order``.

    ``part`` is an integer that never falls along ``order``; it cuts a group into
    slices, each summed in its own window and shifted by the slices before. The table
    of slices has one row for each (group, part).
    """
    sliced = rows.withColumns({"_part": part, "_amount": amount})
    sizes = sliced.groupBy(*group, "_part").agg(F.sum("_amount").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*group, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    inner = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = sliced.withColumn("_before", F.coalesce(F.sum("_amount").over(inner), F.lit(0)))
    return summed.join(shifts, [*group, "_part"]).withColumn(name, (F.col("_before") + F.col("_shift")).cast("bigint")).drop("_part", "_amount", "_before", "_shift")


def positions(rows: DataFrame, group: Sequence[str], hashed: str, slices: int, name: str = "position", ties: Sequence[str] = ()) -> DataFrame:
    """Number the rows of each group 0, 1, 2, … in the order of a bigint hash, then ``ties``.

    With ties that tell unequal rows apart, a task that is run again numbers alike.
    """
    bits = max(1, min(20, (max(1, slices) - 1).bit_length()))
    return running_total(rows, group, [F.col(c) for c in (hashed, *ties)], F.shiftright(hashed, 64 - bits), F.lit(1), name)
