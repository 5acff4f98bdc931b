"""Global order without a single-task window.

A range-partitioned, sorted copy is written once; partition totals (one small
row per partition) turn offsets inside a partition into global positions or
running totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesight.session import materialise

PART, OFFSET, POSITION = "_part", "_offset", "_position"
_OFFSET_BITS = 33  # layout of monotonically_increasing_id: partition number above, row number below


def ordered_copy(df: DataFrame, order: list[Column]) -> DataFrame:
    """Sorted copy with each row's partition number and offset inside it."""
    row = F.monotonically_increasing_id()
    tagged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_row", row)
        .withColumn(PART, F.shiftright("_row", _OFFSET_BITS))
        .withColumn(OFFSET, F.col("_row").bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1)))
        .drop("_row")
    )
    return materialise(tagged)


def with_position(copy: DataFrame) -> DataFrame:
    """Add the 0-based global position to an ``ordered_copy``."""
    before = F.sum("_n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    # one row per partition of the copy, so the window and the broadcast stay small
    starts = (
        copy.groupBy(PART)
        .agg(F.count("*").alias("_n"))
        .select(PART, F.coalesce(before, F.lit(0)).alias("_start"))
    )
    return copy.join(F.broadcast(starts), PART).withColumn(POSITION, F.col("_start") + F.col(OFFSET)).drop("_start")


def running_totals(df: DataFrame, group: str, order: str, sums: list[str]) -> DataFrame:
    """Inclusive running totals ``upto_<c>`` and group totals ``total_<c>`` per group, ordered by ``order``.

    No group is ever held by one task: a group spread over many partitions is
    summed per partition and shifted by the totals of the partitions before.
    """
    copy = ordered_copy(df, [F.col(group), F.col(order)])
    parts = copy.groupBy(group, PART).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    earlier = Window.partitionBy(group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    shifts = parts.select(
        group,
        PART,
        *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums],
        *[F.sum(f"_{c}").over(whole).alias(f"total_{c}") for c in sums],
    )
    inside = Window.partitionBy(group, PART).orderBy(OFFSET).rowsBetween(Window.unboundedPreceding, 0)
    summed = copy.select("*", *[F.sum(c).over(inside).alias(f"_in_{c}") for c in sums])
    # rows of ``shifts``: groups plus partitions, at most
    return summed.join(shifts, [group, PART]).select(
        group,
        order,
        *sums,
        *[(F.col(f"_in_{c}") + F.col(f"_before_{c}")).alias(f"upto_{c}") for c in sums],
        *[f"total_{c}" for c in sums],
    )
