"""Running totals over a long order without one task that holds it all.

Rows are dealt into slices of the order; totals per slice are summed up first (a small table), then
every slice is walked on its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS_PER_SLICE = 5_000
MOST_SLICES = 1 << 16


def slices_for(rows: int) -> int:
    """Slices of one long order of ``rows`` rows."""
    return max(16, min(MOST_SLICES, math.ceil(rows / ROWS_PER_SLICE)))


def unit(*parts: Column | str, seed: int) -> Column:
    """A number in [0, 1) from a hash of the parts; the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(*parts, F.lit(seed)), 11) / F.lit(float(1 << 53))


def slice_of(place: Column, slices: int) -> Column:
    """The slice of a place in [0, 1]."""
    return F.least(F.floor(place * slices), F.lit(slices - 1)).cast("int")


def running(df: DataFrame, group: str, part: str, order: list[Column], amount: str, before: str) -> DataFrame:
    """Adds ``before``: the sum of ``amount`` over earlier rows of ``group`` (slices ``part``, then ``order``).

    ``df`` is read twice. The slice totals have one row per group and used slice.
    """
    totals = df.groupBy(group, part).agg(F.sum(amount).alias("slice_sum"))
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(group).alias("slice_group"), F.col(part).alias("slice_part"),
        F.coalesce(F.sum("slice_sum").over(earlier), F.lit(0)).alias("slice_before"))
    inside = Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    walked = df.withColumn("inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    joined = walked.join(offsets, F.col(group).eqNullSafe(F.col("slice_group")) & (F.col(part) == F.col("slice_part")))
    return joined.withColumn(before, F.col("inside") + F.col("slice_before")).drop("slice_group", "slice_part", "slice_before", "inside")
