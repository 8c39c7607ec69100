"""Global offsets from partition totals, without passing rows through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def part_bases(rows: DataFrame, part: str, end: str) -> DataFrame:
    """(part, base): ids in all parts before each.  One row a part, so it may be broadcast.

    ``end`` is the count of ids in its part up to the end of a row.  Only the totals, one
    number for each write task, meet in the single window task.
    """
    totals = rows.groupBy(part).agg(F.max(end).alias("_total"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, F.coalesce(F.sum("_total").over(before), F.lit(0)).cast("long").alias("_base"))
