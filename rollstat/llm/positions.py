"""Running sums over one global order, split into ranges; native operations only."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollstat.session import materialize


def range_sorted(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` range-partitioned by the whole order key and written once, with ``part`` and ``place``.

    ``part`` grows with the order; ``place`` is the row's place inside its part.  Ties are split
    by every column of ``order``, so a value that a third of the rows share spans many parts.
    """
    at = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    placed = placed.withColumn("part", F.shiftrightunsigned("_at", 33)).withColumn("place", F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")
    return materialize(placed, "sorted")


def running_sum(rows: DataFrame, group: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` per ``group`` (nulls are a group) in ``order``.

    Sums inside each range, plus one total per (group, range) for what lies before.
    """
    placed = range_sorted(rows, [group, *order])
    inside = Window.partitionBy(group, "part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy(group, "part").agg(F.sum(value).alias("_t")).select(
        F.col(group).alias("_g"), F.col("part").alias("_p"), F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))
    summed = placed.withColumn("_run", F.sum(value).over(inside))
    joined = summed.join(before, summed[group].eqNullSafe(before["_g"]) & (summed["part"] == before["_p"]))
    return joined.withColumn(name, F.col("_run") + F.col("_before")).drop("_run", "_before", "_g", "_p", "part", "place")


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """0-based number of every row in ``order``."""
    placed = range_sorted(rows, order)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = placed.groupBy("part").agg(F.count(F.lit(1)).alias("_t")).select(
        F.col("part").alias("_p"), F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(before, placed["part"] == before["_p"]).withColumn(
        name, F.col("place") + F.col("_before")).drop("_p", "_before", "part", "place")
