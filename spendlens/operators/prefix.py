"""Running sums inside groups of any size, without one task per group.

Rows are dealt by ranges of (group, order) and sorted; each range sums its part of
each group, the sums of a group's earlier ranges are added up on that small table
(a row per range and group that meet), and a row's running sum is its group's
offset plus the running sum inside its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import kept

_SHIFT = 33  # monotonically_increasing_id: number of the partition above, row below


def prefix_sums(df: DataFrame, group: str, order: Column, sums: dict[str, str]) -> DataFrame:
    """``df`` with, for each ``{out: column}``, the running sum ``out`` of the column in its
    group by ascending ``order`` (this row's included) and the group's sum
    ``<out>_all``.  The order must tell a group's rows apart."""
    dealt = df.withColumn("__order", order).repartitionByRange(F.col(group), F.col("__order"))
    placed = kept(dealt.sortWithinPartitions(group, "__order").withColumn(
        "__part", F.shiftright(F.monotonically_increasing_id(), _SHIFT)))
    parts = placed.groupBy("__part", group).agg(*(F.sum(c).alias(o) for o, c in sums.items()))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    offsets = parts.select("__part", F.col(group).alias("__group"), *(
        F.coalesce(F.sum(o).over(before), F.lit(0)).alias(f"__{o}") for o in sums), *(
        F.sum(o).over(whole).alias(f"{o}_all") for o in sums))
    inside = Window.partitionBy("__part", group).orderBy("__order").rowsBetween(
        Window.unboundedPreceding, 0)
    running = placed.withColumns({o: F.sum(c).over(inside) for o, c in sums.items()})
    joined = running.join(offsets.withColumnRenamed("__part", "__range"), (
        F.col("__part") == F.col("__range")) & F.col(group).eqNullSafe(F.col("__group")))
    return joined.withColumns({o: F.col(o) + F.col(f"__{o}") for o in sums}).drop(
        "__order", "__part", "__range", "__group", *(f"__{o}" for o in sums))
