"""Places of rows in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spendlens.llm.common import written

_SHIFT = 33  # monotonically_increasing_id: number of the partition above, row below


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows``, written, with ``place`` (0, 1, ... by ``order``, which must tell rows
    apart for ranges of even size).

    Rows are dealt by ranges of the order and sorted inside each; a row's place is
    its place in its range plus the sizes of the ranges before, of which there is
    one number a range."""
    keys = [f"__key{i}" for i in range(len(order))]
    dealt = rows.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*keys)
    placed = written(dealt.sortWithinPartitions(*keys).drop(*keys).withColumn(
        "__at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__at", _SHIFT)
    before, total = [], 0
    for p, n in sorted(placed.groupBy(part.alias("p")).count().collect()):
        before.append((p, total))
        total += n
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "__part long, __before long"))
    return placed.withColumn("__part", part).join(starts, "__part").withColumn(
        "place", F.col("__before") + F.col("__at") - F.shiftleft(F.col("__part"), _SHIFT)).drop(
        "__part", "__before", "__at")
