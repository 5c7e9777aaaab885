"""One pass over the rows that adds up an array per partition: the step of an
iterative fit whose state is an array on the driver."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tree_groups(df: DataFrame) -> int:
    """Square root of the number of partitions, 1 for a few, 0 for one."""
    n = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return math.isqrt(n) if n > 32 else int(n > 1)


def summed(df: DataFrame, partial, shape: tuple[int, ...], groups: int = 1) -> np.ndarray:
    """Sum over all partitions of ``partial(record batches) -> array``; the arrays are
    first added in ``groups`` and then in one task, so the driver gets one array however
    many partitions there are (``groups`` 0: no sum before the driver's)."""
    def first(batches):
        yield _cell(partial(batches))

    def add(batches):
        total = np.zeros(shape)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x).reshape(shape)
        yield _cell(total)

    parts = df.mapInArrow(first, "a binary")
    if groups > 1:
        parts = parts.repartition(groups).mapInArrow(add, "a binary")
    if groups:
        parts = parts.repartition(1).mapInArrow(add, "a binary")
    return sum((np.frombuffer(r[0]).reshape(shape) for r in parts.collect()), np.zeros(shape))


def _cell(array: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([array.tobytes()], pa.binary())], ["a"])


def in_task(spark, fn, matrix: np.ndarray) -> np.ndarray:
    """``fn(matrix)`` of the same shape, computed in one task: Spark's workers run BLAS
    with one thread, while a threaded BLAS may hang in a driver that has forked its
    JVM."""
    def run(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                yield _cell(fn(np.frombuffer(x).reshape(matrix.shape)))

    one = spark.createDataFrame([(bytearray(matrix.tobytes()),)], "a binary")
    return np.frombuffer(one.mapInArrow(run, "a binary").first()[0]).reshape(matrix.shape)


def stacked(column: pa.Array, n: int) -> np.ndarray:
    """n equally long lists as a matrix."""
    if column.offset:
        return np.stack(column.to_numpy(zero_copy_only=False))
    return column.values.to_numpy().reshape(n, -1)
