"""Helpers the operators share: table access, Arrow batch bounds, shared
folders, text columns as bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from spendlens.session import ensure_checkpoint_dir

#: Rows and bytes of one Arrow batch sent to a Python worker; texts may be
#: hundreds of kilobytes, so the default of 10,000 rows is not a memory bound.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20

#: White space other than the blank and the line end, and the runs
#: in which these two touch a blank.
_ODD_SPACE = [chr(c) for c in (
    0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002,
    0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F,
    0x205F, 0x3000)] + ["  ", " \n", "\n "]


def blank_separated(text: str) -> bool:
    """Whether each blank of ``text`` stands between two other characters that
    are no white space.  Then each blank starts a piece of the byte-level
    tokenizers' pattern, and the text can be encoded by its blank-separated
    chunks.  (Substring tests are many times faster than one pattern.)"""
    return not (text.endswith(" ") or any(map(text.__contains__, _ODD_SPACE)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Set the session's Arrow batch bounds (the plan reads them when it runs)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again.
    Unlike ``checkpoint()`` the copy is columnar, so later reads prune columns."""
    spark = df.sparkSession
    path = shared_folder(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def under_plain_names(docs: DataFrame, used: tuple[str, ...], fn) -> DataFrame:
    """``fn(docs)`` for an ``fn`` that keeps the columns of its input: columns other than
    ``used`` bear plain names meanwhile, so they may have any name (dots, or names that
    ``fn`` uses itself) and come back as they were."""
    inner = [c if c in used else f"x{i}" for i, c in enumerate(docs.columns)]
    return fn(docs.toDF(*inner)).select(*inner).toDF(*docs.columns)


def texts(column: pa.Array) -> list[str]:
    """Strings of a batch column; NULL counts as the empty text."""
    return [x or "" for x in column.to_pylist()]


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a batch column without decoding; NULL counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def list_slices(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each row of a list<primitive> column as a numpy view (None for NULL)."""
    offsets = np.asarray(column.offsets)
    flat = column.values.to_numpy(zero_copy_only=False)
    valid = np.asarray(column.is_valid())
    for i in range(len(column)):
        yield flat[offsets[i]:offsets[i + 1]] if valid[i] else None


def held_out(doc_id: str, folds: int, remainder: int):
    """crc32 of the id as text modulo ``folds`` equals ``remainder``; a NULL id
    counts as the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return (F.crc32(F.encode(text, "UTF-8")) % folds) == remainder
