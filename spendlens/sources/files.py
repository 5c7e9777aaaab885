"""Statement files: CSV / parquet scans, validation, projection, sinks.

* ``read_statement``: header CSV (or parquet); the pandas missing-value tokens
  become NULL; with ``schema`` there is no inference pass (what a large job
  should do), otherwise Spark infers types from the file.
* ``validate_path`` / ``require_columns``: plan-time checks.
* Sinks write with Spark writers into a new folder; never in place.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import constants as K

READERS = {".csv": "csv", ".parquet": "parquet"}
EXCEL = {".xlsx", ".xls"}


def validate_path(spark: SparkSession, path: str) -> str:
    """Format of a statement file or folder on any file system Spark reads.
    Spreadsheets are recognised but must be converted upstream (a per-machine
    binary format is not a distributed source)."""
    ext = os.path.splitext(path.rstrip("/"))[-1].lower()
    if ext in EXCEL:
        raise ValueError(f"{path}: convert the spreadsheet to CSV or parquet first")
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        raise FileNotFoundError(path)
    if ext in READERS:
        return READERS[ext]
    if not files.getFileStatus(place).isDirectory():
        raise ValueError(f"{path}: a statement is one of {sorted(READERS)}")
    names = [f.getPath().getName() for f in files.listStatus(place)]
    found = {READERS[e] for e in (os.path.splitext(n)[-1].lower() for n in names) if e in READERS}
    return found.pop() if len(found) == 1 else "parquet"


def na_to_null(df: DataFrame, tokens: list[str] = K.NA_TOKENS) -> DataFrame:
    """Map the missing-value tokens of string columns to NULL (exact match)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, StringType):
            cols.append(F.when(F.col(f"`{f.name}`").isin(tokens), F.lit(None).cast("string"))
                        .otherwise(F.col(f"`{f.name}`")).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def read_statement(spark: SparkSession, path: str, schema: StructType | str | None = None,
                   infer_schema: bool = True) -> DataFrame:
    """Scan a statement file."""
    fmt = validate_path(spark, path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE") \
        .option("multiLine", False).option("nullValue", "")
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", infer_schema)
    return na_to_null(reader.csv(path))


RECORD, REASON = "record", "reason"


def read_quarantined(spark: SparkSession, path: str, schema: StructType | str,
                     required: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """S1 without silent NULLs: (good rows with ``schema``, bad rows (record, reason)) of a
    header CSV; together they have as many rows as the files have data lines.

    A row is bad if its line has another number of fields than the schema, if a
    value is no value of its column's type, or if a ``required`` column is empty
    (missing-value tokens count as empty).  The first cause in this order is the reason,
    the columns from left to right.  The record is the line, or the row as JSON."""
    if validate_path(spark, path) != "csv":
        raise ValueError(f"{path}: only CSV lines can be malformed")
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    line = "__line"
    text = StructType([StructField(f.name, StringType()) for f in schema]
                      + [StructField(line, StringType())])
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", line).option("columnPruning", False).option(
        "nullValue", "").schema(text).csv(path)
    rows = raw.select(*(F.when(F.col(f"`{f.name}`").isin(K.NA_TOKENS), F.lit(None)).otherwise(
        F.col(f"`{f.name}`")).alias(f.name) for f in schema), line)  # a line may read like a token
    causes = [F.when(F.col(line).isNotNull(), F.lit("number of fields"))]
    typed = []
    for f in schema:
        c = F.col(f"`{f.name}`")
        value = c if isinstance(f.dataType, StringType) else F.trim(c).try_cast(f.dataType)
        typed.append(value.alias(f.name))
        causes.append(F.when(c.isNotNull() & value.isNull(),
                             F.lit(f"{f.name}: not of type {f.dataType.simpleString()}")))
    causes += [F.when(F.col(f"`{c}`").isNull(), F.lit(f"{c}: missing")) for c in required]
    judged = rows.withColumn("__reason", F.coalesce(*causes))
    record = F.coalesce(F.col(line), F.to_json(F.struct(*(F.col(f"`{f.name}`") for f in schema))))
    good = judged.where(F.col("__reason").isNull()).select(*typed)
    bad = judged.where(F.col("__reason").isNotNull()).select(
        record.alias(RECORD), F.col("__reason").alias(REASON))
    return good, bad


def require_columns(df: DataFrame, required: list[str] = K.REQUIRED_COLUMNS) -> DataFrame:
    """S3: ValueError listing the missing required columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"a statement needs the columns {missing}")
    return df


def training_projection(df: DataFrame, required: list[str] = K.REQUIRED_COLUMNS) -> DataFrame:
    """The required columns only (fixed order)."""
    return require_columns(df, required).select(*required)


def load_dataset(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Scan + validate + project."""
    return training_projection(read_statement(spark, path, schema))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                single_file: bool = False) -> str:
    """CSV (with header) or parquet sink.  ``single_file`` coalesces to one
    task, for small outputs only (a report, a preview)."""
    out = df.coalesce(1) if single_file else df
    w = out.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def write_report(spark: SparkSession, report: dict, path: str, mode: str = "errorifexists") -> str:
    """A run report / metadata record as one JSON row."""
    spark.createDataFrame([(json.dumps(report, default=str),)], "value string") \
        .coalesce(1).write.mode(mode).text(path)
    return path


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
