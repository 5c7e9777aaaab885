"""Intermediate tables in the shared folder, deleted when their user is done."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import ensure_checkpoint_dir


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of ``path``: local, HDFS, object stores."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def delete(spark: SparkSession, path: str) -> None:
    files, place = file_system(spark, path)
    files.delete(place, True)


class Scratch:
    """``with Scratch(spark) as keep: t = keep(df)`` writes ``df`` below
    ``spark.checkpoint.dir`` and reads it again: lineage ends there, so a lost
    executor repeats no earlier work, and later reads prune columns.  The tables go
    at the end of the block, so nothing lazy may leave it that reads them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> "Scratch":
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        return written(df, f"{self.root}/{uuid.uuid4().hex}")

    def __exit__(self, *_) -> None:
        delete(self.spark, self.root)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a Parquet table at ``path``; column metadata (class names) is kept."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """A written copy whose folder stays, for results that are lazy themselves."""
    spark = df.sparkSession
    return written(df, f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}")
