"""File scan / sink round trips and the streaming cleaner."""
import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from spendlens.sources import files as FS
from spendlens.streaming.clean_stream import clean_stream, start


def test_csv_roundtrip_and_checks(spark):
    d = tempfile.mkdtemp(prefix="spendlens-test-")
    p = os.path.join(d, "stmt.csv")
    with open(p, "w") as f:
        f.write("description,amount,category\nswiggy food,120,food\nNA,null,bills\n")
    df = FS.load_dataset(spark, p)
    assert df.columns == ["description", "amount", "category"]
    assert df.where(F.col("description").isNull()).count() == 1
    with pytest.raises(FileNotFoundError):
        FS.validate_path(spark, os.path.join(d, "missing.csv"))
    with pytest.raises(ValueError):
        FS.require_columns(df.drop("category"))
    out = FS.write_table(df, os.path.join(d, "out"), fmt="csv")
    assert spark.read.option("header", True).csv(out).count() == 2
    FS.write_report(spark, {"rows": 2}, os.path.join(d, "report"))
    assert FS.read_report(spark, os.path.join(d, "report")) == {"rows": 2}


def test_streaming_clean_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="spendlens-stream-")
    src = os.path.join(d, "in")
    rows = [("swiggy food order", 10.0, "bills", "2024-01-01 00:00:00"),
            ("swiggy food order", 10.0, "bills", "2024-01-01 00:00:00"),
            ("uber ride", 5.0, "food", "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "description string, amount double, category string, ts string") \
        .withColumn("ts", F.to_timestamp("ts")).withColumn("date", F.to_date("ts")) \
        .write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    name = f"clean_test_{uuid.uuid4().hex}"     # a memory sink cannot resume
    q = start(spark, clean_stream(stream), name, sink="memory")
    q.processAllAvailable()
    q.stop()
    out = spark.sql(f"SELECT * FROM {name}").collect()
    assert len(out) == 2
    assert {r["category"] for r in out} == {"food", "transport"}
