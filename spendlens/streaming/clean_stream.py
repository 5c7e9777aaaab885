"""The cleaning operators on a Structured Streaming DataFrame.

Every cleaning step except dedupe is a stateless projection/filter, so the
batch operators apply unchanged to ``readStream`` input.  Dedupe becomes
``dropDuplicatesWithinWatermark`` (state bounded by the watermark delay).
This is the same operator set as the batch path, not an extra feature; the
checkpoint location lives under the cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..operators import clean as C
from ..session import ensure_checkpoint_dir


def clean_stream(df: DataFrame, event_time: str = "ts", delay: str = "1 day",
                 dedupe_subset: list[str] | None = None) -> DataFrame:
    """Standardise columns, amount, merchant, mode, drop missing, standardise
    text, relabel; then drop duplicates within the watermark."""
    d, _ = C.standardize_columns(df)
    d = C.extract_amount(d)
    d = C.add_merchant(d)
    d = C.add_transaction_mode(d)
    d = C.drop_missing_required(d)
    d = C.standardize_description(d)
    if "category" in d.columns:
        d = C.relabel_keywords(d)
    subset = dedupe_subset or C.default_dedupe_subset(d)
    d = d.withWatermark(event_time, delay)
    return d.dropDuplicatesWithinWatermark(subset) if subset else d


def start(spark: SparkSession, stream: DataFrame, name: str, sink: str = "parquet",
          path: str | None = None, **options):
    """Start a query with its checkpoint in the shared checkpoint folder."""
    ckpt = os.path.join(ensure_checkpoint_dir(spark), "streams", name)
    w = stream.writeStream.option("checkpointLocation", ckpt).outputMode("append")
    for k, v in options.items():
        w = w.option(k, v)
    if sink == "memory":
        return w.format("memory").queryName(name).start()
    return w.format(sink).start(path)
