"""P5 as a job that can resume: files are scored in units, each unit is committed.

A unit is a fixed group of the statement's files.  Its rows are scored and written to
a folder of its own, then its manifest entry is committed; a second run scores only
units without an entry and writes over what a stopped run has left of them.  So each
input row gives one output row, however often the job was stopped.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..scratch import file_system
from .models import score
from .registry import committed, write_once


def list_files(spark: SparkSession, path: str, suffix: str = ".parquet") -> list[str]:
    """Data files below ``path`` in name order."""
    files, place = file_system(spark, path)
    found, entries = [], files.listFiles(place, True)
    while entries.hasNext():
        f = entries.next().getPath()
        if f.getName().endswith(suffix) and not f.getName().startswith(("_", ".")):
            found.append(f.toString())
    return sorted(found)


def units(files: list[str], files_per_unit: int) -> dict[str, list[str]]:
    """Groups of files, named by a digest of their paths: a unit whose files change is
    another unit."""
    groups = [files[i:i + files_per_unit] for i in range(0, len(files), files_per_unit)]
    return {hashlib.sha256("\n".join(g).encode()).hexdigest()[:16]: g for g in groups}


def score_files(spark: SparkSession, model: PipelineModel, files: list[str], out_dir: str,
                files_per_unit: int = 64, top_k: int = 3, schema=None,
                stop_after: int | None = None) -> int:
    """Score all units that are not committed yet; the number scored by this run.
    ``stop_after`` ends the run early (a next one goes on)."""
    done = {n.removesuffix(".json") for n in committed(spark, f"{out_dir}/commits")}
    store, place = file_system(spark, f"{out_dir}/commits")
    store.mkdirs(place)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    count = 0
    for name, group in units(files, files_per_unit).items():
        if name in done:
            continue
        if stop_after is not None and count >= stop_after:
            break
        rows = reader.parquet(*group)
        score(model, rows, top_k).select(*rows.columns, "predicted_category", "confidence",
                                         "top_3").write.mode("overwrite").parquet(
            f"{out_dir}/units/{name}")
        write_once(spark, f"{out_dir}/commits", f"{name}.json",
                   json.dumps({"unit": name, "files": group}))
        count += 1
    return count


def scored(spark: SparkSession, out_dir: str) -> DataFrame:
    """Rows of the committed units only."""
    names = [n.removesuffix(".json") for n in committed(spark, f"{out_dir}/commits")]
    if not names:
        raise FileNotFoundError(f"{out_dir}: no unit is committed")
    return spark.read.parquet(*(f"{out_dir}/units/{n}" for n in names))
