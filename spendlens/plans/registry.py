"""Saved models under one folder, each committed by an entry of a manifest.

A model counts once its entry stands in ``<folder>/registry``.  The entry is written
under a hidden name and renamed after model and metadata are complete, so a reader
never sees a save that failed half-way.  Entries carry a sequence number; two savers
that draw the same one are told apart by their unique names, and neither is lost.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import file_system

_ENTRY = "sequence long, path string, saved_at string, name string, metadata string"


def write_once(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """A small file that appears whole: written under a hidden name, then renamed."""
    files, hidden = file_system(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = files.create(hidden, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not files.rename(hidden, file_system(spark, f"{folder}/{name}")[1]):
        files.delete(hidden, False)
        raise OSError(f"{folder}/{name} could not be committed")


def committed(spark: SparkSession, folder: str) -> list[str]:
    """Names of the entries that stand in ``folder``."""
    files, place = file_system(spark, folder)
    if not files.exists(place):
        return []
    names = [f.getPath().getName() for f in files.listStatus(place)]
    return sorted(n for n in names if not n.startswith(".") and n.endswith(".json"))


def save_model(model: PipelineModel, model_dir: str, name: str = "transaction_classifier",
               metadata: dict | None = None) -> str:
    """The model in a folder with time and a unique end in its name, a JSON file of
    its metadata (metrics and sizes as given, time of saving) beside it, then its
    manifest entry."""
    spark = SparkSession.getActiveSession()
    stamp, unique = time.strftime("%Y%m%d_%H%M%S"), uuid.uuid4().hex[:8]
    path = f"{model_dir.rstrip('/')}/{name}_{stamp}_{unique}"
    model.write().save(path)
    meta = json.dumps({"model_path": path, "saved_at": stamp, **(metadata or {})}, default=str)
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(path + "_metadata")
    folder = f"{model_dir.rstrip('/')}/registry"
    files, place = file_system(spark, folder)
    files.mkdirs(place)
    last = max((int(n.split("-")[0]) for n in committed(spark, folder)), default=0)
    entry = {"sequence": last + 1, "path": path, "saved_at": stamp, "name": name, "metadata": meta}
    write_once(spark, folder, f"{last + 1:012d}-{unique}.json", json.dumps(entry))
    return path


def load_model(path: str) -> PipelineModel:
    """M23."""
    return PipelineModel.load(path)


def model_registry(spark: SparkSession, model_dir: str) -> DataFrame:
    """Committed models as a table (sequence, path, saved_at, name, metadata)."""
    folder = f"{model_dir.rstrip('/')}/registry"
    entries = [f"{folder}/{n}" for n in committed(spark, folder)]
    if not entries:
        return spark.createDataFrame([], _ENTRY)
    return spark.read.schema(_ENTRY).json(entries)


def latest(spark: SparkSession, model_dir: str) -> DataFrame:
    """The newest committed model (its entry; no row if there is none)."""
    return model_registry(spark, model_dir).orderBy(F.desc("sequence"), F.desc("path")).limit(1)
