"""SparkSession helpers.

The library never creates its own cluster settings beyond what a job needs to
be correct: UTC session time (dates derived from timestamps must not depend on
the driver's zone), AQE with skew-join splitting, and a checkpoint directory
only when the cluster has not named one already.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings a correct run depends on; applied to an existing session too.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # HotSpot does not JIT methods above 8000 bytecodes; a whole-stage method
    # past that (e.g. ~90 keyword ``contains``) would run interpreted, slower
    # than the expression fallback this limit triggers.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "spendlens") -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        configure(active)
        return active
    builder = (
        SparkSession.builder.appName(app_name)
        .master(master or os.environ.get("SPARK_MASTER", "local[*]"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    )
    for k, v in RUNTIME_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, to which jobs cut their lineage.
    Where it is unset a local session gets a temporary folder; any other master
    must name a folder that its executors share."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = "file://" + tempfile.mkdtemp(prefix="spendlens-ckpt-")
    sc.setCheckpointDir(local)
    return local
