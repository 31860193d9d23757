"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Recording the Python call site of every column doubles the time to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "ghgspark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the engine's defaults; keyword settings use ``__`` for a dot."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {**DEFAULTS, **{key.replace("__", "."): value for key, value in conf.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which the driver and every executor reach.

    Where it is unset, a session of one machine (tests, trials) gets a folder of its own; a cluster has to set it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="ghgspark-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing path below the scratch root."""
    return os.path.join(scratch_root(spark), f"{label}-{uuid.uuid4().hex}")


def kept(frame: DataFrame, label: str, *by: str) -> DataFrame:
    """Evaluated once, below the scratch folder: read again, its size is known, so a small one is joined without a shuffle."""
    path = scratch_path(frame.sparkSession, label)
    frame.write.partitionBy(*by).parquet(path, compression="zstd")
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
