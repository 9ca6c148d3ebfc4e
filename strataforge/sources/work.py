"""A folder that driver and executors share, for snapshots that queries build on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from strataforge.errors import SnapshotError


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder takes its place, but only if driver and executors are one machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise SnapshotError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share.")
        base = f"file://{tempfile.mkdtemp(prefix='strataforge-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
