"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir (a local one only where that is unset, as in tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = tempfile.mkdtemp(prefix="paceline-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
