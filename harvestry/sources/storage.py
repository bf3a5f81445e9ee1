"""Where sinks and streams of this library write: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir; only a local session may lack that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"
