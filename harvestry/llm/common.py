"""What several of the training-data operators share: staging, guarded broadcasts, column hygiene."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word-based contracts: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a side may have, once counted, to be broadcast.
BROADCAST_ROWS = 20_000


_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may lack one (tests); on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: later jobs don't repeat the work, and lost executors cost no more than their tasks."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Staged tables made inside are deleted at the end: what is to be kept must have been written elsewhere, or before."""
    first = len(_made)
    try:
        yield
    finally:
        for path in _made[first:]:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        del _made[first:]


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join that broadcasts `small` only if a count shows at most BROADCAST_ROWS rows; beyond that a shuffle join, which AQE splits where a key is hot. `small` should be staged: it is counted."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return big.join(small, on, how)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
