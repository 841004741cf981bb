"""Folders that driver and executors share, and small tables that stand written there, so that Spark knows their size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a small table that are sent to all tasks; with more it is for Spark to choose.
SENT_ROWS = 1 << 18


def store_path(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(rows: DataFrame, name: str = "staged") -> DataFrame:
    """The same rows, computed once and written."""
    path = store_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def sent(keys: DataFrame) -> DataFrame:
    """Staged rows of keys or ids as one side of a join: with SENT_ROWS at most they go to all tasks, and the other side stays
    where it is."""
    return F.broadcast(keys) if keys.limit(SENT_ROWS + 1).count() <= SENT_ROWS else keys
