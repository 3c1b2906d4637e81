"""The folder that driver and executors share, for tables that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def fresh_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder under ``spark.checkpoint.dir``; a local one is set where none is and the master is local, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='loom-shared-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def local_path(uri: str) -> str:
    """The path under which every worker sees a folder; others than mounted ones raise an error."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{uri}: must lie on a mounted (file:) path")
    return parts.path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once and read back: cuts a lineage that grows in a loop, and survives lost executors."""
    at = fresh_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
