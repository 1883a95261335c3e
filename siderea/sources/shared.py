"""A folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name under spark.checkpoint.dir; where that is unset a local session gets a temporary one, a cluster an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="siderea-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if urlparse(path).scheme else "file://" + path)
