"""Folders for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder URI below spark.checkpoint.dir, the folder that driver and executors share.

    Where the setting is absent, which only local mode may be, a folder of this machine stands for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/tessella-scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
