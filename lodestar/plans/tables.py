"""The tables that queries read, and the folder that they may write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that the driver and all executors share: ``spark.checkpoint.dir``, or on one machine a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lodestar-')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/files/{tag}-{uuid.uuid4().hex}"
