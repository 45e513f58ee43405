"""Intermediate results that survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """The rows from a checkpoint in the shared folder (spark.checkpoint.dir; on one machine a temporary folder where that is unset): later steps read them instead of
    computing them again, and see the same rows even if an executor is lost."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = f"file://{tempfile.mkdtemp(prefix='lodestar-')}"
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint()
