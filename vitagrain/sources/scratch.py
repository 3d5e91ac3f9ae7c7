"""Intermediate tables that a job reads several times.

They lie in the shared folder of ``spark.checkpoint.dir``: every executor reads
them, a lost executor costs its own tasks only, and their size is known when the
next join is planned.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that all executors share; a local master without the setting gets its own."""
    base = spark.conf.get(FOLDER, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {FOLDER} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="vitagrain-")
    return f"{base.rstrip('/')}/vitagrain-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written once and read again, so that no later use repeats their work."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
