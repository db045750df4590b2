"""The folder that the driver and all executors see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DIR = "file:///tmp/driftloom-checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder that the session was given for checkpoints; a local one only where it has none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    spark.sparkContext.setCheckpointDir(LOCAL_DIR)
    return LOCAL_DIR


def stored(df: DataFrame, name: str, few: bool = False, path: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, read again; ``few`` rows are written by one wave of tasks."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(max(1, spark.sparkContext.defaultParallelism)) if few else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
