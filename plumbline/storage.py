"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used where a session on one machine names no shared folder, as in tests.
LOCAL_SHARED = "/tmp/checkpoints/plumbline"


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, or what setCheckpointDir set; a cluster without either is refused."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_SHARED


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/plumbline-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage by writing the rows as Parquet and reading them back; a lost executor loses nothing of it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
