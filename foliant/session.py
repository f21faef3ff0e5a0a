"""A session with the settings the library expects."""

from __future__ import annotations

import os
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution, skewed joins split. Everything else is the cluster's."""
    builder = SparkSession.builder.appName("foliant")
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=conf | settings).getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one the cluster shares (spark.checkpoint.dir). Where that is unset, a local master gets a local one; a cluster has no folder to fall back to."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "foliant-shared")
    return f"{base.rstrip('/')}/foliant-{spark.sparkContext.applicationId}/{name}-{uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to a scratch folder and read again, for what is used more than once and dear to compute."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
