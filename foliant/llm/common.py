"""What the operators of this subpackage share: tables, the shared folder, written intermediate tables, Arrow limits."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of that name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table carries; a missing one is an error Spark reports."""
    return df.select(*[named(n) for n in names])


def run_folder(spark: SparkSession) -> str:
    """This application's folder in the one the cluster shares (spark.checkpoint.dir). Where that is unset, a local master, as in tests, gets a local one; a cluster has no folder to fall back to."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "foliant-shared")
    return f"{base.rstrip('/')}/foliant-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder in this application's."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def clear(spark: SparkSession) -> None:
    """Delete all that this application's operators have written. Results that weren't read yet can't be after that."""
    system, root = pyarrow.fs.FileSystem.from_uri(run_folder(spark))
    if system.get_file_info(root).type == pyarrow.fs.FileType.Directory:
        system.delete_dir(root)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage is cut and a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Texts may be long: read few rows at a time and hand Python few, so a batch stays within tens of megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))


def partitions_of(df: DataFrame) -> int:
    """How many shuffle partitions the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
