"""Backups as versions of tables: writing what changed, checking, restoring, expiring; their catalogue and the readiness score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import versions

#: Partitions of a backed-up table.
PARTS = 32
#: Manifest rows that are kept, hours after which the latest backup is late.
KEPT, LATE_HOURS = 1000, 26


def history(manifest: DataFrame, limit: int = KEPT) -> DataFrame:
    """The newest rows, newest first."""
    return manifest.orderBy(F.desc("timestamp"), F.desc("backup_id")).limit(limit)


def keep_history(entries: DataFrame, folder: str, limit: int = KEPT) -> int:
    """Add entries to a stored history, of which the newest rows stay, as the next version of a store; its number. A history that isn't there begins. Who reads meanwhile sees the list before or after."""
    spark = entries.sparkSession
    held = versions.read(spark, folder).unionByName(entries) if versions.latest(spark, folder) else entries
    return versions.commit(history(held, limit), folder, F.lit("history"))


def totals(manifest: DataFrame) -> DataFrame:
    """By type: completed and failed backups, bytes of the completed, the latest of them."""
    done = F.col("status") == "completed"
    latest = F.max_by(F.when(done, F.col("backup_id")), F.when(done, F.struct("timestamp", "backup_id")))
    return manifest.groupBy("type").agg(F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum(F.when(done, F.col("size_bytes"))), F.lit(0)).alias("bytes"), latest.alias("latest"))


def expires(manifest: DataFrame) -> Column:
    return F.col("timestamp") + F.make_dt_interval(F.col("retention_days"))


def expired(manifest: DataFrame, as_of: Column) -> DataFrame:
    return manifest.where(as_of > expires(manifest))


def health(manifest: DataFrame, as_of: Column) -> DataFrame:
    """Whether the latest completed backup is recent enough."""
    last = manifest.where("status = 'completed'").agg(F.max("timestamp").alias("latest"))
    hours = (F.unix_timestamp(as_of) - F.unix_timestamp("latest")) / 3600
    return last.withColumn("status", F.when(F.col("latest").isNull(), "none").when(hours <= LATE_HOURS, "healthy").otherwise("late"))


def readiness(manifest: DataFrame, as_of: Column, disk_gb: float, scripts: int, scheduler: bool) -> DataFrame:
    """Points for recent full backups, free disk, vector backups, recovery scripts and the scheduler."""
    done = F.col("status") == "completed"
    counts = manifest.agg(
        F.count_if(done & (F.col("type") == "full") & (F.col("timestamp") > as_of - F.make_dt_interval(F.lit(7)))).alias("recent"),
        F.count_if(done & (F.col("type") == "snapshot")).alias("vectors"),
    )
    steps = lambda c, many, few, high, low: F.when(c >= many, high).when(c >= few, low).otherwise(0)
    score = steps(F.col("recent"), 3, 1, 3, 1) + steps(F.lit(disk_gb), 10, 5, 2, 1) + steps(F.col("vectors"), 3, 1, 2, 1) + steps(F.lit(scripts), 2, 1, 2, 1) + (1 if scheduler else 0)
    return counts.withColumn("score", score).withColumn("level", F.when(F.col("score") >= 8, "excellent").when(F.col("score") >= 6, "good").when(F.col("score") >= 4, "fair").otherwise("poor"))


def _part(df: DataFrame) -> Column:
    """What deals a table's rows to partitions unless the caller says: a hash of its first column, so that a row that changes elsewhere stays where it is."""
    return F.pmod(F.xxhash64(F.col(f"`{df.columns[0]}`")), F.lit(PARTS))


def checksum(spark: SparkSession, folder: str, version: int) -> str:
    """The digest of a version: of its partitions' digests, which were taken from the source."""
    each = F.array_sort(F.collect_list(F.concat_ws(":", "part", "digest")))
    return versions.entries(spark, folder, version).agg(F.sha2(F.array_join(each, ","), 256)).first()[0]


def write_backup(df: DataFrame, folder: str, backup_id: str, kind: str = "full", part: Column | None = None) -> dict:
    """Back up a table into a store of versions and return its manifest entry. Whatever the kind, only partitions that the store doesn't hold yet are written, and those are read back against the source's digests."""
    version = versions.commit(df, folder, _part(df) if part is None else part, note=backup_id)
    spark = df.sparkSession
    held = versions.entries(spark, folder, version).agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count_if("written")).first()
    return {"backup_id": backup_id, "type": kind, "path": folder, "version": version, "rows": held[0], "written": held[1], "checksum": checksum(spark, folder, version), "status": "completed"}


def write_stores(stores: dict[str, DataFrame], folder: str, backup_id: str, kind: str = "full", parts: dict[str, Column] | None = None) -> list[dict]:
    """A version of each store, as one backup; an incremental one leaves the vectors out."""
    names = [n for n in stores if kind != "incremental" or n != "vectors"]
    return [write_backup(stores[n], f"{folder}/{n}", f"{backup_id}_{n}", kind, (parts or {}).get(n)) | {"store": n} for n in names]


def verify(spark: SparkSession, entry: dict) -> bool:
    """Whether a version still holds what its source held when it was written, and is the one that the entry means."""
    if checksum(spark, entry["path"], entry["version"]) != entry["checksum"]:
        return False
    return versions.verify(spark, entry["path"], entry["version"]).where("not sound").isEmpty()


def restore(spark: SparkSession, entry: dict, current: DataFrame | None = None, part: Column | None = None) -> DataFrame:
    """The rows of a version, once it is verified; the current table, if given, becomes a version first, and the older one the newest again."""
    if not verify(spark, entry):
        raise ValueError(f"backup {entry['backup_id']} is damaged")
    if current is not None:
        versions.restore(current, entry["path"], _part(current) if part is None else part, entry["version"])
    return versions.read(spark, entry["path"], entry["version"])
