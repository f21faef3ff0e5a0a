"""Tables in versions: content-addressed partitions under manifests.

A store is a folder. `data` holds partitions, each in a folder named by its value and by the digest of its rows; nothing
there is ever overwritten. A version is a manifest, which lists a digest for each partition. A commit takes the digests
from the source, writes only the partitions that no version holds yet, reads those back and compares, and then writes
the manifest as one file, which makes the version exist; two writers of one number can't both succeed. So a version
costs what changed, a restore writes a manifest only, and what a writer that died has left behind is in no version.

A partition's digest is its number of rows and two sums of row hashes, so it doesn't depend on the order of rows.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "part string, digest string, rows long, written boolean, note string, fields string, v int"
#: Where rows without a partition value go.
NOWHERE = "none"


class Conflict(RuntimeError):
    """Another writer has committed this version."""


def digest() -> Column:
    """An aggregate: rows, and two sums of the hashes of what the column `row_` holds."""
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "row_").cast("decimal(38,0)")).cast("string")
    return F.concat_ws("_", F.count("*").cast("string"), total(1), total(2))


def _named(df: DataFrame, part: Column) -> DataFrame:
    """df's rows as row_, with their partition."""
    return df.select(F.coalesce(part.cast("string"), F.lit(NOWHERE)).alias("part"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row_"))


def _hashable(df: DataFrame) -> DataFrame:
    """Maps have no order, so they are hashed as sorted entries."""
    for f in df.schema.fields:
        if f.dataType.typeName() == "map":
            df = df.withColumn(f.name, F.array_sort(F.map_entries(F.col(f"`{f.name}`"))))
    return df


def digests(df: DataFrame, part: Column) -> DataFrame:
    """(part, digest, rows) of a table's partitions."""
    return _named(_hashable(df), part).groupBy("part").agg(digest().alias("digest"), F.count("*").alias("rows"))


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """All versions' entries (part, digest, rows, written, note, fields, v)."""
    try:
        return spark.read.schema(MANIFEST).json(f"{folder}/manifests")
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def latest(spark: SparkSession, folder: str) -> int:
    """The newest version's number, 0 if there is none."""
    return manifests(spark, folder).agg(F.max("v")).first()[0] or 0


def entries(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(part, digest, rows, written) of one version, the newest unless it is given."""
    v = latest(spark, folder) if version is None else version
    return manifests(spark, folder).where((F.col("v") == v) & F.col("part").isNotNull()).select("part", "digest", "rows", "written")


def _stored(spark: SparkSession, folder: str, fields: str, damaged: bool = False) -> DataFrame:
    """All partitions that any commit has written; with damaged, what can still be read of them."""
    read = spark.read.schema(StructType.fromJson(json.loads(fields)).add("part", "string").add("digest", "string"))
    if damaged:
        read = read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    return read.parquet(f"{folder}/data")


def _fields(spark: SparkSession, folder: str, version: int) -> str:
    found = manifests(spark, folder).where(F.col("v") == version).select("fields").first()
    if found is None:
        raise ValueError(f"no version {version}")
    return found["fields"]


def read(spark: SparkSession, folder: str, version: int | None = None, parts: list[str] | None = None) -> DataFrame:
    """A version's rows; of the given partitions only if there are such, and then no other is read."""
    v = latest(spark, folder) if version is None else version
    held = entries(spark, folder, v).select("part", "digest")
    rows = _stored(spark, folder, _fields(spark, folder, v))
    if parts is not None:
        rows, held = rows.where(F.col("part").isin(parts)), held.where(F.col("part").isin(parts))
    return rows.join(F.broadcast(held), ["part", "digest"], "left_semi").drop("part", "digest")


def verify(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(part, rows, sound): whether each partition of a version still holds what its source held."""
    v = latest(spark, folder) if version is None else version
    held = entries(spark, folder, v).select("part", "digest", "rows")
    rows = _stored(spark, folder, _fields(spark, folder, v), damaged=True).join(F.broadcast(held.select("part", F.col("digest").alias("wanted"))), "part").where("digest = wanted")
    found = digests_of_stored(rows)
    return held.join(found, "part", "left").select("part", "rows", F.coalesce(F.col("found") == F.col("digest"), F.lit(False)).alias("sound"))


def digests_of_stored(rows: DataFrame) -> DataFrame:
    own = [c for c in rows.columns if c not in ("part", "digest", "wanted")]
    hashed = _hashable(rows.select("part", *[F.col(f"`{c}`") for c in own])).select("part", F.struct(*[F.col(f"`{c}`") for c in own]).alias("row_"))
    return hashed.groupBy("part").agg(digest().alias("found"))


def commit(df: DataFrame, folder: str, part: Column, only: list[str] | None = None, note: str = "", base: int | None = None) -> int:
    """Make df the next version and return its number. With only, df is what these partitions hold from now on, and the others stay as the base version has them."""
    spark = df.sparkSession
    own = {"part", "digest"} & set(df.columns)
    if own:
        raise ValueError(f"columns {sorted(own)} are the store's own")
    last = latest(spark, folder) if base is None else base
    made = digests(df, part).persist()
    try:
        known = manifests(spark, folder).select("part", "digest").where("part is not null").distinct()
        fresh = made.join(known, ["part", "digest"], "left_anti").select("part", "digest")
        fresh_parts = [(r["part"], r["digest"]) for r in fresh.collect()]
        fields = df.schema.json()
        if fresh_parts:
            names = spark.createDataFrame(fresh_parts, "part string, digest string")
            rows = df.withColumn("part", F.coalesce(part.cast("string"), F.lit(NOWHERE))).join(F.broadcast(names), "part")
            rows.write.mode("append").partitionBy("part", "digest").parquet(f"{folder}/data")
            _check(spark, folder, fields, names)
        new = made.join(spark.createDataFrame(fresh_parts, "part string, digest string").withColumn("written", F.lit(True)), ["part", "digest"], "left").select("part", "digest", "rows", F.coalesce("written", F.lit(False)).alias("written"))
        if only is not None and last:
            new = new.unionByName(entries(spark, folder, last).where(~F.col("part").isin(only)).withColumn("written", F.lit(False)))
        return _publish(new, folder, last + 1, note, fields)
    finally:
        made.unpersist()


def _check(spark: SparkSession, folder: str, fields: str, names: DataFrame) -> None:
    """Read back what was just written and compare it with the source's digests."""
    wanted = F.broadcast(names.withColumnRenamed("digest", "wanted"))
    found = digests_of_stored(_stored(spark, folder, fields).join(wanted, "part").where("digest = wanted"))
    bad = names.join(found, "part", "left").where(~F.col("found").eqNullSafe(F.col("digest"))).select("part").limit(5).collect()
    if bad:
        raise OSError(f"written partitions differ from their source: {[r['part'] for r in bad]}")


def _publish(new: DataFrame, folder: str, version: int, note: str, fields: str) -> int:
    """Write the manifest of a version, as one file. An empty table's has one entry without a partition."""
    spark = new.sparkSession
    said = spark.range(1).select(F.lit(note).alias("note"), F.lit(fields).alias("fields"))
    rows = new.withColumn("note", F.lit(note)).withColumn("fields", F.lit(fields))
    none = said.select(F.lit(None).cast("string").alias("part"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("rows"), F.lit(False).alias("written"), "note", "fields")
    try:
        rows.unionByName(none).coalesce(1).write.mode("errorifexists").json(f"{folder}/manifests/v={version}")
    except AnalysisException as there:
        if there.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise Conflict(f"version {version} is already there") from there
    return version


def restore(current: DataFrame, folder: str, part: Column, version: int) -> tuple[int, int]:
    """Keep the current table as a version, then make an older one the newest again; both numbers. A damaged version isn't restored."""
    spark = current.sparkSession
    bad = verify(spark, folder, version).where("not sound").limit(1).collect()
    if bad:
        raise ValueError(f"version {version} is damaged in partition {bad[0]['part']}")
    safety = commit(current, folder, part, note=f"before the restore of version {version}")
    old = entries(spark, folder, version).withColumn("written", F.lit(False))
    return safety, _publish(old, folder, safety + 1, f"restored from version {version}", _fields(spark, folder, version))


def merge(changes: DataFrame, folder: str, key: str, part: Column, gone: DataFrame | None = None, where: DataFrame | None = None) -> int:
    """Commit a version in which changes replace the rows of their keys and the keys of gone are deleted. Only partitions that such keys are in, or come to, are read and written.

    Where a key's partition may change, where (key, part) says which partition each key is in now; else it is that of
    the change itself.
    """
    spark = changes.sparkSession
    to = changes.select(F.coalesce(part.cast("string"), F.lit(NOWHERE)).alias("part"))
    keys = changes.select(key)
    if gone is not None:
        keys = keys.unionByName(gone.select(key))
    keys = keys.distinct()
    if where is not None:
        to = to.union(where.join(keys, key, "left_semi").select("part"))
    elif gone is not None:
        to = to.union(gone.select(F.coalesce(part.cast("string"), F.lit(NOWHERE)).alias("part")))
    touched = [r["part"] for r in to.distinct().collect()]
    base = latest(spark, folder)
    kept = read(spark, folder, base, touched).join(keys, key, "left_anti")
    return commit(kept.unionByName(changes), folder, part, only=touched, base=base)


def history(spark: SparkSession, folder: str) -> DataFrame:
    """(v, note, partitions, rows, written): what each version holds, and how many partitions it had to write."""
    own = F.col("part").isNotNull()
    return manifests(spark, folder).groupBy("v").agg(F.first("note").alias("note"), F.count_if(own).alias("partitions"), F.sum("rows").alias("rows"), F.count_if(own & F.col("written")).alias("written"))


def unreferenced(spark: SparkSession, folder: str, keep: list[int]) -> DataFrame:
    """(part, digest) that would be free to delete if only these versions were kept."""
    every = manifests(spark, folder).where("part is not null")
    kept = every.where(F.col("v").isin(keep)).select("part", "digest")
    return every.select("part", "digest").distinct().join(kept, ["part", "digest"], "left_anti")
