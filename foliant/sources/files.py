"""Files as rows: listings without contents, quarantine, page texts through a plugged-in reader, histories, samplers; exports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.catalog import one_row
from foliant.operators.duplicates import ENDS, first_pages_text

#: Megabytes that known models take; what others and the runtime take; fixed values. The first listed name that a model's
#: name contains counts, so the shorter names hide those that follow them, as stored estimates show.
MODEL_MB = {
    "llama3.2": 4000,
    "llama3.2:1b": 1500,
    "llama3.2:3b": 4000,
    "llava": 3000,
    "llava:7b": 5000,
    "llava:13b": 8000,
    "codellama": 4000,
    "mistral": 4000,
}
OTHER_MODEL_MB, RUNTIME_MB = 2000, 500


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, stem, size, modified) of a folder's files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).drop("content")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def archive_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Number and bytes of a folder's tar archives."""
    return listing(spark, folder, "*.tar*").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Held files, and whether a note (.json) of the same stem lies beside them."""
    every = listing(spark, folder)
    notes = every.where(F.col("name").endswith(".json")).select("stem", F.lit(True).alias("noted")).distinct()
    return every.where(~F.col("name").endswith(".json")).join(notes, "stem", "left").withColumn("noted", F.coalesce("noted", F.lit(False)))


def old_files(files: DataFrame, as_of: Column, days: int) -> DataFrame:
    return files.where(F.col("modified") < as_of - F.make_dt_interval(F.lit(days)))


def page_texts(files: DataFrame, reader: Callable[[bytes], list[str]], most_bytes: int = 100 * 1024 * 1024) -> DataFrame:
    """(path, page_number, text, error) of files (path, length, content): one row for each page the reader gives, or one with the error; a larger file isn't read and has the error `too_large`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                try:
                    out += [(path, i + 1, t.strip(), None) for i, t in enumerate(reader(content))]
                except Exception as e:  # noqa: BLE001  a file that can't be read is a row, not a failed job
                    out.append((path, None, None, str(e)))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["path", "page_number", "text", "error"])

    read = files.where(F.col("length") <= most_bytes).select("path", "content").mapInArrow(run, "path string, page_number int, text string, error string")
    large = files.where(F.col("length") > most_bytes).select("path", F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("string").alias("text"), F.lit("too_large").alias("error"))
    return read.unionByName(large)


def file_info(files: DataFrame, describe: Callable[[bytes], dict], most_bytes: int = 100 * 1024 * 1024) -> DataFrame:
    """(path, title, author, creator, page_count, text, error) of files (path, length, content): what a plugged-in reader says of each (title, author, creator, pages), the text of its first three pages stripped and cut."""
    kind = "path string, title string, author string, creator string, page_count int, pages array<string>, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("path", "title", "author", "creator", "page_count", "pages", "error")
        kinds = (*[pa.string()] * 4, pa.int32(), pa.list_(pa.string()), pa.string())
        for batch in batches:
            out = []
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                try:
                    said = describe(content)
                    out.append((path, *[said.get(n) for n in names[1:4]], len(said["pages"]), said["pages"][:3], None))
                except Exception as e:  # noqa: BLE001  a file that can't be read is a row, not a failed job
                    out.append((path, None, None, None, 0, [], str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    said = files.where(F.col("length") <= most_bytes).select("path", "content").mapInArrow(run, kind)
    large = files.where(F.col("length") > most_bytes).select("path", F.lit("too_large").alias("error"))
    return said.withColumn("text", first_pages_text(F.col("pages"))).drop("pages").unionByName(large, allowMissingColumns=True)


def size_marks(lines: Column, jump: float = 2.0) -> Column:
    """Text of an array of (size, text) lines, a line [FONT_SIZE:n] before those whose rounded size differs from the last mark's by more than the jump. Blank lines are left out."""
    start = F.struct(F.lit(None).cast("double").alias("mark"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        size = F.bround(x["size"])
        new = s["mark"].isNull() | (F.abs(size - s["mark"]) > jump)
        mark = F.when(new, F.concat(F.lit("\n[FONT_SIZE:"), size.cast("int").cast("string"), F.lit("]\n"))).otherwise("")
        return F.struct(F.when(new, size).otherwise(s["mark"]).alias("mark"), F.concat(s["out"], mark, F.btrim(x["text"], F.lit(ENDS)), F.lit("\n")).alias("out"))

    solid = F.filter(lines, lambda x: F.btrim(x["text"], F.lit(ENDS)) != "")
    return F.aggregate(solid, start, step, lambda s: F.btrim(s["out"], F.lit(ENDS)))


def page_blocks(pages: Column, most: int = 2) -> Column:
    """The first pages of an array of page texts, each after a line [PAGE n]; the first empty one ends them."""
    texts = F.transform(F.slice(pages, 1, most), lambda p: F.btrim(F.coalesce(p, F.lit("")), F.lit(ENDS)))
    empty = F.array_position(texts, F.lit(""))
    kept = F.when(empty > 0, F.slice(texts, F.lit(1), (empty - 1).cast("int"))).otherwise(texts)
    return F.btrim(F.array_join(F.transform(kept, lambda p, i: F.concat(F.lit("\n[PAGE "), (i + 1).cast("string"), F.lit("]\n"), p, F.lit("\n"))), ""), F.lit(ENDS))


def history(spark: SparkSession, path: str, schema: str, keep: int = 1000) -> DataFrame:
    """The newest entries of a JSON history."""
    return spark.read.schema(schema).json(path, multiLine=True).orderBy(F.desc("timestamp"), F.desc("backup_id")).limit(keep)


def gpu_samples(lines: Column) -> Column:
    """A sampler's `index, name, total, used, free, utilisation` line as a struct."""
    return F.from_csv(lines, "index int, name string, total_mb int, used_mb int, free_mb int, utilisation int", {"ignoreLeadingWhiteSpace": "true"})


def model_memory(name: Column) -> Column:
    """Megabytes of an active model, by the first known name that its name contains, capitals or not."""
    out = F.lit(OTHER_MODEL_MB)
    for known in reversed(MODEL_MB):
        out = F.when(F.contains(F.lower(name), F.lit(known)), MODEL_MB[known]).otherwise(out)
    return out


def memory_estimate(models: DataFrame) -> DataFrame:
    """Megabytes of all active models, with the runtime's if there is one."""
    return models.agg(F.coalesce(F.sum(model_memory(F.col("name"))), F.lit(0)).alias("mb"), F.count("*").alias("models")).withColumn("mb", F.col("mb") + F.when(F.col("models") > 0, RUNTIME_MB).otherwise(0))


def export_rows(jobs: DataFrame) -> DataFrame:
    """The eleven columns of the job export; lists joined by a bar, times as text."""
    bar = lambda c: F.array_join(c, "|")
    return jobs.select(
        "job_id", "filename", F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss").alias("start_time"), F.date_format("ended_at", "yyyy-MM-dd'T'HH:mm:ss").alias("end_time"), "duration", "success", "error_message",
        bar("steps_completed").alias("steps_completed"), bar("steps_failed").alias("steps_failed"), "file_size_mb", "page_count",
    )


def write_texts(df: DataFrame, key: str, text: str, folder: str) -> None:
    """Write each row's text into a file of its own, named by its key, in a folder that all executors share. A task that runs again writes its files again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_output_stream(f"{root}/{k}.txt") as out:
                    out.write((t or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    df.select(key, text).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def export_record(jobs: DataFrame, system: DataFrame, statistics: DataFrame, most: int = 1000) -> DataFrame:
    """One JSON document: the newest jobs (created_at, job_id, ...), the system's row and the statistics' row; times as text."""
    newest = jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(most)
    listed = newest.agg(F.sort_array(F.collect_list(F.struct("created_at", "job_id", *[c for c in jobs.columns if c not in ("created_at", "job_id")])), asc=False).alias("jobs"))
    one = lambda df, name: df.limit(1).agg(F.first(F.struct("*")).alias(name))
    rows = one_row(listed, one(system, "system"), one(statistics, "statistics"))
    return rows.select(F.to_json(F.struct("jobs", "system", "statistics")).alias("value"))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))
