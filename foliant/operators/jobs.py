"""Records of jobs put together from their events: steps, progress, messages, and the stages of an ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators.telemetry import step_times

#: Steps of an ingest in order, and those without which it fails; fixed values.
STEPS = ("save_paper", "ocr", "ocr_quality", "embedding", "layout", "metadata", "hashes", "cleanup")
CRITICAL = ("save_paper", "ocr")


def step_lists(events: DataFrame) -> DataFrame:
    """(job_id, steps_completed, steps_failed, last_step, progress) from events (job_id, step, ok, error, at): arrays of records in order of time."""
    done = F.collect_list(F.when(F.col("ok"), F.struct("at", F.col("step").alias("name"))))
    failed = F.collect_list(F.when(~F.col("ok"), F.struct("at", F.col("step").alias("name"), "error")))
    found = events.groupBy("job_id").agg(F.array_sort(done).alias("steps_completed"), F.array_sort(failed).alias("steps_failed"), F.max_by("step", F.struct("at", "step")).alias("last_step"))
    reached = F.size(F.array_distinct(F.transform("steps_completed", lambda s: s["name"])))
    return found.withColumn("progress", F.least(F.lit(100), F.floor(reached * 100 / len(STEPS))).cast("int"))


def append_step(steps: Column, name: Column, at: Column) -> Column:
    """Another record at the end of a list of steps."""
    return F.array_append(F.coalesce(steps, F.array().cast("array<struct<at:timestamp,name:string>>")), F.struct(at.alias("at"), name.alias("name")))


def failure_message(step: Column, warnings: Column) -> Column:
    """The first warning that names the step, else that it failed."""
    named = F.get(F.filter(warnings, lambda w: F.contains(F.lower(w), F.lower(step))), F.lit(0))
    return F.coalesce(named, F.concat(step, F.lit(" failed")))


def summary_flag(summary: Column, name: str) -> Column:
    """A flag inside the data of a job's result summary, false where it isn't there."""
    return F.coalesce(F.get_json_object(summary, f"$.data.{name}").cast("boolean"), F.lit(False))


def succeeded(failed: Column) -> Column:
    """Whether no critical step is among the failed ones."""
    return ~F.arrays_overlap(F.coalesce(failed, F.array().cast("array<string>")), F.array(*[F.lit(s) for s in CRITICAL]))


def recognised_enough(done: Column, whole: Column, least: float = 0.7) -> Column:
    """Whether enough of a document's pages could be recognised."""
    return F.coalesce(F.try_divide(done * 1.0, whole), F.lit(0.0)) >= least


def quality_line(quality: Column, score: Column, confidence: Column) -> Column:
    """`good|score:70|confidence:80`."""
    return F.concat_ws("|", quality, F.concat(F.lit("score:"), score.cast("string")), F.concat(F.lit("confidence:"), confidence.cast("string")))


def quality_of_line(line: Column) -> Column:
    part = lambda name: F.regexp_extract(line, rf"{name}:(\d+)", 1)
    return F.struct(F.split_part(line, F.lit("|"), F.lit(1)).alias("quality"), F.nullif(part("score"), F.lit("")).cast("int").alias("score"), F.nullif(part("confidence"), F.lit("")).cast("int").alias("confidence"))


def admitted(queue: DataFrame, most: int = 100, running: int = 3) -> DataFrame:
    """Submissions (job_id, rank, submitted_at) in order: of equal ids the first counts, beyond the most waiting ones they are refused; the first by priority start."""
    seen = F.row_number().over(Window.partitionBy("job_id").orderBy("submitted_at", "rank"))
    single = queue.withColumn("seen", seen)
    fresh = single.where("seen = 1")
    waiting = fresh.orderBy("submitted_at", "job_id").limit(most).select("job_id", "rank", "submitted_at")
    first = waiting.orderBy("rank", "submitted_at", "job_id").limit(running).select("job_id", F.lit("running").alias("starts_"))
    held = waiting.join(F.broadcast(first), "job_id", "left").select("job_id", F.coalesce("starts_", F.lit("waiting")).alias("state"))
    decided = fresh.join(F.broadcast(held), "job_id", "left").withColumn("state", F.coalesce("state", F.lit("refused")))
    repeated = single.where("seen > 1").withColumn("state", F.lit("repeated"))
    return decided.unionByName(repeated).select("job_id", "rank", "submitted_at", "state")


def task_counts(pending: DataFrame, done: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(kind, pending, processed, failed) for each kind of task: pending has (doc_id, <kind>_pending), done (doc_id, kind, ok) what a run made of them."""
    tasks = pending.select("doc_id", F.explode(F.array(*[F.when(F.col(f"{k}_pending"), F.lit(k)) for k in kinds])).alias("kind")).where("kind IS NOT NULL")
    both = tasks.join(done.groupBy("doc_id", "kind").agg(F.bool_or("ok").alias("ok")), ["doc_id", "kind"], "left")
    return both.groupBy("kind").agg(F.count("*").alias("pending"), F.count_if("ok").alias("processed"), F.count_if(~F.col("ok")).alias("failed"))


def task_order(pending: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(doc_id, place, kind): all pending tasks of each paper, in the order in which one run does them."""
    return pending.select("doc_id", F.posexplode(F.filter(F.array(*[F.when(F.col(f"{k}_pending"), F.lit(k)) for k in kinds]), lambda k: k.isNotNull())).alias("place", "kind"))


def ingest(uploads: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Uploads run through the steps in order: arrays of done and failed steps, warnings, whether the ingest succeeded, its progress. A step's column is null where it succeeds and holds the error where it fails; after a failed critical step none follows."""
    names = [n for n in STEPS if n in steps]
    begun = F.lit(True)
    done, failed, warnings = [], [], []
    for n in names:
        done.append(F.when(begun & steps[n].isNull(), F.lit(n)))
        failed.append(F.when(begun & steps[n].isNotNull(), F.lit(n)))
        warnings.append(F.when(begun & steps[n].isNotNull(), F.concat(F.lit(n + ": "), steps[n])))
        if n in CRITICAL:
            begun = begun & steps[n].isNull()
    kept = lambda c: F.array_compact(F.array(*c))
    out = uploads.withColumns({"steps_completed": kept(done), "steps_failed": kept(failed), "warnings": kept(warnings)})
    return out.withColumn("success", succeeded(F.col("steps_failed"))).withColumn("progress", F.floor(F.size("steps_completed") * 100 / len(names)).cast("int"))


#: What is kept of a job's result, with the paths and types in it; the resources that a sample holds.
RESULT_FIELDS = {"page_count": ("$.data.page_count", "int"), "ocr_quality_score": ("$.data.ocr_quality_score", "double"), "embedding_dimension": ("$.data.embedding_dimension", "int")}
RESOURCES = ("memory_mb", "cpu_percent", "read_mb", "write_mb")


def metrics(jobs: DataFrame, steps: DataFrame, samples: DataFrame) -> DataFrame:
    """One record for each finished job: its duration, how it ended, its steps' seconds, what its result tells, and the resources at its end.

    jobs: (job_id, filename, size_mb, started_at, ended_at, ok, error, result), result in JSON; one that hasn't ended is
    left out. steps: (job_id, step_id, step, created_at); a step that comes again keeps its last time, and neither the
    first state nor the step a job ends in has one. samples: (job_id, sample_id, at, *RESOURCES); the last one up to a
    job's end holds its peaks, as stored records show. A failed job without a message has one that says so. Steps and
    samples are aggregated before they meet the jobs.
    """
    timed = step_times(steps, "job_id").where("seconds IS NOT NULL AND step IS NOT NULL")
    times = timed.groupBy("job_id", "step").agg(F.max_by("seconds", F.struct("created_at", "step_id")).alias("seconds"))
    times = times.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("step", "seconds"))).alias("step_durations"))
    done = jobs.where("ended_at IS NOT NULL")
    until = samples.join(done.select("job_id", "ended_at"), "job_id").where("at <= ended_at")
    peaks = until.groupBy("job_id").agg(F.max_by(F.struct(*RESOURCES), F.struct("at", "sample_id")).alias("peak"))
    names = lambda path: F.coalesce(F.from_json(F.get_json_object("result", path), "array<string>"), F.array().cast("array<string>"))
    kept = [F.get_json_object("result", path).try_cast(kind).alias(n) for n, (path, kind) in RESULT_FIELDS.items()]
    seconds = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1e6
    error = F.when(~F.col("ok"), F.coalesce(F.nullif("error", F.lit("")), F.lit("Unknown error")))
    own = done.select("job_id", "filename", "size_mb", "started_at", "ended_at", seconds.alias("duration"), F.col("ok").alias("success"), error.alias("error_message"), names("$.steps_completed").alias("steps_completed"), names("$.steps_failed").alias("steps_failed"), *kept)
    both = own.join(times, "job_id", "left").join(peaks, "job_id", "left")
    empty = F.create_map().cast("map<string,double>")
    return both.select(*own.columns, F.coalesce("step_durations", empty).alias("step_durations"), *[F.col(f"peak.{r}").alias(r) for r in RESOURCES])
