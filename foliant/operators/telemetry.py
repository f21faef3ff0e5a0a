"""Telemetry of jobs and machines: rates, durations, steps, errors, health, the queue and its estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from foliant.operators.catalog import one_row, rate
from foliant.operators.quantiles import exact_quantiles

#: Error kinds in the order in which they are tried, with the words that tell them; fixed values.
ERROR_KINDS = (
    ("timeout", ("timeout",)),
    ("network", ("connection", "network")),
    ("memory", ("memory", "oom")),
    ("permission", ("permission", "access")),
)
PRIORITIES = ("urgent", "high", "normal", "low")
#: Bounds and parts of the estimated seconds of a job.
ESTIMATE_BASE, ESTIMATE_MB, ESTIMATE_UNKNOWN, ESTIMATE_LEAST, ESTIMATE_MOST, ESTIMATE_PAST = 120.0, 30.0, 60.0, 60.0, 1200.0, 0.3
#: First delay, most attempts, longest delay, factor of the retry presets; fixed values.
RETRY_PRESETS = (("fast", 1.0, 3, 30.0, 2.0), ("service", 2.0, 5, 60.0, 1.5), ("model", 5.0, 3, 120.0, 2.0))


def success_rates(jobs: DataFrame, as_of: Column) -> DataFrame:
    """One row: percent of successes over all, the last hour and the last day (started after the moment, strictly)."""
    after = lambda hours: F.col("created_at") > as_of - F.make_dt_interval(F.lit(0), F.lit(hours))
    ok = F.col("status") == "completed"
    done = jobs.where(F.col("status").isin("completed", "failed"))
    parts = []
    for name, inside in (("overall", F.lit(True)), ("hour", after(1)), ("day", after(24))):
        parts += [F.count_if(inside).alias(f"jobs_{name}"), F.round(rate(F.count_if(inside & ok), F.count_if(inside)), 6).alias(f"rate_{name}")]
    return done.agg(*parts)


def durations(jobs: DataFrame) -> DataFrame:
    """Mean and median (0 if none), least and greatest duration (null if none) of jobs that have one."""
    d = F.col("duration")
    plain = jobs.agg(F.count(d).alias("n"), F.round(F.coalesce(F.avg(d), F.lit(0.0)), 6).alias("mean"), F.round(F.min(d), 6).alias("fastest"), F.round(F.max(d), 6).alias("slowest"))
    middle = exact_quantiles(jobs, "duration", [0.5]).select(F.round("quantile", 6).alias("median"))
    return one_row(plain, middle).select("n", "mean", F.coalesce("median", F.lit(0.0)).alias("median"), "fastest", "slowest")


#: The step that a job is at before its first; it is never timed.
FIRST_STEP = "initializing"


def step_times(steps: DataFrame, by: str) -> DataFrame:
    """Seconds from each step to its job's next one; the last has none, nor has the one a job starts with."""
    w = Window.partitionBy(by).orderBy("created_at", "step_id")
    seconds = F.unix_micros(F.lead("created_at").over(w)) / 1e6 - F.unix_micros("created_at") / 1e6
    return steps.withColumn("seconds", seconds).withColumn("seconds", F.when(F.coalesce(F.col("step") != FIRST_STEP, F.lit(True)), F.col("seconds")))


def step_statistics(done: DataFrame, failed: DataFrame) -> DataFrame:
    """For each step with a duration: mean, least, greatest, successes, failures and percent of successes. done has (step, seconds), failed (step)."""
    a = done.where("seconds IS NOT NULL").groupBy("step").agg(F.round(F.avg("seconds"), 6).alias("avg_seconds"), F.round(F.min("seconds"), 6).alias("min_seconds"), F.round(F.max("seconds"), 6).alias("max_seconds"), F.count("*").alias("successes"))
    b = failed.groupBy("step").agg(F.count("*").alias("failures"))
    both = a.join(b, "step", "left").withColumn("failures", F.coalesce("failures", F.lit(0)).cast("long"))
    return both.withColumn("success_rate", F.round(rate(F.col("successes"), F.col("successes") + F.col("failures")), 6))


def error_kind(message: Column) -> Column:
    text = F.lower(message)
    kind = F.lit("other")
    for name, parts in reversed(ERROR_KINDS):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(text, F.lit(p))
        kind = F.when(hit, name).otherwise(kind)
    return F.when(message.isNotNull(), kind)


def error_statistics(errors: DataFrame) -> DataFrame:
    """Errors by kind, with their share of all errors; a missing message counts in the whole only."""
    counted = errors.groupBy(error_kind(F.col("error_message")).alias("kind")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6)).where("kind IS NOT NULL")


def resources(samples: DataFrame, as_of: Column) -> DataFrame:
    """Last, mean and peak values of the last hour's samples (ts, cpu, memory, disk); no row where there are none."""
    recent = samples.where(F.col("ts") > as_of - F.make_dt_interval(F.lit(0), F.lit(1)))
    last = lambda c: F.max_by(c, F.struct("ts", "sample_id")).alias(f"current_{c}")
    out = recent.agg(F.count("*").alias("samples"), last("cpu"), F.round(F.avg("cpu"), 6).alias("avg_cpu"), F.max("cpu").alias("peak_cpu"), last("memory"), F.round(F.avg("memory"), 6).alias("avg_memory"), F.max("memory").alias("peak_memory"), last("disk"))
    return out.where("samples > 0")


def health(samples: DataFrame) -> DataFrame:
    """(score, status) of the latest sample: the mean of what is free."""
    last = samples.agg(F.max_by(F.struct("cpu", "memory", "disk"), F.struct("ts", "sample_id")).alias("s"))
    free = lambda c: F.greatest(F.lit(0.0), 100.0 - F.col(f"s.{c}"))
    score = F.round((free("cpu") + free("memory") + free("disk")) / 3, 6)
    return last.select(score.alias("score")).withColumn("status", health_status(F.col("score")))


def health_status(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "warning").otherwise("critical")


def estimate(size_mb: Column, past: Column | None = None) -> Column:
    """Seconds a job of this size will need; an unknown or zero size counts as such."""
    known = F.coalesce(F.nullif(size_mb.cast("double"), F.lit(0.0)) * ESTIMATE_MB, F.lit(ESTIMATE_UNKNOWN))
    whole = ESTIMATE_BASE + known + (F.coalesce(past, F.lit(0.0)) * ESTIMATE_PAST if past is not None else 0.0)
    return F.least(F.lit(ESTIMATE_MOST), F.greatest(F.lit(ESTIMATE_LEAST), whole))


def priority_rank(priority: Column) -> Column:
    rank = F.lit(PRIORITIES.index("normal"))
    for i, name in enumerate(PRIORITIES):
        rank = F.when(priority == name, i).otherwise(rank)
    return rank


def _before(order: list[str], *within: str) -> WindowSpec:
    return Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def queue(jobs: DataFrame, as_of: Column, boost_after: int | None = None) -> DataFrame:
    """Waiting jobs (job_id, priority, created_at, size_mb) with place, wait, estimate and the seconds before their turn. With boost_after, jobs that waited longer move up by one priority.

    Jobs are numbered within their priority and second; what comes before a second is summed within its hour, and what
    comes before an hour over one row for each, so neither a day's nor a busy hour's jobs meet in one task.
    """
    waited = F.unix_timestamp(as_of) - F.unix_timestamp("created_at")
    rank = priority_rank(F.col("priority"))
    if boost_after is not None:
        rank = F.when(waited > boost_after, F.greatest(F.lit(0), rank - 1)).otherwise(rank)
    out = jobs.withColumn("rank", rank).withColumn("waited", waited).withColumn("estimate", estimate(F.col("size_mb")))
    out = out.withColumn("second_", F.coalesce(F.unix_timestamp("created_at"), F.lit(-1)))
    sums = [F.sum("n_").alias("n_"), F.sum("s_").alias("s_")]
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    seconds = out.groupBy("rank", F.floor(F.col("second_") / 3600).alias("hour_"), "second_").agg(F.count("*").alias("n_"), F.sum("estimate").alias("s_"))
    hours = seconds.groupBy("rank", "hour_").agg(*sums)
    over = _before(["rank", "hour_"])
    hours = hours.select("rank", "hour_", earlier("n_", over).alias("hours_n"), earlier("s_", over).alias("hours_s"))
    inside = _before(["second_"], "rank", "hour_")
    seconds = seconds.select("rank", "hour_", "second_", earlier("n_", inside).alias("n_"), earlier("s_", inside).alias("s_")).join(hours, ["rank", "hour_"])
    own = Window.partitionBy("rank", "second_").orderBy("created_at", "job_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = out.withColumn("position", F.row_number().over(Window.partitionBy("rank", "second_").orderBy("created_at", "job_id"))).withColumn("starts_after", F.sum("estimate").over(own) - F.col("estimate"))
    both = placed.join(seconds, ["rank", "second_"])
    both = both.withColumn("position", F.col("position") + F.col("n_") + F.col("hours_n")).withColumn("starts_after", F.col("starts_after") + F.col("s_") + F.col("hours_s"))
    return both.drop("second_", "hour_", "n_", "s_", "hours_n", "hours_s")


#: Seconds that a waiting job without an estimate counts for; waits and jobs that the status shows; fixed values.
UNKNOWN_ESTIMATE, RECENT_WAITS, SHOWN_JOBS = 180, 100, 10


def queue_status(waiting: DataFrame, waits: DataFrame, as_of: Column) -> DataFrame:
    """One row: the queue's size, the seconds it will take, the mean of the last waits (at, wait_id, seconds), and the first jobs in their order. waiting has (job_id, priority, created_at, estimate); no estimate, or one of 0, counts as a fixed one."""
    known = F.coalesce(F.nullif(F.col("estimate").cast("double"), F.lit(0.0)), F.lit(float(UNKNOWN_ESTIMATE)))
    size = waiting.agg(F.count("*").alias("queue_size"), F.coalesce(F.sum(known), F.lit(0.0)).alias("estimated_queue_time"))
    recent = last_rows(waits, RECENT_WAITS, F.desc("at"), F.desc("wait_id")).agg(F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("average_wait_time"))
    first = last_rows(waiting.withColumn("rank", priority_rank(F.col("priority"))), SHOWN_JOBS, "rank", "created_at", "job_id")
    item = F.struct("rank", "created_at", "job_id", "priority", (F.unix_timestamp(as_of) - F.unix_timestamp("created_at")).alias("queued_for"), "estimate")
    return one_row(size, recent, first.agg(F.array_sort(F.collect_list(item)).alias("queue_items")))


def last_rows(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows in an order, for sliding statistics over the latest ones."""
    return df.orderBy(*order).limit(n)


def backoff() -> Column:
    """Delay before each attempt: min(first * factor ** (attempt - 1), longest), over columns base, factor, attempt, longest."""
    return F.least(F.col("base") * F.pow("factor", F.col("attempt") - 1), F.col("longest"))


def success_band(done: Column, failed: Column) -> Column:
    share = F.try_divide(done * 100.0, done + failed)
    return F.when(share.isNull(), "none").when(share >= 90, "good").when(share >= 70, "fair").otherwise("poor")


def running_mean(mean: Column, n: Column, new: Column) -> Column:
    """A mean of n values, carried on by another one; a missing mean is none of 0."""
    return (F.coalesce(mean, F.lit(0.0)) * n + new) / (n + 1)


def queue_success(done: Column, failed: Column) -> Column:
    """Percent of processed jobs that succeeded, 0 of none."""
    return rate(done, done + failed)


def active(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Jobs that still run (job_id, step, created_at, status), longest running first, with the seconds since their start."""
    live = jobs.where(F.col("status") == "processing")
    return live.select("job_id", "step", "created_at", (F.unix_timestamp(as_of) - F.unix_timestamp("created_at")).alias("seconds")).orderBy("created_at", "job_id")
