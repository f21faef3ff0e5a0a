from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import telemetry as op
from foliant.operators.quantiles import exact_quantiles
from foliant.plans.registry import query
from foliant.sources import tables as src


def as_of() -> Column:
    return F.lit("2024-01-30 12:00:00").cast("timestamp")


NOW = "TIMESTAMP '2024-01-30 12:00:00'"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of a machine's load."""
    e = src.events(spark, sf_dir)
    return e.select(F.col("event_id").alias("sample_id"), "ts", F.least(F.lit(100.0), F.col("value")).alias("cpu"), F.col("k").cast("double").alias("memory"), (F.col("user_id") % 101).cast("double").alias("disk"))


SAMPLES = "(SELECT event_id AS sample_id, ts, least(100.0::DOUBLE, value) AS cpu, (props->>'k')::DOUBLE AS memory, (user_id % 101)::DOUBLE AS disk FROM events)"


@query(f"""
SELECT count(*) AS jobs_overall, round(count(*) FILTER (event_type <> 'error') * 100.0 / count(*), 6) AS rate_overall,
  count(*) FILTER (ts > {NOW} - INTERVAL 1 HOUR) AS jobs_hour, round(coalesce(count(*) FILTER (event_type <> 'error' AND ts > {NOW} - INTERVAL 1 HOUR) * 100.0 / nullif(count(*) FILTER (ts > {NOW} - INTERVAL 1 HOUR), 0), 0), 6) AS rate_hour,
  count(*) FILTER (ts > {NOW} - INTERVAL 24 HOUR) AS jobs_day, round(coalesce(count(*) FILTER (event_type <> 'error' AND ts > {NOW} - INTERVAL 24 HOUR) * 100.0 / nullif(count(*) FILTER (ts > {NOW} - INTERVAL 24 HOUR), 0), 0), 6) AS rate_day
FROM events WHERE event_type <> 'view'
""")
def success_rates_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.success_rates(src.jobs(spark, sf_dir), as_of())


@query("SELECT count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(min(value), 6) AS fastest, round(max(value), 6) AS slowest FROM events WHERE event_type <> 'error'")
def duration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.durations(src.jobs(spark, sf_dir).where("status <> 'failed'"))


@query("SELECT count(value) AS n, event_type AS step, s AS share, round(quantile_cont(value, s), 6) AS quantile FROM events, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE)) q(s) GROUP BY event_type, s".replace("quantile_cont(value, s)", "CASE s WHEN 0.25 THEN quantile_cont(value, 0.25) WHEN 0.5 THEN quantile_cont(value, 0.5) WHEN 0.9 THEN quantile_cont(value, 0.9) ELSE max(value) END"))
def duration_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quartiles and such of the durations of each step."""
    return exact_quantiles(src.events(spark, sf_dir).withColumnRenamed("event_type", "step"), "value", [0.25, 0.5, 0.9, 1.0], "step").withColumn("quantile", F.round("quantile", 6))


@query("""
SELECT event_id AS step_id, user_id AS job_id, CASE event_type WHEN 'signup' THEN 'initializing' ELSE event_type END AS step,
  CASE WHEN event_type <> 'signup' THEN round(epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 - epoch_us(ts) / 1e6, 4) END AS seconds FROM events
""")
def step_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.when(F.col("step") == "signup", op.FIRST_STEP).otherwise(F.col("step"))
    steps = src.jobs(spark, sf_dir).select(F.col("job_id").alias("step_id"), F.col("owner").alias("job_id"), step.alias("step"), "created_at")
    return op.step_times(steps, "job_id").select("step_id", "job_id", "step", F.round("seconds", 4).alias("seconds"))


@query("""
WITH f AS (SELECT CASE WHEN (props->>'k')::BIGINT % 3 = 0 THEN 'click' ELSE 'view' END AS step, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT event_type AS step, round(avg(value), 6) AS avg_seconds, round(min(value), 6) AS min_seconds, round(max(value), 6) AS max_seconds, count(*) AS successes, coalesce(any_value(failures), 0) AS failures,
  round(count(*) * 100.0 / (count(*) + coalesce(any_value(failures), 0)), 6) AS success_rate
FROM events LEFT JOIN f ON f.step = event_type WHERE event_type <> 'error' GROUP BY event_type
""")
def step_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.events(spark, sf_dir)
    failed = e.where("event_type = 'error'").select(F.when(F.col("k") % 3 == 0, "click").otherwise("view").alias("step"))
    return op.step_statistics(e.where("event_type <> 'error'").select(F.col("event_type").alias("step"), F.col("value").alias("seconds")), failed)


MESSAGE = """CASE (props->>'k')::BIGINT % 6 WHEN 0 THEN 'Connection TIMEOUT' WHEN 1 THEN 'Network down' WHEN 2 THEN 'OOM killed' WHEN 3 THEN 'Access denied' WHEN 4 THEN 'boom' END"""


@query(f"""
SELECT kind, n, round(n * 100.0 / (SELECT count(*) FROM events WHERE event_type = 'error'), 6) AS share FROM (
  SELECT CASE WHEN contains(m, 'timeout') THEN 'timeout' WHEN contains(m, 'connection') OR contains(m, 'network') THEN 'network' WHEN contains(m, 'memory') OR contains(m, 'oom') THEN 'memory'
    WHEN contains(m, 'permission') OR contains(m, 'access') THEN 'permission' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT lower({MESSAGE}) AS m FROM events WHERE event_type = 'error') WHERE m IS NOT NULL GROUP BY 1)
""")
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, message = F.col("k") % 6, F.lit(None).cast("string")
    for i, text in enumerate(("Connection TIMEOUT", "Network down", "OOM killed", "Access denied", "boom")):
        message = F.when(r == i, text).otherwise(message)
    return op.error_statistics(src.events(spark, sf_dir).where("event_type = 'error'").select(message.alias("error_message")))


@query(f"""
SELECT count(*) AS samples, arg_max(cpu, (ts, sample_id)) AS current_cpu, round(avg(cpu), 6) AS avg_cpu, max(cpu) AS peak_cpu, arg_max(memory, (ts, sample_id)) AS current_memory, round(avg(memory), 6) AS avg_memory, max(memory) AS peak_memory, arg_max(disk, (ts, sample_id)) AS current_disk
FROM {SAMPLES} WHERE ts > {NOW} - INTERVAL 1 HOUR HAVING count(*) > 0
""")
def resource_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.resources(samples(spark, sf_dir), as_of())


@query(f"""
SELECT score, CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'warning' ELSE 'critical' END AS status
FROM (SELECT round((greatest(0, 100 - cpu) + greatest(0, 100 - memory) + greatest(0, 100 - disk)) / 3, 6) AS score FROM {SAMPLES} ORDER BY ts DESC, sample_id DESC LIMIT 1)
""")
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.health(samples(spark, sf_dir))


QUEUE = """SELECT event_id AS job_id, ts, (props->>'k')::BIGINT AS k, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 3 ELSE 2 END AS rank FROM events"""


def waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.events(spark, sf_dir)
    priority = F.when(F.col("event_type") == "error", "urgent").when(F.col("event_type") == "purchase", "high").when(F.col("event_type") == "signup", "low").otherwise("normal")
    return e.select(F.col("event_id").alias("job_id"), priority.alias("priority"), F.col("ts").alias("created_at"), F.col("k").alias("size_mb"))


@query(f"SELECT job_id, rank, row_number() OVER (ORDER BY rank, ts, job_id) AS position FROM ({QUEUE})")
def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.queue(waiting(spark, sf_dir), as_of()).select("job_id", "rank", "position")


@query(f"""
SELECT job_id, least(1200.0::DOUBLE, greatest(60.0::DOUBLE, 120 + coalesce(nullif(k, 0) * 30.0::DOUBLE, 60))) AS estimate,
  sum(least(1200.0::DOUBLE, greatest(60.0::DOUBLE, 120 + coalesce(nullif(k, 0) * 30.0::DOUBLE, 60)))) OVER (ORDER BY rank, ts, job_id ROWS UNBOUNDED PRECEDING) - least(1200.0::DOUBLE, greatest(60.0::DOUBLE, 120 + coalesce(nullif(k, 0) * 30.0::DOUBLE, 60))) AS starts_after
FROM ({QUEUE})
""")
def queue_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.queue(waiting(spark, sf_dir), as_of()).select("job_id", "estimate", "starts_after")


@query(f"""
WITH q AS (SELECT job_id, ts, rank, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 0 ELSE k * 1.5::DOUBLE END AS estimate FROM ({QUEUE}))
SELECT (SELECT count(*) FROM q) AS queue_size, (SELECT sum(CASE WHEN coalesce(estimate, 0) = 0 THEN 180 ELSE estimate END) FROM q)::DOUBLE AS estimated_queue_time,
  (SELECT round(avg(value), 6) FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100)) AS average_wait_time,
  (SELECT string_agg(job_id || ':' || (floor(epoch({NOW})) - floor(epoch(ts)))::BIGINT, ',' ORDER BY rank, ts, job_id) FROM (SELECT * FROM q ORDER BY rank, ts, job_id LIMIT 10)) AS first_jobs
""")
def queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("size_mb")
    jobs = waiting(spark, sf_dir).withColumn("estimate", F.when(k % 4 == 0, None).when(k % 4 == 1, 0.0).otherwise(k * 1.5))
    waits = src.events(spark, sf_dir).select(F.col("ts").alias("at"), F.col("event_id").alias("wait_id"), F.col("value").alias("seconds"))
    row = op.queue_status(jobs, waits, as_of())
    first = F.array_join(F.transform("queue_items", lambda i: F.concat_ws(":", i["job_id"].cast("string"), i["queued_for"].cast("string"))), ",")
    return row.select("queue_size", "estimated_queue_time", F.round("average_wait_time", 6).alias("average_wait_time"), first.alias("first_jobs"))


@query("SELECT round(avg(value), 6) AS avg_wait, count(*) AS n FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100)")
def recent_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.last_rows(src.events(spark, sf_dir), 100, F.desc("ts"), F.desc("event_id")).agg(F.round(F.avg("value"), 6).alias("avg_wait"), F.count("*").alias("n"))


@query("""
WITH p(preset, base, attempts, longest, factor) AS (VALUES ('fast', 1.0::DOUBLE, 3, 30.0::DOUBLE, 2.0::DOUBLE), ('service', 2.0::DOUBLE, 5, 60.0::DOUBLE, 1.5::DOUBLE), ('model', 5.0::DOUBLE, 3, 120.0::DOUBLE, 2.0::DOUBLE)),
c AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'model' WHEN 'click' THEN 'fast' ELSE 'service' END AS preset, (props->>'k')::BIGINT % 7 AS failures FROM events)
SELECT event_id, preset, least(failures, attempts)::INTEGER AS waits, round(coalesce(list_sum(list_transform(range(0, least(failures, attempts)), lambda i: least(base * factor ** i, longest))), 0), 6)::DOUBLE AS waited FROM c JOIN p USING (preset)
""")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often and how long each call waits that fails so many times before its preset's attempts are over."""
    presets = spark.createDataFrame(list(op.RETRY_PRESETS), "preset string, base double, attempts int, longest double, factor double")
    kind = F.when(F.col("event_type") == "error", "model").when(F.col("event_type") == "click", "fast").otherwise("service")
    calls = src.events(spark, sf_dir).select("event_id", kind.alias("preset"), (F.col("k") % 7).cast("int").alias("failures")).join(F.broadcast(presets), "preset")
    tried = F.least("failures", "attempts")
    each = calls.select("event_id", "preset", tried.alias("waits"), "base", "factor", "longest", F.explode_outer(F.when(tried > 0, F.sequence(F.lit(1), tried))).alias("attempt"))
    return each.groupBy("event_id", "preset", "waits").agg(F.round(F.coalesce(F.sum(F.when(F.col("attempt").isNotNull(), op.backoff())), F.lit(0.0)), 6).alias("waited"))


@query("""
SELECT user_id, done, failed, CASE WHEN done + failed = 0 THEN 'none' WHEN done * 100.0 / (done + failed) >= 90 THEN 'good' WHEN done * 100.0 / (done + failed) >= 70 THEN 'fair' ELSE 'poor' END AS band
FROM (SELECT user_id, count(*) FILTER (event_type NOT IN ('error', 'view')) AS done, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1)
""")
def success_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = src.jobs(spark, sf_dir).groupBy(F.col("owner").alias("user_id")).agg(F.count_if(F.col("status") == "completed").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"))
    return by.withColumn("band", op.success_band(F.col("done"), F.col("failed")))


@query("SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS step, max(ts) AS at FROM events GROUP BY 1")
def latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.events(spark, sf_dir)
    return e.groupBy(F.col("user_id").alias("job_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("step"), F.max("ts").cast("timestamp_ntz").alias("at"))
