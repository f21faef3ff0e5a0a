from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.lifecycle import histories
from foliant.plans.registry import query
from foliant.plans.security import LIMITS, OVERRIDES, controls_and_calls
from foliant.session import scratch, written
from foliant.sources import tables as src
from foliant.streaming import jobs, lifecycle


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY 1, 2")
def hourly_events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_once(jobs.window_counts(jobs.event_stream(spark, sf_dir)), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
SELECT s AS start, event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM (
  SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY 1, 2
""")
def sliding_kpis_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_once(jobs.window_counts(jobs.event_stream(spark, sf_dir), "1 hour", "30 minutes"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS step, count(*) AS steps FROM events GROUP BY 1")
def job_states_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_once(jobs.latest_states(jobs.event_stream(spark, sf_dir)), "complete")


def arriving(df: DataFrame, parts: int, order: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of the stream that `made` makes of df, which arrives in `parts` ranges of a column. The stream is run when a part has come, and goes on where it stopped; all tasks write a part's files, and a run takes all of them as one batch."""
    spark, folder, out = df.sparkSession, scratch(df.sparkSession, "arrivals"), scratch(df.sparkSession, "stream")
    least, greatest = df.agg(F.min(order), F.max(order)).first()
    step = ((greatest or 0) - (least or 0)) // parts + 1
    for i in range(parts):
        low = (least or 0) + i * step
        df.where((F.col(order) >= low) & (F.col(order) < low + step)).write.mode("append").parquet(folder)
        found = jobs.run_once(made(spark.readStream.schema(df.schema).parquet(folder)), "append", out)
    return found


@query("SELECT doc_id AS id, nullif(min(doc_id) OVER (PARTITION BY md5(text)), doc_id) AS duplicate_of FROM documents")
def first_copies_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that arrive in four parts, each pointing to the first of its content."""
    docs = written(src.papers(spark, sf_dir).select(F.col("doc_id").alias("id"), F.md5("ocr_text").alias("key"), F.col("created_at").alias("ts")), "papers")
    return arriving(docs, 4, "id", lambda arrived: lifecycle.first_copies(arrived.withWatermark("ts", "1 hour"), 10_000 * 86_400.0))


EXPIRY, DELAY = 7 * 86_400, 86_400

#: A job's events one by one; what an event finds, and what it leaves. Between them, and at the end, a job may be given up.
LIVES = """
WITH RECURSIVE e AS (
  SELECT event_id, user_id AS job_id, epoch_us(ts) / 1e6 AS t, CASE event_type WHEN 'signup' THEN 'upload' WHEN 'view' THEN 'start' WHEN 'click' THEN 'step' WHEN 'purchase' THEN 'complete' ELSE 'fail' END AS name,
    's' || ((props->>'k')::BIGINT % 4) AS what, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events
), f AS (
  SELECT job_id, 0::BIGINT AS r, NULL::BIGINT AS event_id, NULL::DOUBLE AS t, NULL::VARCHAR AS name, false AS gone, NULL::DOUBLE AS gone_at, NULL::VARCHAR AS gone_status, NULL::VARCHAR AS gone_step, 0::BIGINT AS gone_n, NULL::DOUBLE AS gone_longest, false AS legal,
    NULL::VARCHAR AS before, NULL::VARCHAR AS after, NULL::VARCHAR AS step, NULL::VARCHAR AS what, NULL::DOUBLE AS took, NULL::DOUBLE AS started, NULL::DOUBLE AS step_at, NULL::DOUBLE AS last, 0::BIGINT AS n, NULL::DOUBLE AS longest FROM (SELECT DISTINCT job_id FROM e)
  UNION ALL
  SELECT job_id, r, event_id, t, name, gone, last + {expiry}, status0, step0, n0, longest0, legal, before, CASE WHEN legal THEN target ELSE before END,
    CASE WHEN NOT legal THEN pstep WHEN name = 'start' THEN 'initializing' WHEN name = 'step' THEN what ELSE pstep END, what,
    CASE WHEN legal AND name = 'step' AND pstep <> 'initializing' THEN t - pstep_at END,
    CASE WHEN legal AND name = 'start' THEN t ELSE pstarted END, CASE WHEN legal AND name = 'step' THEN t ELSE pstep_at END, CASE WHEN legal THEN t ELSE plast END,
    pn + CASE WHEN legal AND name = 'step' AND pstep <> 'initializing' THEN 1 ELSE 0 END, greatest(plongest, CASE WHEN legal AND name = 'step' AND pstep <> 'initializing' THEN t - pstep_at END)
  FROM (SELECT *, CASE name WHEN 'upload' THEN before IS NULL WHEN 'start' THEN coalesce(before IN ('uploaded', 'queued'), false) WHEN 'step' THEN coalesce(before = 'processing', false) WHEN 'complete' THEN coalesce(before = 'processing', false) ELSE before IS NOT NULL END AS legal,
      CASE name WHEN 'upload' THEN 'uploaded' WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' ELSE 'processing' END AS target
    FROM (SELECT e.job_id, e.r, e.event_id, e.t, e.name, e.what, s.last, s.step AS step0, s.n AS n0, s.longest AS longest0, s.status AS status0, s.status IS NOT NULL AND e.t - s.last >= {expiry} AS gone,
        CASE WHEN e.t - s.last >= {expiry} THEN NULL ELSE s.status END AS before, CASE WHEN s.status IS NULL OR e.t - s.last >= {expiry} THEN NULL ELSE s.step END AS pstep,
        CASE WHEN s.status IS NULL OR e.t - s.last >= {expiry} THEN NULL ELSE s.started END AS pstarted, CASE WHEN s.status IS NULL OR e.t - s.last >= {expiry} THEN NULL ELSE s.step_at END AS pstep_at,
        CASE WHEN s.status IS NULL OR e.t - s.last >= {expiry} THEN NULL ELSE s.last END AS plast, CASE WHEN s.status IS NULL OR e.t - s.last >= {expiry} THEN 0 ELSE s.n END AS pn, CASE WHEN s.status IS NULL OR e.t - s.last >= {expiry} THEN NULL ELSE s.longest END AS plongest
      FROM (SELECT *, CASE WHEN after IN ('completed', 'failed') THEN NULL ELSE after END AS status FROM f) s JOIN e ON e.job_id = s.job_id AND e.r = s.r + 1))
), tail AS (SELECT * FROM f WHERE after IS NOT NULL AND after NOT IN ('completed', 'failed') QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY r DESC) = 1 AND r = (SELECT max(r) FROM e WHERE e.job_id = f.job_id))
SELECT job_id, event_id, round(t, 3) AS second, CASE WHEN legal THEN 'transition' ELSE 'illegal' END AS kind, before, after, CASE WHEN legal THEN step ELSE CASE WHEN name = 'step' THEN what ELSE '' END END AS step, round(took, 3) AS seconds, NULL::BIGINT AS steps, NULL::DOUBLE AS longest FROM f WHERE r > 0
UNION ALL SELECT job_id, event_id, round(t, 3), 'final', before, after, step, round(t - started, 3), n, round(longest, 3) FROM f WHERE legal AND after IN ('completed', 'failed')
UNION ALL SELECT job_id, NULL, round(gone_at, 3), 'expired', gone_status, NULL, gone_step, NULL, gone_n, round(gone_longest, 3) FROM f WHERE gone
UNION ALL SELECT job_id, NULL, round(last + {expiry}, 3), 'expired', after, NULL, step, NULL, n, round(longest, 3) FROM tail WHERE last + {expiry} < (SELECT max(t) FROM e) - {delay}
""".format(expiry=EXPIRY, delay=DELAY)


def job_events(events: DataFrame) -> DataFrame:
    """Events of users as events of jobs."""
    name = F.when(F.col("event_type") == "signup", "upload").when(F.col("event_type") == "view", "start").when(F.col("event_type") == "click", "step").when(F.col("event_type") == "purchase", "complete").otherwise("fail")
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(F.col("user_id").alias("job_id"), "event_id", "ts", name.alias("event"), F.when(F.col("event_type") == "click", F.concat(F.lit("s"), (k % 4).cast("string"))).otherwise(F.lit("")).alias("step"))


def rounded(lives: DataFrame) -> DataFrame:
    return lives.select("job_id", "event_id", F.round("second", 3).alias("second"), "kind", "before", "after", "step", F.round("seconds", 3).alias("seconds"), "steps", F.round("longest", 3).alias("longest"))


@query(LIVES)
def job_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = job_events(src.events(spark, sf_dir)).withColumnRenamed("ts", "at")
    until = e.agg(F.unix_micros(F.max("at")) / 1e6).first()[0]
    return rounded(histories(e, EXPIRY, until - DELAY)) if until else rounded(histories(e, EXPIRY))


@query(LIVES)
def job_lives_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from events that arrive in four parts, before three of which the state was saved and is read again."""
    raw = src.table(spark, sf_dir, "events").withColumn("day_", F.unix_date(F.col("ts").cast("date")))
    timed = lambda arrived: arrived.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{DELAY} seconds")
    return rounded(arriving(raw, 4, "day_", lambda arrived: lifecycle.job_lives(job_events(timed(arrived)), EXPIRY)))


@query(LIMITS)
def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads = jobs.event_stream(spark, sf_dir).select("event_id", F.col("user_id").alias("client"), "ts")
    return jobs.run_once(jobs.upload_decisions(uploads, 1, 2), "append")


@query(OVERRIDES)
def breaker_override_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and manual controls as two streams into the same breakers."""
    calls, controls = controls_and_calls(jobs.event_stream(spark, sf_dir))
    return jobs.run_once(jobs.breaker_states(calls, 3, 36_000, 2, controls), "append")
