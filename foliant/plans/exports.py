from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import extract
from foliant.operators import uploads
from foliant.plans.registry import query
from foliant.sources import files, scorers
from foliant.sources import tables as src


@query("""
SELECT event_id AS job_id, event_type || '.pdf' AS filename, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS start_time, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') AS end_time, value AS duration, event_type <> 'error' AS success,
  CASE WHEN event_type = 'error' THEN 'boom' END AS error_message, 'upload|' || event_type AS steps_completed, CASE WHEN event_type = 'error' THEN 'ocr' ELSE '' END AS steps_failed, (props->>'k')::BIGINT AS file_size_mb, user_id AS page_count FROM events
""")
def export_jobs_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.events(spark, sf_dir)
    failed = F.col("event_type") == "error"
    none = F.array().cast("array<string>")
    jobs = e.select(
        F.col("event_id").alias("job_id"), F.concat("event_type", F.lit(".pdf")).alias("filename"), F.col("ts").alias("started_at"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ended_at"), F.col("value").alias("duration"), (~failed).alias("success"),
        F.when(failed, "boom").alias("error_message"), F.array(F.lit("upload"), F.col("event_type")).alias("steps_completed"), F.when(failed, F.array(F.lit("ocr"))).otherwise(none).alias("steps_failed"), F.col("k").alias("file_size_mb"), F.col("user_id").alias("page_count"),
    )
    return files.export_rows(jobs)


def said_of(texts: list[str]) -> list[str | None]:
    """What a model might answer, so that the query has answers to read: it depends on the length only."""
    return [f'Sure: {{"overall_quality": "{"good" if len(t) > 200 else "poor"}", "readability_score": {min(100, len(t) // 10)}}}' for t in texts]


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN 'good' ELSE 'poor' END AS quality, least(100, length(text) // 10)::DOUBLE AS score FROM documents")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = scorers.answered(src.table(spark, sf_dir, "documents"), "doc_id", "text", said_of)
    r = extract.quality_record(F.col("answer"))
    return said.select("doc_id", r["overall_quality"].alias("quality"), r["readability_score"].alias("score"))


@query("SELECT sum(CASE event_type WHEN 'click' THEN 4000 WHEN 'error' THEN 4000 WHEN 'view' THEN 3000 WHEN 'signup' THEN 2000 ELSE 4000 END)::BIGINT + 500 AS mb, count(*) AS models FROM events")
def model_memory_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_type") == "click", "llama3.2:1b").when(F.col("event_type") == "error", "my-CodeLlama:7b").when(F.col("event_type") == "view", "llava:13b").when(F.col("event_type") == "signup", "gemma:2b").otherwise("mistral:latest")
    return files.memory_estimate(src.events(spark, sf_dir).select(name.alias("name")))


@query("SELECT event_id, 24000 - (props->>'k')::INTEGER AS free_mb, (props->>'k')::INTEGER AS used_mb FROM events")
def gpu_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.events(spark, sf_dir)
    line = F.concat_ws(", ", F.lit("0"), F.lit("Card"), F.lit("24000"), F.col("k").cast("string"), (24000 - F.col("k")).cast("string"), F.lit("7"))
    s = files.gpu_samples(line)
    return e.select("event_id", s["free_mb"].alias("free_mb"), s["used_mb"].alias("used_mb"))


@query("""
SELECT task, attempt, CASE WHEN ok THEN 'done' WHEN fatal THEN 'fatal' ELSE 'exhausted' END AS outcome FROM (
  SELECT *, row_number() OVER (PARTITION BY task ORDER BY attempt) AS rn FROM (
    SELECT user_id AS task, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, event_type = 'purchase' AS ok, event_type = 'error' AS fatal FROM events) WHERE ok OR fatal OR attempt >= 3) WHERE rn = 1
""")
def retry_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.events(spark, sf_dir).withColumn("attempt", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    log = e.select(F.col("user_id").alias("task"), "attempt", (F.col("event_type") == "purchase").alias("ok"), F.col("event_type").alias("error"))
    return uploads.attempts(log, 3, ("error",)).select("task", "attempt", "outcome")
