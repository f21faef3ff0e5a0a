from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import texts
from foliant.operators import jobs as op
from foliant.plans.registry import query
from foliant.sources import tables as src


@query("""
SELECT user_id AS job_id, count(*) FILTER (event_type <> 'error') AS n_done, count(*) FILTER (event_type = 'error') AS n_failed, arg_max(event_type, (ts, event_type)) AS last_step,
  floor(count(DISTINCT event_type) FILTER (event_type <> 'error') * 100 / 8)::INTEGER AS progress FROM events GROUP BY 1
""")
def job_status_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.events(spark, sf_dir).select(F.col("user_id").alias("job_id"), F.col("event_type").alias("step"), (F.col("event_type") != "error").alias("ok"), F.lit("boom").alias("error"), F.col("ts").alias("at"))
    return op.step_lists(e).select("job_id", F.size("steps_completed").cast("long").alias("n_done"), F.size("steps_failed").cast("long").alias("n_failed"), "last_step", "progress")


@query("""
SELECT event_id, CASE WHEN (props->>'k')::BIGINT % 2 = 0 THEN 'the ' || event_type || ' step had no input' ELSE event_type || ' failed' END AS message, (props->>'k')::BIGINT % 3 = 0 AS pending, event_type <> 'error' AS succeeded FROM events
""")
def job_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.events(spark, sf_dir)
    step = F.col("event_type")
    warnings = F.when(F.col("k") % 2 == 0, F.array(F.lit("something else"), F.concat(F.lit("the "), step, F.lit(" step had no input"))))
    summary = F.when(F.col("k") % 3 == 0, '{"data": {"layout_pending": true}}').otherwise('{"data": {}}')
    failed = F.when(step == "error", F.array(F.lit("ocr"))).otherwise(F.array(F.lit("layout")))
    return e.select("event_id", op.failure_message(step, warnings).alias("message"), op.summary_flag(summary, "layout_pending").alias("pending"), op.succeeded(failed).alias("succeeded"))


@query("SELECT doc_id, 'good' AS quality, (n_chars % 101)::INTEGER AS score, 70 AS confidence, 'good|score:' || n_chars % 101 || '|confidence:70' AS line FROM documents")
def quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = src.table(spark, sf_dir, "documents").withColumn("line", op.quality_line(F.lit("good"), F.col("n_chars") % 101, F.lit(70)))
    return docs.select("doc_id", op.quality_of_line(F.col("line")).alias("q"), "line").select("doc_id", "q.quality", "q.score", "q.confidence", "line")


@query("SELECT conv_id, count(*) FILTER (length(text) > 100) AS done, count(*) AS pages, count(*) FILTER (length(text) > 100) >= 0.7 * count(*) AS enough FROM conversations GROUP BY 1")
def recognition_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = src.pages(spark, sf_dir).groupBy(F.col("paper_id").alias("conv_id")).agg(F.count_if(F.length("page_text") > 100).alias("done"), F.count("*").alias("pages"))
    return by.withColumn("enough", op.recognised_enough(F.col("done"), F.col("pages")))


@query("""
SELECT event_id, CASE WHEN c > 0.95 AND a = 'similar' THEN 'minimal_change' WHEN c > 0.85 AND a = 'improved' THEN 'minor_improvement' WHEN c < 0.85 AND a = 'improved' THEN 'significant_improvement' WHEN a = 'degraded' THEN 'quality_degraded' ELSE 'changed' END AS overall
FROM (SELECT event_id, (props->>'k')::DOUBLE / 100 AS c, CASE event_type WHEN 'click' THEN 'similar' WHEN 'error' THEN 'degraded' ELSE 'improved' END AS a FROM events)
""")
def overall_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.events(spark, sf_dir)
    a = F.when(F.col("event_type") == "click", "similar").when(F.col("event_type") == "error", "degraded").otherwise("improved")
    return e.select("event_id", texts.overall_change(F.col("k") / 100.0, a).alias("overall"))


@query("""
WITH s AS (SELECT user_id AS job_id, CASE event_type WHEN 'error' THEN 0 ELSE 2 END AS rank, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, CASE event_type WHEN 'error' THEN 0 ELSE 2 END) AS seen FROM events),
p AS (SELECT *, row_number() OVER (ORDER BY ts, job_id) AS place FROM s WHERE seen = 1),
w AS (SELECT *, row_number() OVER (ORDER BY rank, ts, job_id) AS first FROM p WHERE place <= 100)
SELECT job_id, CASE WHEN first <= 3 THEN 'running' ELSE 'waiting' END AS state FROM w UNION ALL SELECT job_id, 'refused' FROM p WHERE place > 100 UNION ALL SELECT job_id, 'repeated' FROM s WHERE seen > 1
""")
def queue_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.events(spark, sf_dir)
    sent = e.select(F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "error", 0).otherwise(2).alias("rank"), F.col("ts").alias("submitted_at"))
    return op.admitted(sent).select("job_id", "state")


RUNS = "(SELECT *, user_id * 1000 + dayofyear(ts) AS job_id, (props->>'k')::BIGINT AS k FROM events)"


@query(f"""
WITH e AS (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id)) - epoch_us(ts) AS us FROM {RUNS}),
s AS (SELECT job_id, event_type AS step, arg_max(us, (ts, event_id)) AS us FROM e WHERE us IS NOT NULL AND event_type <> 'signup' GROUP BY 1, 2),
t AS (SELECT job_id, string_agg(step || ':' || us, ',' ORDER BY step) AS steps FROM s GROUP BY 1),
j AS (SELECT job_id, min(ts) AS a, max(ts) AS b, arg_max(event_type, (ts, event_id)) AS last, arg_max(k, (ts, event_id)) AS k, arg_max(value, (ts, event_id)) AS memory FROM e GROUP BY 1)
SELECT job_id, (epoch_us(b) - epoch_us(a)) / 1e6::DOUBLE AS duration, last <> 'error' AS success, CASE WHEN last = 'error' THEN CASE WHEN k % 2 = 0 THEN 'boom' ELSE 'Unknown error' END END AS error_message, coalesce(t.steps, '') AS steps,
  CASE WHEN k % 3 > 0 THEN 'ocr,hashes' ELSE '' END AS steps_completed, CASE WHEN k % 3 > 0 THEN k END::INTEGER AS page_count, CASE WHEN k % 3 > 0 THEN 384 END::INTEGER AS embedding_dimension, memory AS memory_mb, k AS cpu_percent FROM j LEFT JOIN t USING (job_id) WHERE last <> 'view'
""")
def job_metric_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of finished jobs; a user's events of a day are a job's steps and samples, and one that ends in a view still runs."""
    e = src.events(spark, sf_dir).withColumn("job_id", F.col("user_id") * 1000 + F.dayofyear("ts"))
    by = F.struct("ts", "event_id")
    last = e.groupBy("job_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("at"), F.max_by("event_type", by).alias("last"), F.max_by("k", by).alias("k"))
    result = F.when(F.col("k") % 3 > 0, F.format_string('{"steps_completed": ["ocr", "hashes"], "data": {"page_count": %d, "embedding_dimension": 384, "ocr_quality_score": "none"}}', "k"))
    jobs = last.select("job_id", F.lit("a.pdf").alias("filename"), F.lit(1.0).alias("size_mb"), "started_at", F.when(F.col("last") != "view", F.col("at")).alias("ended_at"), (F.col("last") != "error").alias("ok"), F.when(F.col("k") % 2 == 0, "boom").alias("error"), result.alias("result"))
    steps = e.select("job_id", F.col("event_id").alias("step_id"), F.when(F.col("event_type") == "signup", "initializing").otherwise(F.col("event_type")).alias("step"), F.col("ts").alias("created_at"))
    samples = e.select("job_id", F.col("event_id").alias("sample_id"), F.col("ts").alias("at"), F.col("value").alias("memory_mb"), F.col("k").alias("cpu_percent"), F.lit(0.0).alias("read_mb"), F.lit(0.0).alias("write_mb"))
    found = op.metrics(jobs, steps, samples)
    timed = F.array_join(F.transform(F.array_sort(F.map_entries("step_durations")), lambda s: F.concat(s["key"], F.lit(":"), F.round(s["value"] * 1e6).cast("long").cast("string"))), ",")
    return found.select("job_id", "duration", "success", "error_message", timed.alias("steps"), F.array_join("steps_completed", ",").alias("steps_completed"), "page_count", "embedding_dimension", "memory_mb", "cpu_percent")
