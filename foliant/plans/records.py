"""Moments, running figures, the live queue, the ingest's chain and pending work, fields of model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import extract, texts, times
from foliant.operators import catalog, jobs, telemetry
from foliant.plans.registry import query
from foliant.sources import scorers
from foliant.sources import tables as src

NOW = "TIMESTAMP '2024-01-30 12:00:00'"


def as_of():
    return F.lit("2024-01-30 12:00:00").cast("timestamp")


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso_of_epoch FROM events
""")
def moment_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.events(spark, sf_dir)
    return e.select("event_id", times.iso(F.col("ts")).alias("iso"), times.stamp(F.col("ts")).alias("stamp"), times.day(F.col("ts")).alias("day"), times.iso_of_epoch(F.unix_timestamp("ts")).alias("iso_of_epoch"))


@query("""
SELECT event_id, concat_ws(',', CASE WHEN hour(ts) = 2 THEN 'daily_cleanup' END, CASE WHEN hour(ts) = 3 AND dayofweek(ts) = 0 THEN 'weekly_cleanup' END, CASE WHEN hour(ts) = 4 AND day(ts) = 1 THEN 'monthly_cleanup' END) AS due FROM events
""")
def schedule_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.events(spark, sf_dir).select("event_id", F.array_join(times.due(F.col("ts")), ",").alias("due"))


@query(f"""
SELECT event_id, age / 3600.0 <= 26 AND ts <= {NOW} AS recent, floor(age / 86400.0) > (props->>'k')::BIGINT % 20 AS expired FROM (SELECT *, epoch({NOW}) - floor(epoch(ts)) AS age FROM events)
""")
def backup_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts")
    fresh = (times.age_hours(at, as_of()) <= 26) & (at <= as_of())
    return src.events(spark, sf_dir).select("event_id", fresh.alias("recent"), times.older_than(at, as_of(), F.col("k") % 20).alias("expired"))


@query("""
SELECT event_id, round(avg(value) OVER w, 9) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def running_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's mean carried on from the one before it, as the queue keeps it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    e = src.events(spark, sf_dir).withColumns({"mean_": F.avg("value").over(past), "n_": F.count("value").over(past)})
    return e.select("event_id", F.round(telemetry.running_mean(F.col("mean_"), F.col("n_"), F.col("value")), 9).alias("mean"))


@query("""
SELECT user_id, round(rate, 6) AS rate, CASE WHEN rate >= 90 THEN 'good' WHEN rate >= 70 THEN 'fair' ELSE 'poor' END AS band
FROM (SELECT user_id, count(*) FILTER (event_type <> 'error') * 100.0 / count(*) AS rate FROM events GROUP BY 1)
""")
def queue_success_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    by = src.events(spark, sf_dir).groupBy("user_id").agg(F.count_if(~failed).alias("done"), F.count_if(failed).alias("failed"))
    return by.select("user_id", F.round(telemetry.queue_success(F.col("done"), F.col("failed")), 6).alias("rate"), telemetry.success_band(F.col("done"), F.col("failed")).alias("band"))


@query(f"SELECT event_id AS job_id, event_type AS step, floor(epoch({NOW}))::BIGINT - floor(epoch(ts))::BIGINT AS seconds FROM events WHERE event_type = 'view'")
def active_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.active(src.jobs(spark, sf_dir), as_of()).select("job_id", "step", "seconds")


@query(f"""
SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS step, floor(epoch({NOW}))::BIGINT - floor(epoch(max(ts)))::BIGINT AS seconds FROM events GROUP BY 1
""")
def active_step_timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.events(spark, sf_dir)
    last = e.groupBy(F.col("user_id").alias("job_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("step"), F.max("ts").alias("begun"))
    return last.select("job_id", "step", (F.unix_timestamp(as_of()) - F.unix_timestamp("begun")).alias("seconds"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def english_and_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.papers(spark, sf_dir).where("lang = 'en'").select("doc_id").intersect(src.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


@query("""
SELECT d.doc_id, upper(substr(text, 1, 40)) AS title, source || ', Poe' AS authors, 2000 + d.doc_id % 20 AS year FROM documents d JOIN labels l USING (doc_id)
WHERE contains(upper(substr(text, 1, 40)), 'AN') AND contains(source || ', Poe', 'src1') AND 2000 + d.doc_id % 20 = 2004 ORDER BY d.doc_id DESC LIMIT 20
""")
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = src.papers(spark, sf_dir)
    known = src.metadata(spark, sf_dir).join(papers.select(F.col("doc_id").alias("paper_id"), "source", F.upper(F.substring("ocr_text", 1, 40)).alias("title")), "paper_id")
    meta = known.select("paper_id", "title", F.array("source", F.lit("Poe")).alias("authors"), (F.lit(2000) + F.col("paper_id") % 20).alias("year"))
    found = catalog.search(papers.select("doc_id", "created_at"), meta, title="an", author="SRC1", year=2004)
    return found.select("doc_id", "title", F.array_join("authors", ", ").alias("authors"), "year")


@query("""
SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN '' WHEN n % 7 = 0 THEN 'save_paper,ocr,ocr_quality,embedding,metadata,hashes,cleanup' ELSE 'save_paper,ocr,ocr_quality,embedding,layout,metadata,hashes,cleanup' END AS done,
  CASE WHEN text IS NULL OR text = '' THEN 'save_paper' WHEN n % 7 = 0 THEN 'layout' ELSE '' END AS failed, coalesce(text <> '', false) AS success,
  CASE WHEN text IS NULL OR text = '' THEN 0 WHEN n % 7 = 0 THEN 87 ELSE 100 END AS progress
FROM (SELECT doc_id, text, n_chars AS n FROM documents UNION ALL SELECT -1, NULL, 5 UNION ALL SELECT -2, '', 7)
""")
def ingest_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = src.table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars").unionByName(spark.createDataFrame([(-1, None, 5), (-2, "", 7)], "doc_id long, text string, n_chars long"))
    ok = F.lit(None).cast("string")
    steps = dict.fromkeys(jobs.STEPS, ok) | {"save_paper": F.when(F.coalesce(F.col("text"), F.lit("")) == "", "no content"), "layout": F.when(F.col("n_chars") % 7 == 0, "no answer")}
    done = jobs.ingest(docs, steps)
    return done.select("doc_id", F.array_join("steps_completed", ",").alias("done"), F.array_join("steps_failed", ",").alias("failed"), "success", "progress")


FLAGS = "(SELECT doc_id, n_chars % 2 = 0 AS quality_pending, n_chars % 3 = 0 AS layout_pending, n_chars % 5 = 0 AS llm_pending FROM documents)"


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return src.table(spark, sf_dir, "documents").select("doc_id", (n % 2 == 0).alias("quality_pending"), (n % 3 == 0).alias("layout_pending"), (n % 5 == 0).alias("llm_pending"))


@query(f"""
SELECT kind, count(*) AS pending, count(*) FILTER (doc_id % 4 < 2) AS processed, count(*) FILTER (doc_id % 4 = 2) AS failed FROM (
  SELECT doc_id, unnest(['quality', 'layout', 'llm']) AS kind, unnest([quality_pending, layout_pending, llm_pending]) AS waits FROM {FLAGS}) WHERE waits GROUP BY 1
""")
def pending_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("quality", "layout", "llm")
    run = flags(spark, sf_dir).where("doc_id % 4 < 3").select("doc_id", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"), (F.col("doc_id") % 4 < 2).alias("ok"))
    return jobs.task_counts(flags(spark, sf_dir), run, kinds)


@query(f"""
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS place, kind FROM (
  SELECT doc_id, unnest([0, 1, 2]) AS i, unnest(['llm', 'quality', 'layout']) AS kind, unnest([llm_pending, quality_pending, layout_pending]) AS waits FROM {FLAGS}) WHERE waits
""")
def tasks_of_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pending tasks of each paper: those of the language model first, the layout last."""
    return jobs.task_order(flags(spark, sf_dir), ("llm", "quality", "layout"))


@query("SELECT event_id, 'upload,' || event_type AS names FROM events")
def appended_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.events(spark, sf_dir)
    one = jobs.append_step(F.lit(None).cast("array<struct<at:timestamp,name:string>>"), F.lit("upload"), F.col("ts"))
    two = jobs.append_step(one, F.col("event_type"), F.col("ts"))
    return e.select("event_id", F.array_join(F.transform(two, lambda s: s["name"]), ",").alias("names"))


@query("SELECT doc_id, source AS title, lang AS last_author, nullif(regexp_extract('Year: ' || n_chars, '[0-9]+'), '') AS year FROM documents")
def labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = src.table(spark, sf_dir, "documents")
    said = F.concat_ws("\n", F.lit("Title: first"), F.concat(F.lit("Author: "), F.col("lang")), F.concat(F.lit("  Title:"), F.col("source"), F.lit("  ")), F.concat(F.lit("Year: "), F.col("n_chars").cast("string")))
    return docs.select("doc_id", extract.labelled(said, "Title").alias("title"), extract.labelled(said, "Author").alias("last_author"), extract.labelled(said, "Year").alias("year"))


@query("SELECT doc_id, least(length(text), CASE WHEN doc_id % 2 = 0 THEN 4985 ELSE 4000 END) + CASE WHEN doc_id % 2 = 0 THEN 15 ELSE 0 END AS shown FROM documents")
def prompt_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = src.table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("[FONT_SIZE:12] "), F.col("text"))).otherwise(F.col("text"))
    return docs.select("doc_id", F.length(extract.prompt_text(text)).alias("shown"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'good' ELSE 'unknown' END AS quality, CASE WHEN doc_id % 3 = 2 THEN '' ELSE 'analysis_failed' END AS issues, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE 'Assessment failed' END AS quality_error,
  doc_id % 4 > 0 AND n_chars <= 50 AND doc_id % 5 > 0 AS layout_success, CASE WHEN doc_id % 4 = 0 THEN 'Layout analysis service disabled (CPU-only mode)' WHEN n_chars > 50 THEN 'File too large: ' || n_chars || '.0MB (max: 50MB)' WHEN doc_id % 5 = 0 THEN 'No answer' END AS layout_error,
  CASE WHEN doc_id % 4 > 0 AND n_chars <= 50 AND doc_id % 5 > 0 THEN 2 ELSE 0 END AS page_count, CASE WHEN doc_id % 4 = 0 THEN 'disabled' WHEN n_chars > 50 OR doc_id % 5 = 0 THEN 'failed' ELSE 'done' END AS status FROM documents
""")
def default_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of assessments and layouts that failed, are switched off or are of files too large; a document's characters stand for megabytes."""
    docs, i = src.table(spark, sf_dir, "documents"), F.col("doc_id")
    good = F.when(i % 3 == 2, F.struct(*[(F.lit("good") if k == "overall_quality" else F.array().cast("array<string>") if isinstance(v, list) else F.lit(None).cast("string") if k == "error" else F.lit(v)).alias(k) for k, v in scorers.FAILED_QUALITY.items()]))
    quality = scorers.with_default(good, F.lit(True), scorers.failed_quality(), scorers.failed_quality())
    layout = scorers.layout_result(F.when(i % 5 > 0, 2), i % 4 > 0, F.col("n_chars").cast("double"))
    made = docs.select("doc_id", quality.alias("q"), layout.alias("l"))
    return made.select("doc_id", F.col("q.overall_quality").alias("quality"), F.array_join("q.issues", ",").alias("issues"), F.col("q.error").alias("quality_error"), F.col("l.success").alias("layout_success"), F.col("l.error").alias("layout_error"), "l.page_count", "l.status")


@query("SELECT event_id, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'GPU' WHEN k % 2 <> 0 AND k % 3 <> 0 THEN 'CPU' ELSE 'Mixed' END AS mode FROM (SELECT event_id, (props->>'k')::BIGINT AS k FROM events)")
def deployment_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.events(spark, sf_dir).select("event_id", scorers.deployment(F.col("k") % 2 == 0, F.col("k") % 3 == 0).alias("mode"))


@query("SELECT doc_id, coalesce(CASE WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) >= 1500 THEN 'text' END, CASE WHEN doc_id % 2 = 0 THEN 'visual' END, 'recognised') AS origin FROM documents")
def language_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rung of the ladder tells a language: a text that is long enough, a visual model's answer, else the best recognised one."""
    long = F.when(F.length(texts.strip(F.col("text"))) >= 1500, "text")
    return src.table(spark, sf_dir, "documents").select("doc_id", scorers.first_known(long, F.when(F.col("doc_id") % 2 == 0, "visual"), F.lit("recognised")).alias("origin"))
