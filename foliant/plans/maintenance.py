from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import maintenance as op
from foliant.operators.duplicates import newest
from foliant.plans.registry import query
from foliant.sources import tables as src


def as_of(day: str = src.AS_OF) -> Column:
    return F.lit(day).cast("timestamp")


#: A month after the papers were made.
LATER = "2024-02-02 00:00:00"


def hash_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored hashes: half again as many papers are named as there are."""
    e = src.events(spark, sf_dir)
    return e.select(F.col("event_id").alias("key"), (F.col("event_id") % 1500).alias("paper_id"), F.col("ts").alias("created_at"))


STORE = "(SELECT event_id AS key, event_id % 1500 AS paper_id, ts AS created_at FROM events)"
PAPERS = "(SELECT doc_id, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at FROM documents)"
LOG = "(SELECT ts AS created_at, CASE WHEN event_type IN ('click', 'purchase') THEN user_id END AS paper FROM events)"


@query("SELECT DISTINCT ON (md5(text)) md5(text) AS key, doc_id AS paper_id FROM documents ORDER BY md5(text), doc_id DESC")
def hash_store_dedup_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = src.papers(spark, sf_dir).select(F.md5("ocr_text").alias("content"), F.col("doc_id").alias("key"), "created_at")
    return newest(papers, "content").select(F.col("content").alias("key"), F.col("key").alias("paper_id"))


@query(f"SELECT s.key, s.paper_id FROM {STORE} s WHERE s.paper_id NOT IN (SELECT doc_id FROM documents)")
def cleanup_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.orphans(hash_store(spark, sf_dir), src.papers(spark, sf_dir)).select("key", "paper_id")


@query(f"""
SELECT s.key, s.paper_id FROM {STORE} s JOIN {PAPERS} p ON p.doc_id = s.paper_id
WHERE p.created_at < TIMESTAMP '2024-02-02' - INTERVAL 30 DAY AND s.paper_id NOT IN (SELECT paper FROM {LOG} WHERE paper IS NOT NULL AND created_at >= TIMESTAMP '2024-02-02' - INTERVAL 30 DAY)
""")
def cleanup_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.unused(hash_store(spark, sf_dir), src.papers(spark, sf_dir), src.detections(spark, sf_dir), as_of(LATER), 1).select("key", "paper_id")


@query("SELECT event_id AS detection_id FROM events WHERE ts < TIMESTAMP '2024-01-31' - INTERVAL 20 DAY")
def cleanup_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.old_logs(src.detections(spark, sf_dir), as_of(), 20).select("detection_id")


@query("SELECT event_id AS job_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status FROM events WHERE event_type <> 'view' AND ts < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def cleanup_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.finished_jobs(src.jobs(spark, sf_dir), as_of()).select("job_id", "status")


@query(f"""
WITH s AS {STORE}, held AS (SELECT * FROM s WHERE paper_id IN (SELECT doc_id FROM documents)),
single AS (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY created_at DESC, key DESC) = 1),
gone AS (SELECT x.* FROM single x JOIN {PAPERS} p ON p.doc_id = x.paper_id WHERE p.created_at < TIMESTAMP '2024-02-02' - INTERVAL 30 DAY
  AND x.paper_id NOT IN (SELECT paper FROM {LOG} WHERE paper IS NOT NULL AND created_at >= TIMESTAMP '2024-02-02' - INTERVAL 30 DAY))
SELECT 'orphaned' AS step, 'hashes' AS store, (SELECT count(*) FROM s) - (SELECT count(*) FROM held) AS removed
UNION ALL SELECT 'duplicate', 'hashes', (SELECT count(*) FROM held) - (SELECT count(*) FROM single)
UNION ALL SELECT 'unused', 'hashes', (SELECT count(*) FROM gone)
UNION ALL SELECT 'logs', 'log', (SELECT count(*) FROM events WHERE ts < TIMESTAMP '2024-02-02' - INTERVAL 20 DAY)
""")
def cleanup_all_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.clean_all({"hashes": hash_store(spark, sf_dir)}, src.papers(spark, sf_dir), src.detections(spark, sf_dir), as_of(LATER), 1, 20)[2]


@query("""
SELECT coalesce(d.doc_id, n.doc_id) AS doc_id, coalesce(n.lang, d.lang) AS lang, coalesce(nullif(n.source, ''), d.source) AS source, d.n_chars
FROM documents d FULL JOIN (SELECT doc_id + 500 AS doc_id, CASE WHEN quality = 1 THEN 'xx' END AS lang, CASE WHEN toxic = 1 THEN '' ELSE 'new' END AS source FROM labels) n ON d.doc_id = n.doc_id
""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = src.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    new = src.table(spark, sf_dir, "labels").select((F.col("doc_id") + 500).alias("doc_id"), F.when(F.col("quality") == 1, "xx").alias("lang"), F.when(F.col("toxic") == 1, "").otherwise("new").alias("source"))
    return op.upsert(stored, new, "doc_id", keep_empty=("source",))


@query("""
SELECT conv_id AS paper_id, (turn + 1)::INTEGER AS page_number, text AS page_text FROM conversations WHERE conv_id % 3 <> 0
UNION ALL SELECT conv_id, 1, 'new: ' || text FROM conversations WHERE conv_id % 3 = 0 AND turn = 0
""")
def replace_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = src.pages(spark, sf_dir).select("paper_id", "page_number", "page_text")
    new = pages.where("paper_id % 3 = 0 AND page_number = 1").withColumn("page_text", F.concat(F.lit("new: "), F.col("page_text")))
    return op.replace_group(pages, new, "paper_id")


@query("SELECT conv_id AS paper_id, (turn + 1)::INTEGER AS page_number FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = src.papers(spark, sf_dir).where("lang = 'fr'")
    return op.cascade_delete(gone, pages=src.pages(spark, sf_dir))["pages"].select("paper_id", "page_number")


@query("SELECT event_id % 1500 AS paper_id, arg_max(event_id, (ts, event_id)) AS key FROM events GROUP BY 1")
def replace_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = hash_store(spark, sf_dir)
    return op.newest(store.where("key % 2 = 0").unionByName(store.where("key % 2 = 1")), "paper_id").select("paper_id", "key")
