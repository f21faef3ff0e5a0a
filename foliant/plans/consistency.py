from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import backups, versions
from foliant.operators import consistency as op
from foliant.plans.registry import query
from foliant.session import scratch
from foliant.sources import tables as src

ISSUES = """
SELECT 'missing_left' AS kind, vec_id::VARCHAR AS key, 'medium' AS severity FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'missing_right', doc_id::VARCHAR, 'medium' FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT 'page_count_mismatch', k::VARCHAR, 'medium' FROM (SELECT coalesce(a.conv_id, b.user_id) AS k, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) a FULL JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) b ON a.conv_id = b.user_id) WHERE x <> y
UNION ALL SELECT DISTINCT 'orphaned_record', conv_id::VARCHAR, 'high' FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)
UNION ALL (SELECT 'attribute_mismatch', d.doc_id::VARCHAR, 'low' FROM documents d JOIN embeddings v ON v.vec_id = d.doc_id WHERE d.n_chars % 10 IS DISTINCT FROM v.label ORDER BY d.doc_id LIMIT 10)
UNION ALL SELECT 'count_mismatch', a || '/' || b, 'high' FROM (SELECT (SELECT count(*) FROM labels) AS a, (SELECT count(*) FROM embeddings) AS b) WHERE a <> b
"""


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n, c: src.table(spark, sf_dir, n).withColumnRenamed(c, "id")
    docs, labels, vectors, turns, events = t("documents", "doc_id"), t("labels", "doc_id"), t("embeddings", "vec_id"), t("conversations", "conv_id"), t("events", "user_id")
    return op.everything(
        op.id_differences(labels, vectors, "id"), op.count_differences(turns, events, "id"), op.orphaned(turns, labels, "id"),
        op.attribute_differences(docs.withColumn("a", (F.col("n_chars") % 10).cast("int")), vectors.withColumnRenamed("label", "a"), "id", "a"), op.total_difference(labels, vectors),
    )


@query(ISSUES)
def consistency_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(spark, sf_dir).select("kind", "key", "severity")


@query(f"""
SELECT issues, critical, high, medium, low, CASE WHEN issues = 0 THEN 'excellent' WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'poor' WHEN issues > 10 THEN 'fair' ELSE 'good' END AS status
FROM (SELECT count(*) AS issues, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM ({ISSUES}))
""")
def consistency_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.status(issues(spark, sf_dir))


@query(f"SELECT kind, count(*) AS n FROM ({ISSUES}) GROUP BY 1")
def consistency_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.recommendations(issues(spark, sf_dir)).select("kind", "n")


@query("SELECT *, papers = vectors AS counts_match, CASE WHEN papers = vectors THEN 'consistent' ELSE 'inconsistent' END AS status FROM (SELECT (SELECT count(*) FROM documents) AS papers, (SELECT count(*) FROM embeddings) AS vectors)")
def consistency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.quick_summary(src.table(spark, sf_dir, "documents"), src.table(spark, sf_dir, "embeddings"), F.lit(True), F.lit(0))


@query("SELECT count(*) AS fixed FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)")
def consistency_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = src.table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "id")
    return op.repaired(turns, src.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id"), "id")[1]


MANIFEST = """(SELECT event_id AS backup_id, CASE event_type WHEN 'click' THEN 'full' WHEN 'error' THEN 'incremental' ELSE 'snapshot' END AS type, ts AS timestamp, (props->>'k')::BIGINT * 1000 AS size_bytes,
  CASE WHEN event_type = 'signup' THEN 'failed' ELSE 'completed' END AS status, 7 + user_id % 20 AS retention_days FROM events)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.events(spark, sf_dir)
    kind = F.when(F.col("event_type") == "click", "full").when(F.col("event_type") == "error", "incremental").otherwise("snapshot")
    return e.select(F.col("event_id").alias("backup_id"), kind.alias("type"), F.col("ts").alias("timestamp"), (F.col("k") * 1000).alias("size_bytes"), F.when(F.col("event_type") == "signup", "failed").otherwise("completed").alias("status"), (7 + F.col("user_id") % 20).cast("int").alias("retention_days"))


@query(f"SELECT type, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, coalesce(sum(size_bytes) FILTER (status = 'completed'), 0)::BIGINT AS bytes, arg_max(backup_id, (timestamp, backup_id)) FILTER (status = 'completed') AS latest FROM {MANIFEST} GROUP BY 1")
def backup_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backups.totals(manifest(spark, sf_dir))


@query(f"SELECT backup_id FROM {MANIFEST} WHERE TIMESTAMP '2024-01-31' > timestamp + to_days(retention_days::INTEGER)")
def expired_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backups.expired(manifest(spark, sf_dir), F.lit(src.AS_OF).cast("timestamp")).select("backup_id")


@query(f"SELECT backup_id, strftime(timestamp, '%Y%m%d_%H%M%S') AS stamp FROM {MANIFEST} ORDER BY timestamp DESC, backup_id DESC LIMIT 1000")
def backup_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backups.history(manifest(spark, sf_dir)).select("backup_id", F.date_format("timestamp", "yyyyMMdd_HHmmss").alias("stamp"))


@query(f"SELECT backup_id, type, size_bytes FROM {MANIFEST} ORDER BY timestamp DESC, backup_id DESC LIMIT 1000")
def kept_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history to which three runs added their entries, and which keeps the newest 1000."""
    folder, entries = scratch(spark, "history"), manifest(spark, sf_dir)
    for run in range(3):
        backups.keep_history(entries.where(F.col("size_bytes") / 1000 % 3 == run), folder)
    return versions.read(spark, folder).select("backup_id", "type", "size_bytes")


@query(f"""
WITH f AS (SELECT count(*) FILTER (type = 'full' AND status = 'completed' AND timestamp > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS recent, count(*) FILTER (type = 'snapshot' AND status = 'completed') AS vectors FROM {MANIFEST})
SELECT recent, vectors, score, CASE WHEN score >= 8 THEN 'excellent' WHEN score >= 6 THEN 'good' WHEN score >= 4 THEN 'fair' ELSE 'poor' END AS level
FROM (SELECT *, (CASE WHEN recent >= 3 THEN 3 WHEN recent >= 1 THEN 1 ELSE 0 END + 2 + CASE WHEN vectors >= 3 THEN 2 WHEN vectors >= 1 THEN 1 ELSE 0 END + 2 + 0) AS score FROM f)
""")
def readiness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backups.readiness(manifest(spark, sf_dir), F.lit(src.AS_OF).cast("timestamp"), disk_gb=12.0, scripts=2, scheduler=False).select("recent", "vectors", "score", "level")


@query("""
SELECT doc_id, source || '_' || doc_id || '.pdf' AS filename, (SELECT count(*) FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.doc_id % 3 = 0) AS fixed FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT -1, 'lost.pdf', (SELECT count(*) FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.doc_id % 3 = 0)
""")
def consistency_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names that a vector store has wrong, set to the catalogue's; a row that the catalogue lacks stays."""
    papers = src.papers(spark, sf_dir).select("doc_id", "filename")
    stored = src.table(spark, sf_dir, "labels").select("doc_id").join(papers, "doc_id").withColumn("filename", F.when(F.col("doc_id") % 3 == 0, "old.pdf").otherwise(F.col("filename")))
    stored = stored.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("lost.pdf").alias("filename")))
    fixed, count = op.corrected(stored, papers, "doc_id", "filename")
    return fixed.withColumn("fixed", F.lit(count.first()["fixed"]))
