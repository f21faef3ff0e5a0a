from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import duplicates as op
from foliant.plans.registry import query
from foliant.session import written
from foliant.sources import tables as src

TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: A document's sample: the beginnings of the first, middle and last of its pages of 1000 characters.
SAMPLE = f"""trim((SELECT CASE WHEN length(j) > 4000 THEN substr(j, 1, 4000) || '...' ELSE j END FROM (SELECT array_to_string(list_transform(list_sort(list_distinct(list_filter(
  [0, CASE WHEN ceil(length(text) / 1000.0) >= 3 THEN ceil(length(text) / 1000.0)::INTEGER // 2 END, ceil(length(text) / 1000.0)::INTEGER - 1], lambda i: i >= 0))), lambda i: substr(text, i * 1000 + 1, 1000) || '\\n'), '') AS j)), {TRIM})""".replace("\\\\", "\\")
#: The levels' keys over a document's text; the third stands for the digest of a vector of the sample's words.
L0 = "md5(text)"
L1 = f"sha256('|title:|author:|creator:|pages:1|text:' || trim(CASE WHEN length(text) + 1 > 5000 THEN substr(text || chr(10), 1, 5000) || '...' ELSE text || chr(10) END, {TRIM}))"
L2 = r"CASE WHEN length(s) >= 50 THEN array_to_string(list_sort(regexp_extract_all(s, '[^\x20\x09-\x0D]+')), ' ') END"


def _keyed(table: str, key: str) -> str:
    return f"(SELECT {key}, k0, k1, {L2} AS k2 FROM (SELECT {key}, {L0} AS k0, {L1} AS k1, {SAMPLE} AS s FROM {table}))"


KEYED = _keyed("documents", "doc_id")
COLUMNS = ("k_file", "k_content", "k_sample")


def keyed(texts: DataFrame, key: str, levels: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """The keys of levels of texts (key, text), each text read once. Only the last needs Python, which Spark would run for a key that isn't asked for as well."""
    text, none = F.col("text"), F.lit(None)
    content = op.content_hash(none, none, none, F.lit(1), op.first_pages_text(F.array(text)))
    made = texts.select(key, *[c.alias(COLUMNS[i]) for i, c in ((0, F.md5(text)), (1, content), (2, op.sample_of_text(text))) if i in levels])
    return op.with_sample_hash(made.withColumnRenamed(COLUMNS[2], "sample"), "sample", COLUMNS[2]) if 2 in levels else made


def keys() -> dict:
    return {level: F.col(c) for level, c in zip(op.LEVELS, COLUMNS, strict=True)}


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "documents").select("doc_id", "text")


def level(spark: SparkSession, sf_dir: str, i: int) -> DataFrame:
    stored = written(keyed(docs(spark, sf_dir), "doc_id", (i,)), "keys")
    return op.first_of_group(stored, F.col(COLUMNS[i]), op.LEVELS[i])


def _copies(i: int) -> str:
    return f"SELECT doc_id, first AS duplicate_of, '{op.LEVELS[i]}' AS level FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY k{i}) AS first FROM {KEYED} WHERE k{i} IS NOT NULL) WHERE doc_id <> first"


@query(_copies(0))
def dup_level0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.first_of_group(docs(spark, sf_dir), F.md5("text"), op.LEVELS[0])


@query(_copies(1))
def dup_level1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level(spark, sf_dir, 1)


@query(_copies(2))
def dup_level2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level(spark, sf_dir, 2)


@query(f"""
WITH k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k0) AS a, min(doc_id) OVER (PARTITION BY k1) AS b, CASE WHEN k2 IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY k2) END AS c FROM {KEYED})
SELECT doc_id, CASE WHEN a <> doc_id THEN a WHEN b <> doc_id THEN b ELSE c END AS duplicate_of,
  CASE WHEN a <> doc_id THEN '{op.LEVELS[0]}' WHEN b <> doc_id THEN '{op.LEVELS[1]}' ELSE '{op.LEVELS[2]}' END AS level
FROM k WHERE a <> doc_id OR b <> doc_id OR c <> doc_id
""")
def dup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cascade(keyed(docs(spark, sf_dir), "doc_id"), keys())


@query(f"""
WITH l AS (SELECT * FROM {KEYED}), l0 AS (SELECT k0 AS k, min(doc_id) AS d FROM l GROUP BY 1), l1 AS (SELECT k1 AS k, min(doc_id) AS d FROM l GROUP BY 1), l2 AS (SELECT k2 AS k, min(doc_id) AS d FROM l WHERE k2 IS NOT NULL GROUP BY 1)
SELECT b.item_id, coalesce(l0.d, l1.d, l2.d) AS duplicate_of,
  CASE WHEN l0.d IS NOT NULL THEN '{op.LEVELS[0]}' WHEN l1.d IS NOT NULL THEN '{op.LEVELS[1]}' WHEN l2.d IS NOT NULL THEN '{op.LEVELS[2]}' ELSE 'No_Duplicate' END AS level
FROM {_keyed("(SELECT item_id, text FROM benchmark UNION ALL SELECT -1 - doc_id, text FROM documents WHERE lang = 'fr')", "item_id")} b LEFT JOIN l0 ON l0.k = k0 LEFT JOIN l1 ON l1.k = k1 LEFT JOIN l2 ON l2.k = k2
""")
def dup_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates held against the library: the benchmark's texts, and documents of one language handed in again."""
    again = src.table(spark, sf_dir, "documents").where("lang = 'fr'").select((-1 - F.col("doc_id")).alias("item_id"), "text")
    candidates = src.table(spark, sf_dir, "benchmark").select("item_id", "text").unionByName(again)
    return op.probe(keyed(candidates, "item_id"), written(keyed(docs(spark, sf_dir), "doc_id"), "library-keys"), keys(), "item_id")


@query("SELECT md5(text) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def group_having_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.groups_with_copies(docs(spark, sf_dir), F.md5("text"))


@query(f"""
SELECT doc_id, sample_pages, md5(trim(CASE WHEN length(s) > 4000 THEN substr(s, 1, 4000) || '...' ELSE s END, {TRIM})) AS sample_md5 FROM (
  SELECT conv_id AS doc_id, n, list_sort(list_distinct(list_filter([0, CASE WHEN n >= 3 THEN n // 2 END, n - 1], lambda i: i IS NOT NULL))) AS sp, p FROM (
    SELECT conv_id, count(*)::INTEGER AS n, list(text ORDER BY turn) AS p FROM conversations GROUP BY 1)
) x, LATERAL (SELECT array_to_string(x.sp, ',') AS sample_pages, array_to_string(list_transform(x.sp, lambda i: substr(coalesce(x.p[i + 1], ''), 1, 1000) || '\\n'), '') AS s)
""".replace("\\\\", "\\"))
def sampled_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "page_text"))), lambda x: x["page_text"])
    papers = src.pages(spark, sf_dir).groupBy(F.col("paper_id").alias("doc_id")).agg(ordered.alias("pages"))
    papers = papers.withColumn("at", op.sampled_pages(F.size("pages")))
    return papers.select("doc_id", F.array_join(F.col("at").cast("array<string>"), ",").alias("sample_pages"), F.md5(op.sample_text(F.col("pages"), F.col("at"))).alias("sample_md5"))


@query("""
WITH r AS (SELECT *, CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS dup, (props->>'k')::BIGINT AS k FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY)
SELECT count(*) AS total, sum(dup)::BIGINT AS duplicates, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'click') AS level_0_hits, count(*) FILTER (event_type = 'purchase') AS level_1_hits,
  round(sum(dup) * 100.0 / count(*), 6) AS detection_rate, round(count(*) FILTER (event_type = 'click') * 100.0 / sum(dup), 6) AS level_0_share, round(count(*) FILTER (event_type = 'purchase') * 100.0 / sum(dup), 6) AS level_1_share,
  round(sum(CASE WHEN dup = 1 THEN greatest(0, 60 + 20.0::DOUBLE * k * 100000 / 1048576 - value) ELSE 0 END) / 60, 6) AS minutes_saved,
  round(avg(CASE WHEN k % 2 = 0 THEN value / 2 END), 6) AS avg_layer_0_time, round(avg(value), 6) AS avg_time FROM r
""")
def detection_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.log_statistics(src.detections(spark, sf_dir), F.lit(src.AS_OF).cast("timestamp"), 14)


@query("""
SELECT event_id AS detection_id, event_type AS step, round((props->>'k')::BIGINT * 100000 / 1048576.0::DOUBLE, 6) AS size_mb, round(value, 6) AS seconds
FROM events ORDER BY ts DESC, event_id DESC LIMIT 50
""")
def recent_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = src.events(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    return log.select(F.col("event_id").alias("detection_id"), F.col("event_type").alias("step"), F.round(F.col("k") * 100_000 / 1048576.0, 6).alias("size_mb"), F.round("value", 6).alias("seconds"))


@query("""
SELECT count(DISTINCT d.doc_id) AS papers, (SELECT count(*) FROM events) AS hashes, count(e.event_id) AS joined_rows, count(DISTINCT e.user_id) AS papers_with_hash,
  round((SELECT count(*) FROM events) * 100.0 / count(DISTINCT d.doc_id), 6) AS coverage
FROM documents d LEFT JOIN events e ON e.user_id = d.doc_id
""")
def hash_store_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.store_coverage(src.papers(spark, sf_dir), src.events(spark, sf_dir).select(F.col("event_id").alias("key"), F.col("user_id").alias("paper_id"), F.col("ts").alias("created_at")))


@query("""
SELECT d.doc_id, c.event_id AS click_key, c.event_id IS NOT NULL AS exists_click, p.event_id AS purchase_key, p.event_id IS NOT NULL AS exists_purchase FROM documents d
LEFT JOIN (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1) c ON c.user_id = d.doc_id
LEFT JOIN (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1) p ON p.user_id = d.doc_id
""")
def hashes_of_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.events(spark, sf_dir).select(F.col("event_id").alias("key"), F.col("user_id").alias("paper_id"), F.col("ts").alias("created_at"), "event_type")
    return op.hashes_of(src.papers(spark, sf_dir), click=e.where("event_type = 'click'"), purchase=e.where("event_type = 'purchase'"))


@query()
def vector_content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.vector_digest(src.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("""
SELECT event_id, round(CASE WHEN event_type IN ('click', 'purchase') THEN greatest(0, 60 + 20.0::DOUBLE * (props->>'k')::BIGINT * 100000 / 1048576 - value) END, 6) AS saved FROM events
""")
def time_saved_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = src.detections(spark, sf_dir)
    return log.select(F.col("detection_id").alias("event_id"), F.round(op.time_saved(F.col("detection_result"), F.col("file_size"), F.col("total_processing_time")), 6).alias("saved"))


@query("SELECT event_id AS key, doc_id AS paper_id, source || '_' || doc_id || '.pdf' AS filename FROM events JOIN documents ON user_id = doc_id ORDER BY ts DESC, event_id DESC LIMIT 10")
def recent_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.events(spark, sf_dir).select(F.col("event_id").alias("key"), F.col("user_id").alias("paper_id"), F.col("ts").alias("created_at"))
    return op.recent_hashes(e, src.papers(spark, sf_dir)).select("key", "paper_id", "filename")
