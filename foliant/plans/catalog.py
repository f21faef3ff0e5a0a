from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import catalog as op
from foliant.plans.registry import query
from foliant.sources import tables as src


@query("SELECT * FROM region")
def scan_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "region")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 7")
def paper_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.lookup(src.table(spark, sf_dir, "documents"), doc_id=7).select("doc_id", "lang", "source", "n_chars")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE md5(text) = (SELECT md5(text) FROM documents WHERE doc_id = 7)")
def content_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = src.table(spark, sf_dir, "documents").withColumn("content_id", F.md5("text"))
    key = op.lookup(docs, doc_id=7).select("content_id")
    return docs.join(key, "content_id", "left_semi").select("doc_id", "lang")


@query("SELECT doc_id, coalesce(text, '') AS text, coalesce(length(text), 0) AS text_length FROM documents")
def paper_text_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.text_view(src.papers(spark, sf_dir))


@query("""
SELECT d.doc_id, source || '_' || d.doc_id || '.pdf' AS filename, lang, quality
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
WHERE contains(lower(source || '_' || d.doc_id || '.pdf'), 'src1') AND lang = 'en' AND quality = 1
ORDER BY d.doc_id DESC LIMIT 20 OFFSET 5
""")
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = src.papers(spark, sf_dir).join(src.metadata(spark, sf_dir), F.col("doc_id") == F.col("paper_id"))
    both = both.where(op.holds(F.col("filename"), "SRC1") & (F.col("lang") == "en") & (F.col("quality") == 1))
    return op.page_of(both, F.desc("created_at"), "doc_id", limit=20, offset=5).select("doc_id", "filename", "lang", "quality")


@query("""
SELECT doc_id, filename FROM (SELECT doc_id, source || '_' || doc_id || '.pdf' AS filename FROM documents)
WHERE contains(lower(filename), '_9') ORDER BY doc_id DESC LIMIT 50
""")
def newest_by_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = src.papers(spark, sf_dir).where(op.holds(F.col("filename"), "_9"))
    return op.page_of(found, F.desc("created_at"), "doc_id", limit=50).select("doc_id", "filename")


@query("""
SELECT count(*) AS total_papers, count(l.doc_id) AS papers_with_metadata, count(v.vec_id) AS papers_with_embedding, count(c.conv_id) AS papers_with_pages,
  round(count(l.doc_id) * 100.0 / count(*), 6) AS metadata_rate, round(count(v.vec_id) * 100.0 / count(*), 6) AS embedding_rate, round(count(c.conv_id) * 100.0 / count(*), 6) AS pages_rate
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)
LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) v ON v.vec_id = d.doc_id LEFT JOIN (SELECT DISTINCT conv_id FROM conversations) c ON c.conv_id = d.doc_id
""")
def coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = src.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("paper_id"))
    return op.coverage(op.present(src.papers(spark, sf_dir), metadata=src.metadata(spark, sf_dir), embedding=vectors, pages=src.pages(spark, sf_dir)))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "documents").join(src.table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_join_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "documents").join(src.table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("""
SELECT d.doc_id, l.doc_id IS NULL AS quality_pending, coalesce(l.quality, 0) <> 1 AS layout_pending, coalesce(l.toxic, 0) <> 1 AND d.text <> '' AS llm_pending
FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE l.doc_id IS NULL OR coalesce(l.quality, 0) <> 1 OR (coalesce(l.toxic, 0) <> 1 AND d.text <> '')
""")
def pending_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = src.table(spark, sf_dir, "documents").join(src.table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True)), "doc_id", "left")
    return op.pending(docs.select("doc_id", "text", F.col("labelled").alias("quality_done"), (F.col("quality") == 1).alias("layout_done"), (F.col("toxic") == 1).alias("llm_done")))


@query("""
SELECT count(*) FILTER (l.doc_id IS NULL) AS quality_pending, count(*) FILTER (coalesce(l.quality, 0) <> 1) AS layout_pending,
  count(*) FILTER (coalesce(l.toxic, 0) <> 1 AND d.text <> '') AS llm_pending
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def pending_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending_tasks(spark, sf_dir).agg(*[F.count_if(c).alias(c) for c in ("quality_pending", "layout_pending", "llm_pending")])


@query("SELECT model_name, n, round(n * 100.0 / sum(n) OVER (), 6) AS share FROM (SELECT role AS model_name, count(*) AS n FROM conversations GROUP BY 1)")
def model_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.distribution(src.pages(spark, sf_dir), "model_name")


@query("""
SELECT d.doc_id, d.lang, l.quality, coalesce(p.pages, 0) AS n_pages, coalesce(p.first_page, '') AS first_page
FROM documents d LEFT JOIN labels l USING (doc_id)
LEFT JOIN (SELECT conv_id, count(*) AS pages, arg_min(text, turn) AS first_page FROM conversations GROUP BY 1) p ON p.conv_id = d.doc_id
""")
def paper_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.detail(src.papers(spark, sf_dir), src.pages(spark, sf_dir), metadata=src.metadata(spark, sf_dir))
    first = F.coalesce(F.get("pages", F.lit(0))["page_text"], F.lit(""))
    return found.select("doc_id", "lang", F.col("metadata.quality").alias("quality"), F.coalesce(F.size("pages"), F.lit(0)).cast("long").alias("n_pages"), first.alias("first_page"))


@query("""
SELECT d.doc_id, coalesce(v.label, l.quality) AS label, CASE WHEN v.label IS NOT NULL THEN 'first' WHEN l.quality IS NOT NULL THEN 'second' END AS origin
FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def embedding_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = src.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("paper_id"), F.array("label").alias("label"))
    second = src.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id"), F.array("quality").alias("label"))
    found = op.with_fallback(src.papers(spark, sf_dir), first, second, "label")
    return found.select("doc_id", F.get("label", F.lit(0)).alias("label"), "origin")


@query("""
SELECT conv_id AS paper_id, (turn + 1)::INTEGER AS page_number, (lag(turn) OVER w + 1)::INTEGER AS prev_page, (lead(turn) OVER w + 1)::INTEGER AS next_page,
  row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS total_pages
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def page_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.neighbours(src.pages(spark, sf_dir))


@query("""
SELECT conv_id AS paper_id, count(*) AS n_pages, min(n) AS min_length, max(n) AS max_length, round(avg(n))::BIGINT AS avg_length
FROM (SELECT conv_id, coalesce(length(text), 0) AS n FROM conversations) GROUP BY 1
""")
def page_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.page_lengths(src.pages(spark, sf_dir))


@query("SELECT (turn + 1)::INTEGER AS page_number, text AS page_text FROM conversations WHERE conv_id = 3 ORDER BY turn")
def pages_of_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.lookup(src.pages(spark, sf_dir), paper_id=3).orderBy("page_number").select("page_number", "page_text")


@query("SELECT conv_id AS paper_id, string_agg(text, chr(10) ORDER BY turn) AS ocr_text FROM conversations GROUP BY 1")
def whole_text_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "page_text")))
    whole = src.pages(spark, sf_dir).groupBy("paper_id").agg(ordered.alias("p"))
    return whole.select("paper_id", F.array_join(F.transform("p", lambda x: x["page_text"]), "\n").alias("ocr_text"))


@query("""
SELECT 'documents' AS collection, count(*) AS n, count(DISTINCT doc_id) AS papers, CASE WHEN count(*) > 0 THEN 'healthy' ELSE 'empty' END AS status FROM documents
UNION ALL SELECT 'pages', count(*), count(DISTINCT conv_id), CASE WHEN count(*) > 0 THEN 'healthy' ELSE 'empty' END FROM conversations
UNION ALL SELECT 'vectors', count(*), count(DISTINCT vec_id), CASE WHEN count(*) > 0 THEN 'healthy' ELSE 'empty' END FROM embeddings
""")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(df: DataFrame, name: str, key: str) -> DataFrame:
        return df.agg(F.lit(name).alias("collection"), F.count("*").alias("n"), F.count_distinct(key).alias("papers"), F.when(F.count("*") > 0, "healthy").otherwise("empty").alias("status"))

    return one(src.papers(spark, sf_dir), "documents", "doc_id").union(one(src.pages(spark, sf_dir), "pages", "paper_id")).union(one(src.table(spark, sf_dir, "embeddings"), "vectors", "vec_id"))
