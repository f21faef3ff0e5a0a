"""Stores as a whole: vectors as bytes, searches by text, backups of several tables, files of listings, pages put in anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import security
from foliant.operators import backups, duplicates, maintenance, rereading, vectors, versions
from foliant.plans.duplicates import TRIM
from foliant.plans.registry import query
from foliant.session import scratch
from foliant.sources import documents, files, scorers
from foliant.sources import tables as src

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(texts: list[str]) -> list[list[float]]:
    """What stands in for a model, so that searches have vectors: how often each letter comes."""
    return [[float(t.count(c)) for c in LETTERS] for t in texts]


def _counts(text: str) -> str:
    return f"list_transform(string_split('{','.join(LETTERS)}', ','), lambda c: (length({text}) - length(replace({text}, c, '')))::DOUBLE)"


PAGES = f"(SELECT conv_id, turn, {_counts('text')} AS v FROM conversations WHERE text IS NOT NULL)"


def page_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = src.pages(spark, sf_dir).select((F.col("paper_id") * 1000 + F.col("page_number")).alias("vec_id"), "page_text")
    return scorers.embedded(pages, "vec_id", "page_text", letter_counts, len(LETTERS))


@query(f"SELECT conv_id * 1000 + turn + 1 AS vec_id, list_sum(v) AS letters, v[5] AS e FROM {PAGES}")
def page_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_vectors(spark, sf_dir).select("vec_id", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("letters"), F.get("v", F.lit(4)).alias("e"))


ASKED = "the shells of ancient seas"


@query(f"""
SELECT vec_id, round(s, 6) AS similarity FROM (SELECT conv_id * 1000 + turn + 1 AS vec_id, coalesce(list_inner_product(v, q) / nullif(sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q)), 0), 0) AS s
  FROM {PAGES}, (SELECT {_counts(f"'{ASKED}'")} AS q)) ORDER BY s DESC, vec_id LIMIT 10
""")
def text_search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorers.text_search(page_vectors(spark, sf_dir), ASKED, letter_counts).withColumn("similarity", F.round("similarity", 6))


@query("SELECT vec_id, 256 AS bytes, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, NULL::VARCHAR AS error FROM embeddings UNION ALL SELECT -1, 12, NULL, 'length'")
def vectors_as_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").unionByName(spark.createDataFrame([(-1, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>"))
    stored = vectors.serialised(rows, "vec_id", "embedding")
    back = vectors.deserialised(stored, 64).withColumnRenamed("key", "k")
    total = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    both = stored.join(back, F.col("key") == F.col("k"))
    return both.select(F.col("key").alias("vec_id"), F.octet_length("data").alias("bytes"), F.round(total, 6).alias("total"), "error")


COPIES = "(SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT vec_id + 1000000, embedding::DOUBLE[] FROM embeddings WHERE vec_id % 4 = 0)"


@query(f"""
WITH v AS {COPIES}, f AS (SELECT v, min(vec_id) AS d FROM v GROUP BY 1), same AS (SELECT vec_id, d FROM v JOIN f USING (v) WHERE vec_id <> d), rest AS (SELECT * FROM v WHERE vec_id NOT IN (SELECT vec_id FROM same)),
p AS (SELECT a.vec_id, b.vec_id AS other, list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) AS s FROM rest a JOIN rest b ON a.vec_id <> b.vec_id)
SELECT vec_id, d AS duplicate_of, 'content_id' AS method FROM same UNION ALL
SELECT vec_id, other, 'vector' FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other) AS r FROM p) WHERE r = 1 AND s >= 0.4
""")
def content_level_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = src.vectors(spark, sf_dir).select("vec_id", "v")
    rows = own.unionByName(own.where("vec_id % 4 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000))
    return vectors.content_duplicates(rows, duplicates.vector_digest(rows, "vec_id", "v"), 0.4)


BUCKETS = 16
PARTS_OF = "(SELECT count(DISTINCT {key} % 16) FROM {table} WHERE {where})"
P = lambda key, table, where="true": PARTS_OF.format(key=key, table=table, where=where)


def bucket(key: str) -> Column:
    """The partition of a row in the stores here."""
    return F.pmod(F.col(key), F.lit(BUCKETS))


def changed(docs: DataFrame) -> DataFrame:
    """Documents of one partition with another text."""
    return docs.withColumn("text", F.when(F.col("doc_id") % BUCKETS == 5, F.concat(F.lit("anew: "), F.col("text"))).otherwise(F.col("text")))


@query(f"""
SELECT 'documents' AS store, 'full' AS kind, (SELECT count(*) FROM documents) AS rows, {P("doc_id", "documents")} AS written, true AS sound, (SELECT count(*) FROM documents) AS restored UNION ALL
SELECT 'vectors', 'full', (SELECT count(*) FROM embeddings), {P("vec_id", "embeddings")}, true, (SELECT count(*) FROM embeddings) UNION ALL
SELECT 'documents', 'incremental', (SELECT count(*) FROM documents), {P("doc_id", "documents", "doc_id % 16 = 5")}, true, (SELECT count(*) FROM documents)
""")
def coordinated_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both stores written, verified and read back; the incremental run, after a change of one partition, writes that one and leaves the vectors out."""
    docs, vecs = src.table(spark, sf_dir, "documents"), src.table(spark, sf_dir, "embeddings")
    folder, out = scratch(spark, "backup"), []
    parts = {"documents": bucket("doc_id"), "vectors": bucket("vec_id")}
    for kind, now in (("full", docs), ("incremental", changed(docs))):
        for entry in backups.write_stores({"documents": now, "vectors": vecs}, folder, f"{kind}_1", kind, parts):
            out.append((entry["store"], kind, entry["rows"], entry["written"], backups.verify(spark, entry), versions.read(spark, entry["path"], entry["version"]).count()))
    return spark.createDataFrame(out, "store string, kind string, rows long, written long, sound boolean, restored long")


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def restored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they were before a change that a restore took back."""
    docs = src.table(spark, sf_dir, "documents")
    folder = scratch(spark, "restore")
    entry = backups.write_backup(docs, folder, "first", part=bucket("doc_id"))
    backups.restore(spark, entry, changed(docs), bucket("doc_id"))
    return versions.read(spark, folder).select("doc_id", F.md5("text").alias("digest"))


@query(f"""
WITH n AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 16 <> 3) AS kept, {P("doc_id", "documents")} AS parts, {P("doc_id", "documents", "doc_id % 16 <> 3")} AS kept_parts, {P("doc_id", "documents", "doc_id % 16 = 5")} AS changed FROM documents)
SELECT 1 AS v, 'first' AS note, parts AS partitions, n::BIGINT AS rows, parts AS written FROM n UNION ALL SELECT 2, 'changed', parts, n, changed FROM n UNION ALL
SELECT 3, '', kept_parts, kept, 0 FROM n UNION ALL SELECT 4, 'before the restore of version 1', kept_parts, kept, 0 FROM n UNION ALL SELECT 5, 'restored from version 1', parts, n, 0 FROM n
""")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written, changed, rid of one partition's rows and restored: what each version holds, and what it had to write."""
    docs, folder, part = src.table(spark, sf_dir, "documents"), scratch(spark, "versions"), bucket("doc_id")
    versions.commit(docs, folder, part, note="first")
    versions.commit(changed(docs), folder, part, note="changed")
    versions.merge(docs.limit(0), folder, "doc_id", part, gone=docs.where(F.col("doc_id") % BUCKETS == 3).select("doc_id"))
    versions.restore(versions.read(spark, folder), folder, part, 1)
    return versions.history(spark, folder)


@query("SELECT conv_id AS paper_id, turn + 1 AS page_number, CASE WHEN conv_id % 3 = 0 THEN 'anew: ' || text ELSE text END AS page_text FROM conversations WHERE conv_id % 7 <> 1")
def reread_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages recognised anew replace a document's old ones; another document's pages are deleted."""
    pages = src.pages(spark, sf_dir).select("paper_id", "page_number", "page_text")
    fresh = pages.where("paper_id % 3 = 0").withColumn("page_text", F.concat(F.lit("anew: "), F.col("page_text")))
    kept = maintenance.replace_group(pages, fresh, "paper_id")
    gone = pages.where("paper_id % 7 = 1").select("paper_id")
    return maintenance.delete_group(kept, gone, "paper_id").withColumn("page_number", F.col("page_number").cast("long"))


@query("SELECT conv_id AS paper_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS whole, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (turn < 2)) AS first FROM conversations GROUP BY 1")
def reread_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a document from its pages, and that of its first two, from which its metadata are read anew."""
    page = F.struct("page_number", "page_text")
    joined = lambda c: F.md5(F.array_join(F.transform(F.array_sort(c), lambda p: p["page_text"]), "\n\n"))
    by = src.pages(spark, sf_dir).groupBy("paper_id")
    return by.agg(joined(F.collect_list(page)).alias("whole"), joined(F.collect_list(F.when(F.col("page_number") <= 2, page))).alias("first"))


def _vector_sql(text: str) -> str:
    return _counts(f"coalesce({text}, '')")


NEW_PAGES = "(SELECT conv_id, turn + 1 AS page, CASE conv_id % 5 WHEN 1 THEN ' ' WHEN 2 THEN text || ' anew and more of it' ELSE substr(text, 1, length(text) // 3) END AS new FROM conversations WHERE conv_id % 2 = 0 UNION ALL SELECT DISTINCT conv_id, 1000, 'one more page' FROM conversations WHERE conv_id % 2 = 0)"


def _page_store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages with their vectors, and new readings of those of half the papers, each with a page more."""
    pages = src.pages(spark, sf_dir).select("paper_id", "page_number", "page_text")
    keyed = pages.select(F.struct("paper_id", "page_number").alias("page"), "page_text")
    stored = keyed.join(scorers.embedded(keyed, "page", "page_text", letter_counts, len(LETTERS)), "page").select("page.*", "page_text", "v")
    even, kind, text = pages.where("paper_id % 2 = 0"), F.col("paper_id") % 5, F.col("page_text")
    shorter = F.expr("substring(page_text, 1, cast(floor(length(page_text) / 3) AS int))")
    new = F.when(kind == 1, " ").when(kind == 2, F.concat(text, F.lit(" anew and more of it"))).otherwise(shorter)
    more = even.select("paper_id").distinct().select("paper_id", F.lit(1000).alias("page_number"), F.lit("one more page").alias("page_text"))
    return stored, even.withColumn("page_text", new).unionByName(more)


@query(f"""
WITH n AS (SELECT * FROM {NEW_PAGES} WHERE length(trim(new, {TRIM})) > 0), b AS (SELECT coalesce(o.conv_id, n.conv_id) AS paper_id, coalesce(o.turn + 1, n.page) AS page_number, text AS old, new FROM conversations o FULL JOIN n ON o.conv_id = n.conv_id AND o.turn + 1 = n.page)
SELECT paper_id, page_number::BIGINT AS page_number, md5(coalesce(new, old)) AS digest, array_to_string(list_transform({_vector_sql("coalesce(new, old)")}, lambda y: y::BIGINT), ',') AS v FROM b
""")
def reread_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page store after pages were read anew: their texts and vectors replaced together, new pages added, blank readings left alone."""
    stored, _ = rereading.reread(*_page_store(spark, sf_dir), letter_counts, len(LETTERS))
    return stored.select("paper_id", F.col("page_number").cast("long").alias("page_number"), F.md5("page_text").alias("digest"), F.array_join(F.col("v").cast("array<long>").cast("array<string>"), ",").alias("v"))


WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda y: y <> ''))"


@query(rf"""
WITH b AS (SELECT o.conv_id AS paper_id, n.page AS page_number, coalesce(o.text, '') AS old, new, {_vector_sql("o.text")} AS ov, {_vector_sql("new")} AS nv FROM {NEW_PAGES} n JOIN conversations o ON o.conv_id = n.conv_id AND o.turn + 1 = n.page WHERE length(trim(new, {TRIM})) > 0),
m AS (SELECT *, {WORDS.format('old')} AS ow, {WORDS.format('new')} AS nw, len(list_distinct(string_split(old, ''))) AS ou, len(list_distinct(string_split(new, ''))) AS nu, CASE WHEN list_sum(ov) = 0 OR list_sum(nv) = 0 THEN 0 ELSE list_cosine_similarity(ov, nv) END AS cosine FROM b),
s AS (SELECT *, CASE WHEN length(old) > 0 THEN CASE WHEN nw > ow THEN 30 ELSE 0 END + CASE WHEN length(new) * 1.0 / length(old) BETWEEN 0.8 AND 1.2 THEN 20 ELSE 0 END + CASE WHEN nu > ou THEN 20 ELSE 0 END + CASE WHEN ow = 0 OR abs((nw - ow) * 100.0 / ow) < 50 THEN 30 ELSE 0 END END AS score FROM m),
a AS (SELECT *, CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 70 THEN 'improved' WHEN score >= 40 THEN 'similar' ELSE 'degraded' END AS assessment FROM s)
SELECT paper_id, page_number::BIGINT AS page_number, score, assessment, round(cosine, 9) AS cosine, CASE WHEN cosine > 0.95 AND assessment = 'similar' THEN 'minimal_change' WHEN cosine > 0.85 AND assessment = 'improved' THEN 'minor_improvement' WHEN cosine < 0.85 AND assessment = 'improved' THEN 'significant_improvement' WHEN assessment = 'degraded' THEN 'quality_degraded' ELSE 'changed' END AS overall FROM a
UNION ALL SELECT DISTINCT conv_id, 1000::BIGINT, NULL, 'unknown', NULL, 'embedding_unavailable' FROM conversations WHERE conv_id % 2 = 0
""")
def reread_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page read anew changed, in its text and in its vector; a page that wasn't stored has no vector to compare."""
    _, report = rereading.reread(*_page_store(spark, sf_dir), letter_counts, len(LETTERS))
    r = lambda path: F.col(f"report.{path}")
    return report.select("paper_id", F.col("page_number").cast("long").alias("page_number"), r("text.score").alias("score"), r("text.assessment").alias("assessment"), F.round(r("vector.cosine"), 9).alias("cosine"), r("overall").alias("overall"))


@query(f"""
WITH w AS (SELECT conv_id AS paper_id, string_agg(coalesce(new, text), chr(10) || chr(10) ORDER BY turn) || CASE WHEN conv_id % 2 = 0 THEN chr(10) || chr(10) || 'one more page' ELSE '' END AS whole FROM (SELECT o.*, n.new FROM conversations o LEFT JOIN {NEW_PAGES} n ON o.conv_id = n.conv_id AND o.turn + 1 = n.page AND length(trim(new, {TRIM})) > 0) GROUP BY 1)
SELECT paper_id, CASE WHEN paper_id % 2 = 0 THEN md5(whole) ELSE md5('') END AS digest, CASE WHEN paper_id % 2 = 0 THEN array_to_string(list_transform({_vector_sql("whole")}, lambda y: y::BIGINT), ',') ELSE '0' END AS v FROM w
""")
def reread_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and vectors of papers made anew from their pages where those were read anew; the others' empty ones stay."""
    pages, fresh = _page_store(spark, sf_dir)
    papers = pages.select("paper_id").distinct().select("paper_id", F.lit("").alias("text"), F.array(F.lit(0.0)).alias("v"))
    stored, _ = rereading.reread(pages, fresh, letter_counts, len(LETTERS))
    made = rereading.papers_again(stored, fresh, papers, letter_counts, len(LETTERS))
    return made.select("paper_id", F.md5("text").alias("digest"), F.array_join(F.col("v").cast("array<long>").cast("array<string>"), ",").alias("v"))


@query(f"SELECT conv_id AS paper_id, turn + 1 AS page_number, CASE WHEN conv_id % 3 = 0 THEN array_to_string(list_transform({_vector_sql('text')}, lambda y: y::BIGINT), ',') ELSE '0' END AS v FROM conversations")
def regenerated_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all pages of some papers made anew from their texts, in place of those stored."""
    pages = src.pages(spark, sf_dir).select("paper_id", "page_number", "page_text").withColumn("v", F.array(F.lit(0.0)))
    made = rereading.pages_again(pages, pages.where("paper_id % 3 = 0"), letter_counts, len(LETTERS))
    return made.select("paper_id", F.col("page_number").cast("long").alias("page_number"), F.array_join(F.col("v").cast("array<long>").cast("array<string>"), ",").alias("v"))


@query("""
SELECT conv_id AS paper_id, feature, string_agg(turn + 1, ',' ORDER BY turn) AS pages FROM (
  SELECT conv_id, turn, unnest(['javascript', 'form', 'attachment', 'encrypted']) AS feature, unnest([contains(text, 'an'), contains(text, 'the'), contains(text, 'q'), contains(text, 'er')]) AS hit FROM conversations WHERE turn < 3)
WHERE hit GROUP BY 1, 2
""")
def page_feature_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risky features of the first three pages; what stands for their marks are groups of letters."""
    marks = {"an": "/JS", "the": "/XFA", "q": "/EmbeddedFile", "er": "/Encrypt"}
    said = F.concat_ws(" ", *[F.when(F.contains("page_text", F.lit(letters)), mark) for letters, mark in marks.items()])
    pages = src.pages(spark, sf_dir).withColumn("page_text", said)
    listed = pages.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "page_text"))), lambda p: p["page_text"]).alias("pages"))
    found = listed.select("paper_id", F.explode(security.page_features(F.col("pages"), 3)).alias("f"))
    return found.select("paper_id", "f.feature", F.array_join(F.col("f.pages").cast("array<string>"), ",").alias("pages"))


@query(f"""
WITH p AS (SELECT conv_id, list(trim(coalesce(text, ''), {TRIM}) ORDER BY turn) AS p FROM conversations WHERE turn < 2 GROUP BY 1)
SELECT conv_id AS doc_id, md5(CASE WHEN p[1] = '' THEN '' ELSE trim('[PAGE 1]' || chr(10) || p[1] || CASE WHEN len(p) > 1 AND p[2] <> '' THEN chr(10) || chr(10) || '[PAGE 2]' || chr(10) || p[2] ELSE '' END, {TRIM}) END) AS digest FROM p
""")
def first_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = src.pages(spark, sf_dir).where("page_number <= 2").groupBy(F.col("paper_id").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "page_text"))), lambda p: p["page_text"]).alias("pages"))
    return pages.select("doc_id", F.md5(files.page_blocks(F.col("pages"))).alias("digest"))


def _pages_of(content: bytes) -> list[str]:
    return [p.strip() for p in content.decode().split("\f")]


def _as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of two pages."""
    docs = src.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.col("text"), F.lit("\f second page of "), F.col("lang")).cast("binary").alias("content"))
    return docs.withColumn("length", F.octet_length("content").cast("long"))


@query("""
SELECT doc_id::VARCHAR AS path, i AS page_number, md5(CASE WHEN i = 1 THEN trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(13)) ELSE 'second page of ' || lang END) AS digest, NULL::VARCHAR AS error
FROM documents, (SELECT unnest([1, 2]) AS i) WHERE octet_length(encode(text)) + 17 + length(lang) <= 20000
UNION ALL SELECT doc_id::VARCHAR, NULL, NULL, 'too_large' FROM documents WHERE octet_length(encode(text)) + 17 + length(lang) > 20000
""")
def file_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.page_texts(_as_files(spark, sf_dir), _pages_of, 20_000)
    return found.select("path", "page_number", F.md5("text").alias("digest"), "error")


@query("""
SELECT doc_id::VARCHAR AS path, 'T' AS title, NULL::VARCHAR AS author, 2 AS page_count,
  md5(trim(CASE WHEN length(t) > 5000 THEN substr(t, 1, 5000) || '...' ELSE t END, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS digest
FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(13)) || chr(10) || 'second page of ' || lang || chr(10) AS t FROM documents)
""")
def file_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = files.file_info(_as_files(spark, sf_dir), lambda content: {"title": "T", "pages": _pages_of(content)})
    return info.select("path", "title", "author", "page_count", F.md5("text").alias("digest"))


def document_files(spark: SparkSession, sf_dir: str) -> str:
    """Documents as files of pages in a scratch folder; the folder."""
    folder = scratch(spark, "files")
    known = lambda c: F.coalesce(c, F.lit(""))
    head = F.concat(F.lit("%Title: "), known("source"), F.lit("\n%Author: "), known("lang"), F.lit("\n"))
    whole = F.concat(head, known("text"), F.lit("\fsecond page of "), known("lang"), F.lit("\f\f"))
    rows = src.table(spark, sf_dir, "documents").select("doc_id", whole.alias("value"))
    files.write_texts(rows, "doc_id", "value", folder)
    spark.dataSource.register(documents.DocumentFiles)
    return folder


NAME = "doc_id || '.txt'"
SIZE = "octet_length(encode(coalesce(text, '') || coalesce(source, '') || coalesce(lang, '') || coalesce(lang, ''))) + 37"


@query(f"""
SELECT {NAME} AS name, i AS page_number, md5(CASE i WHEN 1 THEN trim(coalesce(text, ''), {TRIM}) WHEN 2 THEN trim('second page of ' || coalesce(lang, '')) ELSE '' END) AS digest, NULL::VARCHAR AS error
FROM documents, (SELECT unnest([1, 2, 3, 4]) AS i) WHERE {SIZE} <= 20000
UNION ALL SELECT {NAME}, NULL, NULL, 'too_large' FROM documents WHERE {SIZE} > 20000
""")
def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of documents read page by page; those of more than 20,000 bytes are not."""
    found = spark.read.format("documents").option("maxBytes", 20_000).option("partitionBytes", 1 << 20).load(document_files(spark, sf_dir))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "page_number", F.md5("text").alias("digest"), "error")


@query(f"""
SELECT {NAME} AS name, coalesce(source, '') AS title, coalesce(lang, '') AS author, NULL::VARCHAR AS creator, 4 AS page_count, md5(trim(CASE WHEN length(t) > 5000 THEN substr(t, 1, 5000) || '...' ELSE t END, {TRIM})) AS digest
FROM (SELECT *, coalesce(text, '') || chr(10) || 'second page of ' || coalesce(lang, '') || chr(10) || chr(10) AS t FROM documents)
""")
def document_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.read.format("documents").option("detail", "files").load(document_files(spark, sf_dir))
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    return found.select(name, "title", "author", "creator", "page_count", F.md5(duplicates.first_pages_text(F.col("pages"))).alias("digest"))


@query("SELECT conv_id AS paper_id, 3 AS saved, count(*) AS stored FROM conversations GROUP BY 1")
def saved_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hashes of a document stored, with how many of the three kinds could be."""
    pages = src.pages(spark, sf_dir)
    kinds = {"file": F.md5("page_text"), "content": F.sha2("page_text", 256), "sample": F.md5(F.substring("page_text", 1, 10))}
    made = pages.select("paper_id", *[k.isNotNull().alias(n) for n, k in kinds.items()])
    return maintenance.saved_kinds(made, "paper_id", tuple(kinds))


@query("SELECT 20 AS jobs, (SELECT count(*) FROM events) AS total, 8 AS cores, (SELECT max(event_id) FROM (SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1)) AS newest")
def job_export_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = src.jobs(spark, sf_dir).select("job_id", "created_at", "status")
    made = files.export_record(jobs, spark.range(1).select(F.lit(8).alias("cores")), jobs.agg(F.count("*").alias("total")), 20)
    said = F.from_json("value", "jobs array<struct<job_id:long>>, system struct<cores:int>, statistics struct<total:long>")
    return made.select(said.alias("s")).select(F.size("s.jobs").alias("jobs"), "s.statistics.total", "s.system.cores", F.get("s.jobs", F.lit(0))["job_id"].alias("newest"))


@query("SELECT event_id || '.tmp' AS name, 'b' || event_id AS stem FROM events WHERE ts < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def old_temporary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = src.events(spark, sf_dir).select(F.concat(F.col("event_id").cast("string"), F.lit(".tmp")).alias("name"), F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("stem"), F.col("ts").alias("modified"))
    return files.old_files(listed, F.lit(src.AS_OF).cast("timestamp"), 7).select("name", "stem")


@query(f"""
SELECT conv_id AS doc_id, CASE WHEN trim(a, {TRIM}) = '' THEN '' ELSE '[FONT_SIZE:18]' || chr(10) || trim(a, {TRIM}) || chr(10) || chr(10) END || '[FONT_SIZE:10]' || chr(10) || 'body' || chr(10) || 'more' AS marked
FROM (SELECT conv_id, coalesce(arg_min(substr(text, 1, 20), turn), '') AS a FROM conversations GROUP BY 1)
""")
def size_marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = src.pages(spark, sf_dir).groupBy(F.col("paper_id").alias("doc_id")).agg(F.min_by(F.substring("page_text", 1, 20), "page_number").alias("t"))
    line = lambda size, text: F.struct(F.lit(size).alias("size"), text.alias("text"))
    spans = F.array(line(18.0, F.coalesce("t", F.lit(""))), line(10.0, F.lit("body")), line(11.0, F.lit("more")))
    return first.select("doc_id", files.size_marks(spans).alias("marked"))
