from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import extract as fn
from foliant.operators import records as op
from foliant.plans.registry import query
from foliant.sources import tables as src

#: Rows beside the documents that hold what no document does.
EXTRA = (
    (-1, "A Study of Ancient Shells and Seas\nby Ann Lee, Bo Chan\nAbstract: We measure shells from many seas over many years and report what they tell us.\n\nKeywords: shells"),
    (-2, "Vol. 3 No. 2 | page 7\nOn the growth of trilobites in warm\nwater of the past\nAuthors: C. Oh, D. Poe\nyears 1999 2003 2021 2019\nsee 10.1234/abc.1, next doi: 10.5555/xyz"),
    (-3, "short"),
)


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


ROWS = "(SELECT doc_id, text FROM documents UNION ALL VALUES " + ", ".join(f"({i}, {_quote(t)})" for i, t in EXTRA) + ")"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(list(EXTRA), "doc_id long, text string"))


@query(f"SELECT doc_id, nullif(regexp_extract(substr(text, 1, 3000), '{fn.EMAIL}'), '') AS email FROM {ROWS}")
def extract_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("doc_id", fn.email(F.col("text")).alias("email"))


@query(rf"""
SELECT doc_id, nullif(regexp_extract(substr(text, 1, 2000), '\b(20\d{{2}})\b', 1), '')::INTEGER AS first_year,
  list_max(list_filter(list_transform(regexp_extract_all(text, '\b(19\d\d|20[0-3]\d)\b', 1), lambda y: y::INTEGER), lambda y: y BETWEEN 1980 AND 2030)) AS latest_year FROM {ROWS}
""")
def extract_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("doc_id", fn.first_year(F.col("text")).alias("first_year"), fn.latest_year(F.col("text")).alias("latest_year"))


@query(rf"SELECT doc_id, nullif(regexp_extract(substr(text, 1, 2000), '10\.\d{{4,}}/\S+'), '') AS bare, nullif(regexp_extract(text, '(?i)doi:?\s*(10\.\d+/\S+)', 1), '') AS marked FROM {ROWS}")
def extract_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("doc_id", fn.bare_doi(F.col("text")).alias("bare"), fn.marked_doi(F.col("text")).alias("marked"))


@query(rf"""
SELECT doc_id, list_filter(list_transform(string_split(text, chr(10))[1:50], lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')), lambda t: length(t) > 20 AND NOT regexp_matches(t, '^(Abstract|Keywords|1\.|I\.)'))[1] AS title FROM {ROWS}
""")
def extract_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("doc_id", fn.first_title(F.col("text")).alias("title"))


@query()
def extract_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fn.record(F.col("text"))
    names = ("title", "year", "doi", "email", "abstract")
    return rows(spark, sf_dir).select("doc_id", F.explode(F.array(r)).alias("r")).select("doc_id", *[F.col(f"r.{n}").alias(n) for n in names], F.array_join("r.authors", "; ").alias("authors"))


@query(rf"""
SELECT doc_id, CASE WHEN length(b) > 50 THEN substr(b, 1, 500) END AS abstract FROM (SELECT doc_id, trim(regexp_extract(text, '(?is)Abstract[:\s]+(.+?)(?:\n\n|Keywords|1\.|Introduction)', 1)) AS b FROM {ROWS})
""")
def extract_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("doc_id", fn.abstract(F.col("text")).alias("abstract"))


@query("""
SELECT event_id, coalesce((props->>'k')::DOUBLE, 50) AS readability_score, 'unknown' AS overall_quality FROM events
""")
def llm_json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.lit("The answer is:\n"), F.regexp_replace("props", '"k"', '"readability_score"'), F.lit("\nDone."))
    r = fn.quality_record(answer)
    return src.table(spark, sf_dir, "events").select("event_id", r["readability_score"].alias("readability_score"), r["overall_quality"].alias("overall_quality"))


@query("""
SELECT doc_id, len(names) AS n_names, array_to_string(names, '/') AS names FROM (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(trim(x), '[,;]|and'), lambda n: trim(n)), lambda n: n <> '') AS names FROM (SELECT doc_id, source || ', ' || lang || '; Ann and ' || n_chars AS x FROM documents))
""")
def list_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = fn.name_list(F.concat("source", F.lit(", "), "lang", F.lit("; Ann and "), F.col("n_chars").cast("string")))
    return src.table(spark, sf_dir, "documents").select("doc_id", F.size(names).cast("long").alias("n_names"), F.array_join(names, "/").alias("names"))


@query("""
SELECT event_id, CASE event_type WHEN 'click' THEN 'good' WHEN 'error' THEN 'poor' WHEN 'view' THEN 'excellent' ELSE 'fair' END AS quality, CASE event_type WHEN 'click' THEN 70 WHEN 'error' THEN 30 WHEN 'view' THEN 85 ELSE 50 END AS score,
  CASE event_type WHEN 'error' THEN 'blurry_text,low_contrast' WHEN 'click' THEN 'image_noise' ELSE '' END AS issues FROM events
""")
def llm_text_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("event_type") == "click", "Readable, some NOISE").when(F.col("event_type") == "error", "Blurry and dark").when(F.col("event_type") == "view", "Excellent").otherwise("no idea")
    r = fn.quality_from_words(said)
    return src.table(spark, sf_dir, "events").select("event_id", r["quality"].alias("quality"), r["score"].alias("score"), F.array_join(r["issues"], ",").alias("issues"))


def json_model(prompts: list[str]) -> list[str]:
    """Stands for a model that answers in JSON; a fourth of its answers says nothing, a fourth is broken, and it fails at times."""
    kinds = [len(p) % 4 for p in prompts]
    if 3 in kinds:
        raise ValueError("no answer")
    said = ('Sure: {"title": " Title %d ", "authors": "A B; C D", "year": "2011", "doi": "10.1/x", "keywords": ["k1", "none", "k2"], "journal": 7, "abstract": "short"} done', "I cannot say", '{"title": broken')
    return [said[k] % len(p) if k == 0 else said[k] for k, p in zip(kinds, prompts, strict=True)]


def line_model(prompts: list[str]) -> list[str]:
    """Stands for a model that answers in lines with labels, or not at all."""
    if any(len(p) % 3 == 2 for p in prompts):
        raise ValueError("no answer")
    return ["Title: One\n Title: Plain Title: \nTitle:\nAuthors: X Y; Z;\nYear: about 1987\nYear: soon\nJournal: [journal/conference name]" if len(p) % 3 == 0 else "" for p in prompts]


BLANKS = r"'^\s+|\s+$', '', 'g'"


@query(rf"""
WITH r AS (SELECT *, length(regexp_replace(t, {BLANKS})) >= 100 AS long, length(substr(t, 1, CASE WHEN contains(t, '[FONT_SIZE:') THEN 5000 ELSE 4000 END)) AS n, length(substr(t, 1, 2000)) AS m FROM (SELECT doc_id, coalesce(text, '') AS t FROM {ROWS})),
k AS (SELECT *, CASE WHEN NOT long THEN 'none' WHEN n % 4 = 0 THEN 'structured_llm' WHEN m % 3 < 2 THEN 'fallback_llm' ELSE 'rule_based' END AS method FROM r),
b AS (SELECT *, regexp_replace(regexp_extract(t, '(?is)Abstract[:\s]+(.+?)(?:\n\n|Keywords|1\.|Introduction)', 1), {BLANKS}) AS body FROM k)
SELECT doc_id, method, long AS success, CASE WHEN NOT long THEN 'Text too short' END AS error,
  CASE method WHEN 'structured_llm' THEN 'Title ' || n WHEN 'fallback_llm' THEN CASE WHEN m % 3 = 0 THEN 'Plain' END WHEN 'rule_based' THEN
    list_filter(list_transform(string_split(t, chr(10))[1:50], lambda x: regexp_replace(x, {BLANKS})), lambda x: length(x) > 20 AND NOT regexp_matches(x, '^(Abstract|Keywords|1\.|I\.)'))[1] END AS title,
  CASE WHEN method = 'structured_llm' THEN 'A B/C D' WHEN method = 'fallback_llm' AND m % 3 = 0 THEN 'X Y/Z' ELSE '' END AS authors,
  CASE WHEN method = 'structured_llm' THEN 2011 WHEN method = 'fallback_llm' AND m % 3 = 0 THEN 1987 WHEN method = 'rule_based' THEN coalesce(nullif(regexp_extract(substr(t, 1, 2000), '\b(20\d{{2}})\b', 1), '')::INTEGER, 0) ELSE 0 END::INTEGER AS year,
  CASE method WHEN 'structured_llm' THEN '10.1/x' WHEN 'rule_based' THEN nullif(regexp_extract(substr(t, 1, 2000), '10\.\d{{4,}}/\S+'), '') END AS doi, CASE WHEN method = 'structured_llm' THEN 'k1/k2' ELSE '' END AS keywords,
  CASE WHEN method = 'rule_based' THEN nullif(regexp_extract(substr(t, 1, 3000), '{fn.EMAIL}'), '') END AS email, CASE WHEN method = 'rule_based' AND length(body) > 50 THEN substr(body, 1, 500) END AS abstract, NULL::VARCHAR AS journal FROM b
""")
def extraction_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all documents by two models, and by rules where both give none."""
    found = op.extracted(rows(spark, sf_dir), "text", json_model, line_model)
    names = ("title", "year", "doi", "email", "abstract", "journal")
    return found.select("doc_id", "method", "success", "error", *[F.col(f"record.{n}").alias(n) for n in names], *[F.array_join(f"record.{n}", "/").alias(n) for n in ("authors", "keywords")])


@query(rf"""
SELECT doc_id, 'rule_based_fallback' AS method, nullif(regexp_extract(text, '(?i)doi:?\s*(10\.\d+/\S+)', 1), '') AS doi,
  coalesce(list_max(list_filter(list_transform(regexp_extract_all(text, '\b(19\d\d|20[0-3]\d)\b', 1), lambda y: y::INTEGER), lambda y: y BETWEEN 1980 AND 2030)), 0)::INTEGER AS year FROM {ROWS}
""")
def extraction_without_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.extracted(rows(spark, sf_dir), "text").select("doc_id", "method", "record.doi", "record.year")
