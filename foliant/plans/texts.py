from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import texts as fn
from foliant.operators import languages
from foliant.plans.registry import query
from foliant.sources import scorers
from foliant.sources import tables as src


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "documents")


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s.,!?;:\-()]', ' ', 'g'))) AS cleaned FROM documents")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(fn.clean(F.col("text"))).alias("cleaned"))


@query(r"SELECT doc_id, md5(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 2000)) AS cut, least(2000, length(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS cut_length FROM documents")
def text_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fn.for_embedding(F.col("text"), 2000)
    return docs(spark, sf_dir).select("doc_id", F.md5(cut).alias("cut"), F.length(cut).cast("long").alias("cut_length"))


@query(r"""
SELECT doc_id, length(regexp_replace(text, '\s+', '', 'g')) AS solid, length(regexp_replace(text, '\s+', '', 'g')) < 100 AS needs_recognition, length(text) > 4000 AS chunked FROM documents
""")
def needs_ocr_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", fn.solid_length(t).cast("long").alias("solid"), fn.needs_recognition(t).alias("needs_recognition"), (F.length(t) > fn.CHUNK).alias("chunked"))


WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> ''))"


@query(rf"""
WITH p AS (SELECT conv_id, turn, text AS old, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS new FROM conversations),
m AS (SELECT conv_id, turn, length(old) AS oc, length(new) AS nc, {WORDS.format('old')} AS ow, {WORDS.format('new')} AS nw,
  len(list_distinct(regexp_split_to_array(old, ''))) AS ou, len(list_distinct(regexp_split_to_array(new, ''))) AS nu FROM p WHERE new IS NOT NULL AND old <> ''),
s AS (SELECT *, (CASE WHEN nw > ow THEN 30 ELSE 0 END + CASE WHEN nc::DOUBLE / oc BETWEEN 0.8 AND 1.2 THEN 20 ELSE 0 END + CASE WHEN nu > ou THEN 20 ELSE 0 END + CASE WHEN ow = 0 OR abs((nw - ow) * 100.0::DOUBLE / ow) < 50 THEN 30 ELSE 0 END) AS score FROM m)
SELECT conv_id, turn, oc AS old_chars, nc AS new_chars, ow AS old_words, nw AS new_words, ou AS old_unique_chars, nu AS new_unique_chars, score, CASE WHEN score >= 70 THEN 'improved' WHEN score >= 40 THEN 'similar' ELSE 'degraded' END AS assessment FROM s
""")
def text_quality_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = src.table(spark, sf_dir, "conversations").withColumn("new", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("new IS NOT NULL AND text <> ''")
    m = fn.quality_change(F.col("text"), F.col("new"))
    own = ("old_chars", "new_chars", "old_words", "new_words", "old_unique_chars", "new_unique_chars", "score", "assessment")
    return pairs.select("conv_id", "turn", *[m[n].alias(n) for n in own])


@query()
def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fn.chunks(docs(spark, sf_dir), "doc_id", "text").select("doc_id", "chunk_no", F.length("chunk").alias("length"), F.md5("chunk").alias("digest"))


@query(rf"SELECT doc_id, greatest(1, ceil({WORDS.format('text')} / 500.0))::BIGINT AS windows FROM documents")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.greatest(F.lit(1), F.ceil(fn.word_count(F.col("text")) / 500.0)).cast("long").alias("windows"))


CODES = "CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' ELSE 'eng' END"
ZERO = "round(CASE WHEN n_chars % 7 = 0 OR n_chars % 100 = 0 OR trim(text) = '' THEN 0.0::DOUBLE ELSE (n_chars % 100) / 100.0::DOUBLE * 0.4 + least(length(text) / 100.0::DOUBLE, 1) * 0.3 + 0.9::DOUBLE * 0.2 + CASE WHEN lang = c THEN 0.5::DOUBLE ELSE 0 END END, 6)"
TRIED = f"SELECT doc_id, c AS candidate, {ZERO} AS score FROM documents, (VALUES ('en'), ('fr'), ('de'), ('es')) t(c)"


def tried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document recognised in four languages; the confidence stands in for a recogniser's."""
    each = docs(spark, sf_dir).withColumn("candidate", F.explode(F.array(*[F.lit(c) for c in ("en", "fr", "de", "es")])))
    confidence = F.when(F.col("n_chars") % 7 == 0, 0.0).otherwise((F.col("n_chars") % 100).cast("double"))
    return each.select("doc_id", "candidate", F.round(fn.language_score(F.col("text"), confidence, F.lit(0.9), F.col("lang") == F.col("candidate")), 6).alias("score"))


@query(TRIED)
def language_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tried(spark, sf_dir)


@query(f"SELECT doc_id, arg_max(candidate, (score, -CASE candidate WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END)) AS best, max(score) AS score FROM ({TRIED}) GROUP BY 1")
def language_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.when(F.col("candidate") == "en", 0).when(F.col("candidate") == "fr", 1).when(F.col("candidate") == "de", 2).otherwise(3)
    return tried(spark, sf_dir).groupBy("doc_id").agg(F.max_by("candidate", F.struct(F.col("score"), (-order).alias("o"))).alias("best"), F.max("score").alias("score"))


@query(f"SELECT doc_id, {CODES} AS code FROM documents")
def recognition_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", fn.recognition_language(F.col("lang")).alias("code"))


GRAMS = r"list_transform(range(1, length(l) - 1), lambda i: substr(l, i, 3))"
LETTERS = r"(' ' || trim(regexp_replace(lower({}), '[^\p{{L}}]+', ' ', 'g')) || ' ')"
DETECTED = rf"""
WITH p AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) AS rank FROM (
    SELECT lang, unnest({GRAMS}) AS gram FROM (SELECT lang, {LETTERS.format('text')} AS l FROM documents WHERE doc_id % 3 <> 1 AND lang IS NOT NULL AND text IS NOT NULL)) GROUP BY lang, gram QUALIFY rank <= 400),
g AS (SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, unnest({GRAMS}) AS gram FROM (SELECT doc_id, {LETTERS.format('LOOKED_AT')} AS l FROM documents WHERE length(regexp_replace(LOOKED_AT, '^\s+|\s+$', '', 'g')) >= 50)) GROUP BY 1, 2),
s AS (SELECT doc_id, lang, sum(n * (401 - rank)) AS points FROM g JOIN p USING (gram) GROUP BY 1, 2),
b AS (SELECT doc_id, arg_max(lang, (points, lang)) AS lang, max(points) / sum(points) AS score FROM s GROUP BY 1)
"""


def learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of the documents that aren't held out."""
    return languages.profiles(docs(spark, sf_dir).where("doc_id % 3 <> 1").select("text", "lang"))


@query(DETECTED.replace("LOOKED_AT", "text") + "SELECT d.doc_id, coalesce(b.lang, 'en') AS lang, round(coalesce(b.score, 0), 6) AS score FROM documents d LEFT JOIN b USING (doc_id)")
def detected_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.detected(docs(spark, sf_dir), learned(spark, sf_dir), "doc_id").withColumn("score", F.round("score", 6))


@query(DETECTED.replace("LOOKED_AT", "substr(text, 1, 1000)") + r"""
SELECT d.doc_id, CASE WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 200 THEN coalesce(b.lang, 'en') WHEN d.doc_id % 2 = 0 THEN {'fr': 'fra', 'de': 'deu', 'es': 'spa'}[d.lang] ELSE NULL END AS found,
  CASE WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 200 THEN 'text' WHEN d.doc_id % 2 = 0 AND d.lang IN ('fr', 'de', 'es') THEN 'model' ELSE 'default' END AS origin FROM documents d LEFT JOIN b USING (doc_id)
""".replace("{'fr': 'fra', 'de': 'deu', 'es': 'spa'}[d.lang]", "CASE d.lang WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' END"))
def language_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tells each document's language: its text's first 1000 characters where it is long enough, else the code that a model's answer names."""
    d = docs(spark, sf_dir)
    by_text = languages.detected(d, learned(spark, sf_dir), "doc_id", beginning=1000).select("doc_id", F.col("lang").alias("by_text"))
    code = F.create_map(*[F.lit(x) for kv in (("fr", "fra"), ("de", "deu"), ("es", "spa")) for x in kv])
    asked = d.withColumn("said", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("The page is in "), F.coalesce(F.try_element_at(code, F.col("lang")), F.lit("an unknown language")), F.lit("."))))
    answers = scorers.answered(asked, "doc_id", "said", lambda texts: texts).select("doc_id", fn.answered_language(F.col("answer")).alias("by_model"))
    both = d.join(by_text, "doc_id").join(answers, "doc_id")
    text = F.when(F.length(fn.strip(F.col("text"))) >= 200, F.col("by_text"))
    origin = F.when(text.isNotNull(), "text").when(F.col("by_model").isNotNull(), "model").otherwise("default")
    return both.select("doc_id", scorers.first_known(text, F.col("by_model")).alias("found"), origin.alias("origin"))


@query("""
SELECT doc_id, CASE WHEN s >= 80 THEN 'excellent' WHEN s >= 65 THEN 'good' WHEN s >= 50 THEN 'fair' WHEN s >= 30 THEN 'poor' ELSE 'very poor' END AS band FROM (SELECT doc_id, n_chars % 101 AS s FROM documents)
""")
def quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", fn.interpretation(F.col("n_chars") % 101).alias("band"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS preview FROM conversations")
def page_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.preview(F.col("text"), 300).alias("preview"))
