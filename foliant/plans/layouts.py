from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import layouts as op
from foliant.plans.registry import query
from foliant.sources import tables as src

KINDS = ("title", "text", "figure", "table")


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout as a service would give it: conversations as documents, turns as pages, their lines as elements."""
    t = src.table(spark, sf_dir, "conversations")
    kind = lambda i: F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.pmod(i, F.lit(4)) + 1)
    each = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(kind(i).alias("type"), x.alias("text"), F.lit(0.9).alias("confidence")))
    pages = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", each.alias("elements")))).alias("p"))
    return pages.select("conv_id", F.to_json(F.struct(F.transform("p", lambda x: F.struct(F.lit(600.0).alias("width"), x["elements"].alias("elements"))).alias("pages"))).alias("layout_json"))


LINES = "(SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM conversations)"
TYPED = f"(SELECT *, ['title', 'text', 'figure', 'table'][1 + i % 4] AS type FROM {LINES})"


@query(f"SELECT conv_id, type, count(*) AS n FROM {TYPED} GROUP BY 1, 2")
def layout_element_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.histogram(op.elements(layouts(spark, sf_dir), "conv_id"), "conv_id")
    return found.select("conv_id", F.explode("element_types").alias("type", "n"))


@query(f"""
SELECT conv_id, count(DISTINCT turn) || ' pages | ' || count(*) || ' elements | (' || (SELECT string_agg(n || ' ' || type, ', ' ORDER BY type) FROM (SELECT type, count(*) AS n FROM {TYPED} b WHERE b.conv_id = a.conv_id GROUP BY 1)) || ')' AS summary FROM {TYPED} a GROUP BY conv_id
""")
def layout_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.elements(layouts(spark, sf_dir), "conv_id")
    n = found.groupBy("conv_id").agg(F.count_distinct("page_number").alias("pages"))
    h = op.histogram(found, "conv_id").join(n, "conv_id")
    return h.select("conv_id", op.summary(F.col("pages"), F.col("total_elements"), F.col("element_types")).alias("summary"))


@query(f"SELECT conv_id, (turn + 1)::INTEGER AS page_number, i::INTEGER AS element_no, line AS text FROM {TYPED} WHERE type IN ('title', 'text') AND trim(line) <> ''")
def layout_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.text_blocks(op.elements(layouts(spark, sf_dir), "conv_id")).select("conv_id", "page_number", "element_no", "text")


@query(f"SELECT conv_id, (turn + 1)::INTEGER AS page_number, i::INTEGER AS element_no, type, nullif(trim(line), '') AS caption FROM {TYPED} WHERE type IN ('figure', 'table')")
def layout_figures_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.visuals(op.elements(layouts(spark, sf_dir), "conv_id")).select("conv_id", "page_number", "element_no", "type", "caption")


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as recognised words: quantity is the height, the discount the confidence."""
    t = src.table(spark, sf_dir, "lineitem")
    return t.select((F.col("l_orderkey") % 500).alias("page"), F.lit("w").alias("text"), F.col("l_quantity").alias("height"), F.round(F.col("l_discount") * 1000, 0).alias("conf"))


@query("""
WITH w AS (SELECT l_orderkey % 500 AS page, l_quantity AS h, round(l_discount * 1000) AS c FROM lineitem), s AS (SELECT * FROM w WHERE c > 50),
f AS (SELECT page, sum(h * c) / sum(c) AS m, stddev_pop(h) AS sd FROM s GROUP BY 1), g AS (SELECT s.page, avg(h) AS mean FROM s JOIN f USING (page) WHERE abs(h - m) < 2 * sd GROUP BY 1)
SELECT page, round(coalesce(mean, m, 20), 6) AS height, round(coalesce(coalesce(mean, m) * 2.5, 60), 6) AS large_gap FROM (SELECT DISTINCT page FROM w) LEFT JOIN f USING (page) LEFT JOIN g USING (page)
""")
def font_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.thresholds(word_boxes(spark, sf_dir), "page").select("page", F.round("height", 6).alias("height"), F.round("large_gap", 6).alias("large_gap"))


@query("SELECT l_orderkey % 500 AS page, round(coalesce(avg(CASE WHEN round(l_discount * 1000) > 0 THEN round(l_discount * 1000) END), 0), 6) AS confidence FROM lineitem GROUP BY 1")
def word_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.mean_confidence(word_boxes(spark, sf_dir), "page").withColumn("confidence", F.round("confidence", 6))


def placed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines with made-up places: every fourth lies lower, every fifth is set in."""
    each = src.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    n = F.col("line_no")
    y = n * 20.0 + F.floor(n / 4) * 45.0
    return each.select("page", "line_no", "text", y.cast("double").alias("y"), F.when(n % 5 == 0, 60.0).otherwise(0.0).alias("x"), (F.length("text") * 10.0).alias("width"), F.lit(20.0).alias("height"), *[F.lit(v).alias(k) for k, v in op.DEFAULT_GAPS.items()])


HEADER = "regexp_matches(lower({0}), '" + "|".join(op.SECTION_WORDS) + "')"
ITEM = r"regexp_matches({0}, '^(?:\d+\.?\s|\(\d+\)|[a-zA-Z]\.?\s|[-•*▪▫○●]\s|[IVX]+\.?\s)')"
BREAKS = f"""
WITH l AS (SELECT doc_id AS page, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
p AS (SELECT *, i * 20 + (i // 4) * 45 AS y, CASE WHEN i % 5 = 0 THEN 60 ELSE 0 END AS x, length(t) * 10 AS width FROM l),
n AS (SELECT *, lead(t) OVER w AS nt, lead(y) OVER w AS ny, lead(x) OVER w AS nx FROM p WINDOW w AS (PARTITION BY page ORDER BY i))
SELECT page, i::INTEGER AS line_no, t, CASE WHEN nt IS NULL THEN NULL WHEN ny - y > 60 OR {HEADER.format('t')} OR {HEADER.format('nt')} OR {ITEM.format('nt')} THEN 1
  WHEN (ny - y > 16 AND abs(x - nx) > 36) OR (ny - y > 30 AND (CASE WHEN width > 0 THEN width < 350 ELSE length(t) < 50 END) AND ends_with(rtrim(t), '.') AND regexp_matches(nt, '^\\p{{Lu}}')) THEN 2 END AS tier FROM n
""".replace("\\\\p", "\\p")


@query(f"SELECT page, line_no, tier FROM ({BREAKS})")
def paragraph_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.breaks(placed_lines(spark, sf_dir)).select("page", "line_no", "tier")


@query(f"""
WITH b AS ({BREAKS}), n AS (SELECT *, coalesce(count(tier) OVER (PARTITION BY page ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS paragraph_no FROM b)
SELECT page, paragraph_no, md5(x) AS digest FROM (SELECT page, paragraph_no, trim(string_agg(t, chr(10) ORDER BY line_no), ' ' || chr(9) || chr(10) || chr(13)) AS x FROM n GROUP BY 1, 2) WHERE x <> ''
""")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.paragraphs(op.breaks(placed_lines(spark, sf_dir))).select("page", "paragraph_no", F.md5("text").alias("digest"))


@query()
def words_to_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = src.table(spark, sf_dir, "conversations")
    each = t.select(F.concat_ws(":", "conv_id", "turn").alias("page"), F.posexplode(F.split("text", r"\s+")).alias("word_no", "text"))
    n = F.col("word_no")
    words = each.select("page", n.cast("long").alias("word_no"), "text", ((n % 8) * 60).cast("double").alias("left"), (F.floor(n / 8) * 24 + n % 3).cast("double").alias("top"), F.lit(50.0).alias("width"), F.lit(20.0).alias("height"), F.lit(90.0).alias("conf"))
    limits = op.thresholds(words, "page")
    whole = op.page_text(op.paragraphs(op.breaks(op.lines(words, limits).join(limits, "page"))))
    return whole.select("page", F.length("text").alias("length"), F.md5("text").alias("digest"))
