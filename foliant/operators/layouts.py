"""Page layouts: analysed elements, and paragraphs put together from recognised words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators.uploads import fold

TEXT_TYPES, VISUAL_TYPES = ("text", "paragraph", "heading", "title"), ("figure", "image", "table")
#: Words of section headings, beginnings of list items; fixed values.
SECTION_WORDS = (
    "abstract", "introduction", "method", "methods", "result", "results", "discussion", "conclusion", "conclusions",
    "references", "bibliography", "resumen", "kurzfassung", "zusammenfassung", "keywords", "acknowledgments",
)
LIST_BEGINNINGS = (r"\d+\.?\s", r"\(\d+\)", r"[a-zA-Z]\.?\s", r"[-•*▪▫○●]\s", r"[IVX]+\.?\s")
#: Distances in heights of the font, and what they are where no word is sure; fixed values.
GAPS = {"tiny_gap": 0.3, "line_gap": 0.8, "small_gap": 1.5, "medium_gap": 2.0, "large_gap": 2.5, "section_gap": 4.0, "char_width": 0.6}
DEFAULT_GAPS = {"tiny_gap": 6.0, "line_gap": 16.0, "small_gap": 30.0, "medium_gap": 40.0, "large_gap": 60.0, "section_gap": 80.0, "char_width": 12.0}
DEFAULT_HEIGHT, SURE = 20.0, 50


def elements(layouts: DataFrame, key: str) -> DataFrame:
    """(key, page_number, element_no, type, bbox, confidence, text) of every element of layouts (key, layout_json).

    An answer is parsed once, as a variant, and its pages and elements are taken out of that. Elements may come as a list
    or as an object; missing values, and those of another type, get their defaults. What isn't JSON, or has no pages,
    gives no rows; fields that aren't known are left alone.
    """
    spark = layouts.sparkSession
    field = lambda name, kind, default: F.coalesce(F.try_variant_get("value", f"$.{name}", kind), default).alias(name)
    answers = layouts.select(key, F.try_variant_get(F.try_parse_json("layout_json"), "$.pages", "variant").alias("pages_"))
    pages = answers.lateralJoin(spark.tvf.variant_explode(F.col("pages_").outer()))
    pages = pages.select(key, (F.col("pos") + 1).alias("page_number"), F.try_variant_get("value", "$.elements", "variant").alias("elements_"))
    found = pages.lateralJoin(spark.tvf.variant_explode(F.col("elements_").outer()))
    return found.select(
        key, "page_number", F.col("pos").alias("element_no"), field("type", "string", F.lit("unknown")), field("bbox", "array<double>", F.array(*[F.lit(0.0)] * 4)),
        field("confidence", "double", F.lit(0.0)), field("text", "string", F.lit("")),
    )


def histogram(found: DataFrame, key: str) -> DataFrame:
    """(key, total_elements, element_types): a map of counts by type."""
    counted = found.groupBy(key, "type").agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.sum("n").alias("total_elements"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("element_types"))


def text_blocks(found: DataFrame) -> DataFrame:
    return found.where(F.lower("type").isin(*TEXT_TYPES) & (F.btrim("text") != ""))


def visuals(found: DataFrame) -> DataFrame:
    """Figures, images and tables, with their text as a caption where they have one."""
    return found.where(F.lower("type").isin(*VISUAL_TYPES)).withColumn("caption", F.nullif(F.btrim("text"), F.lit("")))


def summary(pages: Column, total: Column, types: Column) -> Column:
    """`2 pages | 7 elements | (4 text, 3 table)`."""
    each = F.array_join(F.transform(F.map_entries(types), lambda e: F.concat_ws(" ", e["value"].cast("string"), e["key"])), ", ")
    return F.concat(pages.cast("string"), F.lit(" pages | "), total.cast("string"), F.lit(" elements | ("), each, F.lit(")"))


def mean_confidence(words: DataFrame, *by: str) -> DataFrame:
    """Mean confidence of words that aren't blank and have one; 0 without such."""
    good = (F.btrim("text") != "") & (F.col("conf") > 0)
    return words.groupBy(*by).agg(F.coalesce(F.avg(F.when(good, F.col("conf"))), F.lit(0.0)).alias("confidence"))


def thresholds(words: DataFrame, *by: str) -> DataFrame:
    """Each page's height of font and distances: the mean height of sure words weighted by confidence, then the plain mean of those within two deviations of it."""
    sure = words.where((F.btrim("text") != "") & (F.col("conf") > SURE))
    first = sure.groupBy(*by).agg((F.sum(F.col("height") * F.col("conf")) / F.sum("conf")).alias("middle"), F.stddev_pop("height").alias("spread"))
    near = sure.join(first, list(by)).where(F.abs(F.col("height") - F.col("middle")) < F.col("spread") * 2)
    mean = near.groupBy(*by).agg(F.avg("height").alias("mean"))
    out = words.select(*by).distinct().join(first, list(by), "left").join(mean, list(by), "left")
    size = F.coalesce("mean", "middle")
    gaps = [F.coalesce(size * factor, F.lit(DEFAULT_GAPS[name])).alias(name) for name, factor in GAPS.items()]
    return out.select(*by, F.coalesce(size, F.lit(DEFAULT_HEIGHT)).alias("height"), *gaps)


class _Line:
    """The line being filled: a word further from its first word's top than the line gap begins the next."""

    def __init__(self) -> None:
        self.number, self.top = 0, None

    def __call__(self, top: float, gap: float) -> tuple[int, float]:
        if self.top is None:
            self.top = top
        elif abs(top - self.top) > gap:
            self.number, self.top = self.number + 1, top
        return self.number, self.top


def lines(words: DataFrame, limits: DataFrame, drop_first: bool = False) -> DataFrame:
    """(page, line_no, text, y, x, width) from words (page, word_no, text, left, top, width). drop_first leaves a page's first word out, as older results did."""
    said = words.where(F.btrim("text") != "").join(limits.select("page", "line_gap"), "page")
    rows = said.select("page", "word_no", F.col("top").cast("double").alias("top"), "line_gap")
    placed = fold(rows, "page", ["word_no"], _Line, lambda s, page, n, top, gap: (page, n, *s(top, gap)), "page string, word_no long, line_no long, y double")
    full = said.join(placed, ["page", "word_no"])
    if drop_first:
        full = full.withColumn("first", F.min("word_no").over(Window.partitionBy("page"))).where("word_no <> first")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", F.btrim("text").alias("t")))), lambda w: w["t"]), " ")
    grouped = full.groupBy("page", "line_no").agg(text.alias("text"), F.first("y").alias("y"), F.min_by("left", "word_no").cast("double").alias("x"), F.max(F.col("left") + F.col("width")).alias("right"))
    return grouped.select("page", "line_no", "text", "y", "x", (F.col("right") - F.col("x")).alias("width"))


def is_header(text: Column) -> Column:
    return F.lower(text).rlike("|".join(SECTION_WORDS))


def begins_item(text: Column) -> Column:
    return text.rlike("(?U)^(?:" + "|".join(LIST_BEGINNINGS) + ")")


def is_short(text: Column, width: Column, height: Column) -> Column:
    """Narrower than 70 percent of 25 letters' heights, or without a width under 50 characters."""
    return F.when(width > 0, width < height * 25 * 0.7).otherwise(F.length(text) < 50)


def breaks(found: DataFrame, second_tier: bool = True) -> DataFrame:
    """lines with `tier`: 1 or 2 where a paragraph ends after the line, else null. found has (page, line_no, text, y, x, width) and the page's distances."""
    w = Window.partitionBy("page").orderBy("line_no")
    nxt = {c: F.lead(c).over(w) for c in ("text", "y", "x")}
    out = found.select("*", *[c.alias(f"next_{n}") for n, c in nxt.items()])
    gap = F.col("next_y") - F.col("y")
    one = (gap > F.col("large_gap")) | is_header(F.col("text")) | is_header(F.col("next_text")) | begins_item(F.col("next_text"))
    indented = (gap > F.col("line_gap")) & (F.abs(F.col("x") - F.col("next_x")) > F.col("char_width") * 3)
    ended = (gap > F.col("small_gap")) & is_short(F.col("text"), F.col("width"), F.col("height")) & F.rtrim("text").endswith(".") & F.col("next_text").rlike(r"^\p{Lu}")
    tier = F.when(F.col("next_text").isNotNull() & one, 1)
    if second_tier:
        tier = tier.when(F.col("next_text").isNotNull() & (indented | ended), 2)
    return out.withColumn("tier", tier).drop("next_text", "next_y", "next_x")


def paragraphs(broken: DataFrame) -> DataFrame:
    """(page, paragraph_no, text): lines joined by line feeds between breaks."""
    w = Window.partitionBy("page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    numbered = broken.withColumn("paragraph_no", F.coalesce(F.count("tier").over(w), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    return numbered.groupBy("page", "paragraph_no").agg(F.btrim(text, F.lit(" \t\r\n")).alias("text")).where("text <> ''")


def page_text(parts: DataFrame) -> DataFrame:
    """(page, text): paragraphs joined by empty lines."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_no", "text"))), lambda x: x["text"]), "\n\n")
    return parts.groupBy("page").agg(text.alias("text"))
