"""Pages recognised anew: what changed in texts and vectors, and the stores with the new pages in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import texts, vector
from foliant.operators.maintenance import replace_group
from foliant.sources.scorers import embedded

Model = Callable[[list[str]], list[list[float]]]

#: What each overall change advises; fixed values.
ADVICE = {
    "minimal_change": "OCR produced similar results", "minor_improvement": "OCR slightly improved text quality",
    "significant_improvement": "OCR significantly improved text quality", "quality_degraded": "Consider keeping original text",
    "changed": "Review changes carefully", "embedding_unavailable": "Cannot compare embeddings",
}
PAGE = ["paper_id", "page_number"]


def drift(old_text: Column, new_text: Column, old_vector: Column, new_vector: Column) -> Column:
    """One report on a text and its vector: the text's measures, the vector's, what both say overall, and the advice. The vector's measures are null where a vector is null or empty."""
    text = texts.quality_change(F.coalesce(old_text, F.lit("")), F.coalesce(new_text, F.lit("")))
    both = (F.coalesce(F.size(old_vector), F.lit(0)) > 0) & (F.coalesce(F.size(new_vector), F.lit(0)) > 0)
    moved = {n: F.when(both, c) for n, c in vector.comparison(old_vector, new_vector).items()}
    overall = texts.overall_change(moved["cosine"], text["assessment"])
    advice = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])[overall]
    part = lambda d: F.struct(*[c.alias(n) for n, c in d.items()])
    return F.struct(part(text).alias("text"), part(moved).alias("vector"), overall.alias("overall"), advice.alias("advice"))


def joined_pages(pages: DataFrame, first: int = 2) -> DataFrame:
    """(paper_id, text, head): the text of all pages of each paper and that of the first ones, from which its record is read. Pages of one number are joined in the order of their texts."""
    page = F.struct("page_number", "page_text")
    text = lambda c: F.array_join(F.transform(F.array_sort(c), lambda p: p["page_text"]), "\n\n")
    return pages.groupBy("paper_id").agg(text(F.collect_list(page)).alias("text"), text(F.collect_list(F.when(F.col("page_number") <= first, page))).alias("head"))


def reread(pages: DataFrame, fresh: DataFrame, model: Model, dim: int) -> tuple[DataFrame, DataFrame]:
    """The page store with the new pages in it, and the report on each of them.

    pages: (paper_id, page_number, page_text, v); fresh: (paper_id, page_number, page_text), one row a page. A new page
    takes the text's and the vector's place, one that isn't stored is added, and a blank one changes nothing, as no text
    was chosen. Only new pages are embedded; they are matched by one join on the page's key.
    """
    chosen = fresh.where(F.length(texts.strip(F.col("page_text"))) > 0).select(F.struct(*PAGE).alias("page"), F.col("page_text").alias("new_text"))
    vectors = embedded(chosen, "page", "new_text", model, dim).withColumnRenamed("v", "new_v")
    new = chosen.join(vectors, "page").select("page.*", "new_text", "new_v")
    both = pages.join(new, PAGE, "full")
    stored = both.select(*PAGE, F.coalesce("new_text", "page_text").alias("page_text"), F.coalesce("new_v", "v").alias("v"))
    report = both.where("new_text IS NOT NULL").select(*PAGE, drift(F.col("page_text"), F.col("new_text"), F.col("v"), F.col("new_v")).alias("report"))
    return stored, report


def papers_again(pages: DataFrame, touched: DataFrame, papers: DataFrame, model: Model, dim: int) -> DataFrame:
    """papers (paper_id, text, v) with the texts and vectors of touched ones (paper_id) made anew from their stored pages; the others stay as they are."""
    own = joined_pages(pages.join(touched.select("paper_id").distinct(), "paper_id", "left_semi")).drop("head")
    made = own.join(embedded(own, "paper_id", "text", model, dim), "paper_id").select("paper_id", "text", "v")
    return replace_group(papers, made, "paper_id")


def pages_again(pages: DataFrame, papers: DataFrame, model: Model, dim: int) -> DataFrame:
    """The page store with the vectors of all pages of these papers (paper_id) made anew from their texts, in place of those stored."""
    own = pages.join(papers.select("paper_id").distinct(), "paper_id", "left_semi").select(F.struct(*PAGE).alias("page"), "page_text")
    made = own.join(embedded(own, "page", "page_text", model, dim), "page").select("page.*", "page_text", "v")
    return replace_group(pages, made, "paper_id")
