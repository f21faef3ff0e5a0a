"""The catalogue: lookups, search, detail bundles, coverage."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lookup(df: DataFrame, **key: Any) -> DataFrame:
    """Rows with the given key values; the equality reaches the scan."""
    for name, value in key.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def fold(c: Column) -> Column:
    """Lower case of ASCII letters only, as SQLite's LIKE folds."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def holds(c: Column, part: str) -> Column:
    """Whether a string holds a part, whatever the case of ASCII letters; wildcards have no meaning."""
    return F.contains(fold(c), F.lit(part.translate(str.maketrans(ASCII_UPPER, ASCII_LOWER))))


def checked(value: int, least: int, most: int, name: str) -> int:
    """A parameter within its range, or ValueError."""
    if not least <= value <= most:
        raise ValueError(f"{name} must be from {least} to {most}")
    return value


def page_of(df: DataFrame, *order: Column | str, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of rows in a total order. Only limit + offset rows of each partition travel."""
    return df.orderBy(*order).offset(offset).limit(limit)


def search(papers: DataFrame, meta: DataFrame, title: str | None = None, author: str | None = None, year: int | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Papers with metadata whose title and authors hold the parts and whose year is given; newest first. All filters apply before paging, and rows without a year stay unless one is asked for."""
    found = papers.join(meta.withColumnRenamed("created_at", "metadata_created_at"), papers.doc_id == meta.paper_id).drop("paper_id")
    for name, part in (("title", title), ("authors", author)):
        if part:
            column = F.col(name) if name == "title" else F.array_join("authors", ", ")
            found = found.where(holds(column, part))
    if year:
        found = found.where(F.col("year") == year)
    return page_of(found, F.desc("created_at"), "doc_id", limit=limit, offset=offset)


def text_view(papers: DataFrame) -> DataFrame:
    """(doc_id, text, text_length): empty text and length 0 where there is none."""
    return papers.select("doc_id", F.coalesce("ocr_text", F.lit("")).alias("text"), F.coalesce(F.length("ocr_text"), F.lit(0)).alias("text_length"))


def present(papers: DataFrame, **sides: DataFrame) -> DataFrame:
    """doc_id with a flag has_<name> for each side table (keyed by paper_id). Sides are reduced to their distinct keys first."""
    out = papers.select("doc_id")
    for name, side in sides.items():
        keys = side.select(F.col("paper_id").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct().withColumn(f"has_{name}", F.lit(True))
        out = out.join(keys, "doc_id", "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    return out


def rate(part: Column, whole: Column) -> Column:
    """Percent of the whole, 0 of nothing."""
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def one_row(*frames: DataFrame) -> DataFrame:
    """The columns of several frames of one row each, as one row."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def coverage(flags: DataFrame) -> DataFrame:
    """One row: papers, and for each has_<name> flag how many have it and what percent, from one pass."""
    names = [c.removeprefix("has_") for c in flags.columns if c.startswith("has_")]
    counted = flags.agg(F.count("*").alias("total_papers"), *[F.count_if(F.col(f"has_{n}")).alias(f"papers_with_{n}") for n in names])
    return counted.select("*", *[F.round(rate(F.col(f"papers_with_{n}"), F.col("total_papers")), 6).alias(f"{n}_rate") for n in names])


def distribution(df: DataFrame, by: str) -> DataFrame:
    """Rows and share by value; nulls count as a value."""
    counted = df.groupBy(by).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))


def detail(papers: DataFrame, pages: DataFrame, **sides: DataFrame) -> DataFrame:
    """Papers with their side records as structs and their pages as an ordered array."""
    listed = pages.groupBy(F.col("paper_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("page_number", "page_text"))).alias("pages"))
    out = papers
    for name, side in sides.items():
        own = [c for c in side.columns if c != "paper_id"]
        out = out.join(side.select(F.col("paper_id").alias("doc_id"), F.struct(*own).alias(name)), "doc_id", "left")
    return out.join(listed, "doc_id", "left")


def with_fallback(papers: DataFrame, first: DataFrame, second: DataFrame, value: str) -> DataFrame:
    """(doc_id, value, origin): a value from the first store, else from the second if it isn't empty there."""
    a = first.select(F.col("paper_id").alias("doc_id"), F.col(value).alias("a_"))
    b = second.where(F.size(value) > 0).select(F.col("paper_id").alias("doc_id"), F.col(value).alias("b_"))
    both = papers.select("doc_id").join(a, "doc_id", "left").join(b, "doc_id", "left")
    origin = F.when(F.col("a_").isNotNull(), "first").when(F.col("b_").isNotNull(), "second")
    return both.select("doc_id", F.coalesce("a_", "b_").alias(value), origin.alias("origin"))


def neighbours(pages: DataFrame) -> DataFrame:
    """Each page with the previous and next page of its paper, its place and the paper's number of pages."""
    w = Window.partitionBy("paper_id").orderBy("page_number")
    return pages.select(
        "paper_id", "page_number", F.lag("page_number").over(w).alias("prev_page"), F.lead("page_number").over(w).alias("next_page"),
        F.row_number().over(w).alias("position"), F.count("*").over(Window.partitionBy("paper_id")).alias("total_pages"),
    )


def page_lengths(pages: DataFrame) -> DataFrame:
    """Least, greatest and rounded mean length of a paper's pages; a missing text has length 0."""
    n = F.coalesce(F.length("page_text"), F.lit(0))
    return pages.groupBy("paper_id").agg(F.count("*").alias("n_pages"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.round(F.avg(n)).cast("long").alias("avg_length"))


def pending(flags: DataFrame) -> DataFrame:
    """Papers that wait for a task. quality_done and layout_done and llm_done are flags, text a string."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    out = flags.select("doc_id", no("quality_done").alias("quality_pending"), no("layout_done").alias("layout_pending"), (no("llm_done") & F.coalesce(F.col("text") != "", F.lit(False))).alias("llm_pending"))
    return out.where("quality_pending OR layout_pending OR llm_pending")
