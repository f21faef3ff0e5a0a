"""Languages of texts by profiles of character n-grams.

A language's profile is its most frequent n-grams in texts of known language, with their ranks. A text's score in a
language is the sum over its n-grams of how high they rank there. Texts are taken whole, in pieces, so that a task holds the
n-grams of one piece however long a text is. Profiles are a small table, so scoring a text is a join of its n-grams with a
broadcast table and an aggregation that a task does by itself first, as a text's n-grams lie together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Letters of an n-gram, n-grams of a profile, and least characters of a text; fixed by stored results.
GRAM, RANKS, LEAST = 3, 400, 50
#: Letters of a piece of a text, whose n-grams are made at once.
PIECE = 1000
#: Languages that profiles are kept for at most: those with most texts.
LANGUAGES = 200
DEFAULT = "en"
#: A text of LEAST characters or more between white space at its ends. Stripping would go through a run of white space once for each place of it.
LONG = rf"(?sU)\A\s*+\S.{{{LEAST - 2}}}\s*+\S"


def letters(text: Column) -> Column:
    """A text's letters; what isn't a letter is one blank, as are both ends."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def runs(of: Column) -> Column:
    """The n-grams of letters, in order and with repeats."""
    # One pass: each match looks at GRAM letters and takes one. A lambda over places would build the letters anew for each.
    return F.coalesce(F.regexp_extract_all(of, F.lit(f"(?s)(?=({'.' * GRAM}))."), F.lit(1)), F.array().cast("array<string>"))


def grams(text: Column) -> Column:
    """The n-grams of a text's letters."""
    return runs(letters(text))


def each_gram(texts: DataFrame, key: str) -> DataFrame:
    """(key, gram) for every n-gram of the whole texts (key, text). A piece looks on into the next one for the n-grams that begin in it."""
    pieces = F.regexp_extract_all(letters(F.col("text")), F.lit(f"(?s)(?=(.{{1,{PIECE + GRAM - 1}}})).{{1,{PIECE}}}"), F.lit(1))
    return texts.select(key, F.explode(pieces).alias("piece")).select(key, F.explode(runs(F.col("piece"))).alias("gram"))


def profiles(texts: DataFrame, ranks: int = RANKS, languages: int = LANGUAGES) -> DataFrame:
    """(lang, gram, rank) of texts (text, lang): each language's n-grams by how often they come, all texts counted."""
    known = texts.where("lang IS NOT NULL AND text IS NOT NULL")
    kept = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    counted = each_gram(known.join(F.broadcast(kept), "lang"), "lang").groupBy("lang", "gram").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks).select("lang", "gram", "rank")


def detected(texts: DataFrame, known: DataFrame, key: str, least: float = 0.0, ranks: int = RANKS, beginning: int | None = None) -> DataFrame:
    """(key, lang, score) of whole texts (key, text) by profiles: the language with the largest share of a text's points, 0 to 1. A short text, one without a known n-gram, and one whose best share is under the least, is of the default language. Only a caller that wants no more than the beginnings of texts gives their length."""
    looked = texts.select(key, F.substring("text", 1, beginning).alias("text") if beginning else F.col("text"))
    # One row for each n-gram of the profiles, with its languages: a lookup for each n-gram of a text, not one for each language.
    held = known.groupBy("gram").agg(F.collect_list(F.struct("lang", (ranks + 1 - F.col("rank")).cast("long").alias("points"))).alias("held"))
    worth = each_gram(looked.where(F.col("text").rlike(LONG)), key).join(F.broadcast(held), "gram").select(key, F.inline("held"))
    points = worth.groupBy(key, "lang").agg(F.sum("points").alias("points"))
    best = points.groupBy(key).agg(F.max_by("lang", F.struct("points", F.col("lang"))).alias("lang"), F.max("points").alias("top"), F.sum("points").alias("all"))
    found = texts.select(key).join(best, key, "left").withColumn("score", F.coalesce(F.col("top") / F.col("all"), F.lit(0.0)))
    return found.select(key, F.when(F.col("score") > least, F.col("lang")).otherwise(DEFAULT).alias("lang"), "score")
