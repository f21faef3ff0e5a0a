"""Bibliographic records of texts: by models where there are some, by rules else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import extract
from foliant.functions.texts import strip
from foliant.sources.scorers import Scorer, asked

#: Characters that a text needs for a model to be asked, and of it that the plain prompt shows; fixed values.
LEAST_TEXT, PLAIN_PROMPT = 100, 2000


def extracted(papers: DataFrame, text: str, structured: Scorer | None = None, plain: Scorer | None = None) -> DataFrame:
    """papers with a `record`, the `method` that found it, whether that was a `success`, and an `error`.

    The first model answers in JSON. Where it fails, or its answer isn't JSON, the second is asked, and answers in lines
    with labels; only where that fails, plain rules count. A text too short has an empty record. Without models the rules
    that know a journal's head count, which succeed if they find a title. Each model sees only the rows that come down
    to it, and rows pass through whole: nothing is shuffled or joined. A null text is an empty one.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    outcome = lambda df, record, method, success, error: df.withColumns({"record": record, "method": method, "success": success, "error": error})
    none = F.lit(None).cast("string")
    if structured is None:
        rules = papers.withColumn("record", extract.headed_rules(t))
        return outcome(rules, F.col("record"), F.lit("rule_based_fallback"), F.col("record.title").isNotNull(), none)

    long = F.length(strip(t)) >= LEAST_TEXT
    one = asked(papers, F.when(long, extract.prompt_text(t)), structured, "first_")
    one = one.withColumn("found_", extract.structured_record(F.col("first_")))
    if plain is None:
        two = one.withColumns({"second_": none, "second__error": F.lit("no model")})
    else:
        two = asked(one, F.when(long & F.col("found_").isNull(), F.substring(t, 1, PLAIN_PROMPT)), plain, "second_")
    by_rules = F.col("second__error").isNotNull() | F.col("second_").isNull()
    choose = lambda short, first, second, rules: F.when(~long, short).when(F.col("found_").isNotNull(), first).when(by_rules, rules).otherwise(second)
    record = choose(extract.record_of(), F.col("found_"), extract.labelled_record(F.col("second_")), extract.plain_rules(t))
    method: Column = choose(*map(F.lit, ("none", "structured_llm", "fallback_llm", "rule_based")))
    done = outcome(two, record, method, long, F.when(~long, "Text too short"))
    return done.drop("first_", "first__error", "found_", "second_", "second__error")
