"""A training corpus from documents: five stages, each applying one operator to all its predecessor kept.

For every stage: nulls may stand in any column; a null text counts as empty; very long texts are worked on whole;
repeated rows are rows of their own; other columns are carried along whatever their names; an empty table gives no rows.
What else is particular to a stage is said there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliant.llm import minhash, mixing, packing, pii, toxicity
from foliant.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't reject. A text without terms has the score of the bias, so it stays unless most labels are 1; equal texts fare alike."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id. Wordless texts are no duplicates; of rows that share the least id, and of those without an id, all stay."""
    return minhash.keep_first(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and what discloses it replaced, n_chars with it; a text without either, null included, stays as it is."""
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, shuffled. Wordless texts are never taken; a null source is a source; rows equal in id, source and size are taken alike."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences; an empty text is one piece of the closing id."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_duplicates), ("pii", sanitise), ("mixing", mix), ("best_fit_packing", pack)]

#: Learned scores, mixing and packing can't be said in SQL; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
