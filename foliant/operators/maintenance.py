"""Upserts, replacement, clean-up and repair, as DataFrames: each takes the stored rows and returns what is to be stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.duplicates import newest

#: Days of a month in retention rules.
MONTH_DAYS = 30
#: Presets of the scheduled clean-ups: months after which unused hashes go (None: kept), days of log kept.
PRESETS = {"daily": (None, 90), "weekly": (6, 90), "monthly": (12, 180)}


def before(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def upsert(stored: DataFrame, new: DataFrame, key: str, keep_empty: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both by key; a value that is new and not null (and for keep_empty columns not '') replaces the stored one."""
    others = [c for c in stored.columns if c != key]
    fresh = new.select(key, *[F.col(c).alias(f"new_{c}") for c in others if c in new.columns])

    def merged(c: str) -> Column:
        if c not in new.columns:
            return F.col(c)
        value = F.col(f"new_{c}")
        return F.coalesce(F.when(value != "", value) if c in keep_empty else value, F.col(c)).alias(c)

    return stored.join(fresh, key, "full_outer").select(key, *[merged(c) for c in others])


def replace_by_key(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both; of rows with the same key the newest stays."""
    return newest(stored.unionByName(new).withColumn("key", F.col(key)), key).drop("key") if key != "key" else newest(stored.unionByName(new), key)


def replace_group(stored: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """Stored rows of the groups that new has are dropped, and new's rows added: delete and insert by document."""
    return stored.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def delete_group(stored: DataFrame, gone: DataFrame, group: str) -> DataFrame:
    return stored.join(gone.select(group).distinct(), group, "left_anti")


def orphans(hashes: DataFrame, papers: DataFrame) -> DataFrame:
    """Rows whose paper isn't there."""
    return hashes.join(papers.select(F.col("doc_id").alias("paper_id")), "paper_id", "left_anti")


def without_orphans(hashes: DataFrame, papers: DataFrame) -> DataFrame:
    return hashes.join(papers.select(F.col("doc_id").alias("paper_id")), "paper_id", "left_semi")


def unused(hashes: DataFrame, papers: DataFrame, log: DataFrame, as_of: Column, months: int) -> DataFrame:
    """Rows of papers created before the threshold that no detection since then names."""
    limit = before(as_of, months * MONTH_DAYS)
    recent = log.where((F.col("created_at") >= limit) & F.col("duplicate_paper_id").isNotNull()).select(F.col("duplicate_paper_id").alias("paper_id")).distinct()
    old = papers.where(F.col("created_at") < limit).select(F.col("doc_id").alias("paper_id")).join(recent, "paper_id", "left_anti")
    return hashes.join(old, "paper_id", "left_semi")


def old_logs(log: DataFrame, as_of: Column, days: int) -> DataFrame:
    return log.where(F.col("created_at") < before(as_of, days))


def finished_jobs(jobs: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Jobs that ended well or badly and are older than so many days."""
    return jobs.where(F.col("status").isin("completed", "failed") & (F.col("created_at") < before(as_of, days)))


def clean_all(stores: dict[str, DataFrame], papers: DataFrame, log: DataFrame, as_of: Column, months: int | None, log_days: int) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Orphans, then repeated hashes, then unused ones, then old log rows go; later steps see earlier deletions.

    Returns the kept stores, the kept log, and rows (step, store, removed).
    """
    kept, steps = {}, []

    def count(step: str, name: str, rows: DataFrame) -> None:
        steps.append(rows.agg(F.count("*").alias("removed")).select(F.lit(step).alias("step"), F.lit(name).alias("store"), "removed"))

    for name, store in stores.items():
        count("orphaned", name, orphans(store, papers))
        held = without_orphans(store, papers)
        single = newest(held, "paper_id")
        count("duplicate", name, held.join(single.select("key"), "key", "left_anti"))
        if months is not None:
            gone = unused(single, papers, log, as_of, months)
            count("unused", name, gone)
            single = single.join(gone.select("key"), "key", "left_anti")
        kept[name] = single
    count("logs", "log", old_logs(log, as_of, log_days))
    return kept, log.where(F.col("created_at") >= before(as_of, log_days)), reduce(DataFrame.unionByName, steps)


def cascade_delete(gone: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table (keyed by paper_id) without the rows of the papers (doc_id) that go."""
    keys = gone.select(F.col("doc_id").alias("paper_id")).distinct()
    return {name: t.join(keys, "paper_id", "left_anti") for name, t in tables.items()}


def saved_kinds(made: DataFrame, by: str, kinds: tuple[str, ...]) -> DataFrame:
    """(by, saved, stored): how many of the kinds of hashes (flags whether one could be made) all of a document's rows have, and its rows."""
    every = made.groupBy(by).agg(*[F.bool_and(k).alias(k) for k in kinds], F.count("*").alias("stored"))
    return every.select(by, sum((F.col(k).cast("int") for k in kinds), F.lit(0)).alias("saved"), "stored")
