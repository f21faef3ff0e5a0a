"""Duplicate detection in levels: file bytes, content, sample, vector; and the statistics of its log."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators.catalog import one_row, rate
from foliant.session import written

LEVELS = ("Level_0_File_Hash", "Level_1_Content_Hash", "Level_2_Sample_Embedding")
#: Characters of content, of a sampled page and of a whole sample that count; and what a cut adds.
CONTENT_CHARS, PAGE_CHARS, SAMPLE_CHARS, CUT = 5000, 1000, 4000, "..."
#: Seconds that processing is taken to need, at all and for each megabyte.
BASE_SECONDS, MB_SECONDS = 60.0, 20.0


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(CUT))).otherwise(text)


def content_hash(title: Column, author: Column, creator: Column, pages: Column, text: Column) -> Column:
    """SHA-256 over a document's description and the text of its first three pages."""
    part = lambda name, c: F.concat(F.lit(f"|{name}:"), F.coalesce(c.cast("string"), F.lit("")))
    return F.sha2(F.concat(part("title", title), part("author", author), part("creator", creator), part("pages", pages), part("text", text)), 256)


#: White space that ends of texts are stripped of.
ENDS = " \t\r\n\u000b\f"


def first_pages_text(pages: Column) -> Column:
    """The text of the first three of an array of pages, a line feed after each, cut, then stripped."""
    each = F.transform(F.slice(pages, 1, 3), lambda p: F.concat(F.coalesce(p, F.lit("")), F.lit("\n")))
    return F.btrim(shortened(F.array_join(each, ""), CONTENT_CHARS), F.lit(ENDS))


def sampled_pages(n: Column) -> Column:
    """Indexes of first, middle and last page, without repeats: the middle only from three pages on."""
    return F.array_distinct(F.filter(F.array(F.lit(0), F.when(n >= 3, F.floor(n / 2).cast("int")), (n - 1).cast("int")), lambda i: i.isNotNull() & (i >= 0)))


def random_pages(paper: Column, n: Column, most: int = 3, seed: int = 1) -> Column:
    """At most three page indexes drawn by a hash of the paper, ascending."""
    every = F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    shuffled = F.array_sort(F.transform(every, lambda i: F.struct(F.xxhash64(F.lit(seed), paper, i).alias("h"), i.alias("i"))))
    return F.array_sort(F.transform(F.slice(shuffled, 1, most), lambda x: x["i"]))


#: What follows each sampled page: a backslash and an n, as the stored samples have it. A fixed value.
AFTER_PAGE = "\\n"
#: Samples of fewer characters have no vector. Components of a sample's vector, and places of a term in it.
LEAST_SAMPLE, DIMENSIONS, PLACES = 50, 1024, 4


def sample_text(pages: Column, indexes: Column) -> Column:
    """The beginnings of the pages at the indexes, each with what follows a page; the whole cut, then stripped."""
    each = F.transform(indexes, lambda i: F.concat(F.substring(F.coalesce(F.get(pages, i), F.lit("")), 1, PAGE_CHARS), F.lit(AFTER_PAGE)))
    return F.btrim(shortened(F.array_join(each, ""), SAMPLE_CHARS), F.lit(ENDS))


def sample_of_text(text: Column, page: int = PAGE_CHARS) -> Column:
    """The sample of a text without pages, which count as so many characters each; only the sampled ones are cut out."""
    n = F.ceil(F.length(text) / page).cast("int")
    return sample_text(F.transform(sampled_pages(n), lambda i: F.substr(text, i * page + 1, F.lit(page))), F.transform(sampled_pages(n), lambda _, k: k))


def term_vectors(texts: list[str]) -> list[np.ndarray]:
    """What stands in for a model: counts of words projected by a hash, each word to a few places with signs. Texts of the same words have one vector, others don't."""
    known: dict[str, bytes] = {}
    out = []
    for t in texts:
        words = Counter(re.findall(r"[^\x20\x09-\x0D]+", t))
        for word in words.keys() - known.keys():
            known[word] = hashlib.blake2b(word.encode(), digest_size=4 * PLACES).digest()
        drawn = np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4")
        times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), PLACES)
        # Sums of whole numbers, so that the order of words doesn't matter.
        out.append(np.bincount(drawn % DIMENSIONS, np.where(drawn >> 31, -times, times), DIMENSIONS).astype(np.float32))
    return out


#: Samples that a model gets at once; a failed lot is tried sample by sample.
SAMPLES = 256


def with_sample_hash(df: DataFrame, sample: str, name: str, model: Callable[[list[str]], list[np.ndarray]] = term_vectors) -> DataFrame:
    """df with the digest of a model's vector of each sample in the sample's stead; null where the sample is too short or the model fails."""
    kept = [c for c in df.columns if c != sample]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != sample)

    def digests(texts: list[str]) -> list[str | None]:
        try:
            found = [hashlib.sha256(np.asarray(v, "<f4").tobytes()).hexdigest() for v in model(texts)]
            if len(found) != len(texts):
                raise ValueError("a vector for each text")
            return found
        except Exception:  # noqa: BLE001  a sample without a vector is no copy of anything
            return [None] if len(texts) == 1 else [d for t in texts for d in digests([t])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SAMPLES):
                part = batch.slice(lo, SAMPLES)
                texts = part[sample].to_pylist()
                long = [i for i, t in enumerate(texts) if t is not None and len(t.strip()) >= LEAST_SAMPLE]
                found: list[str | None] = [None] * len(texts)
                for i, d in zip(long, digests([texts[i] for i in long]) if long else [], strict=True):
                    found[i] = d
                yield pa.RecordBatch.from_arrays([*[part[c] for c in kept], pa.array(found, pa.string())], names=[*kept, name])

    return df.mapInArrow(run, f"{kinds}, `{name}` string")


def _float_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [hashlib.sha256(np.asarray(v.as_py(), "<f4").tobytes()).hexdigest() if v.is_valid else None for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "digest"])


def vector_digest(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, digest): SHA-256 of each vector's little-endian single-precision bytes."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(vector).cast("array<float>")).mapInArrow(_float_digest, f"key {kind}, digest string")


def first_of_group(docs: DataFrame, key: Column, level: str) -> DataFrame:
    """(doc_id, duplicate_of, level) for each document whose key an earlier document has. One shuffle of ids and keys."""
    keyed = docs.select("doc_id", key.alias("key_")).where("key_ IS NOT NULL")
    first = keyed.groupBy("key_").agg(F.min("doc_id").alias("duplicate_of"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(first, "key_").where("doc_id <> duplicate_of").select("doc_id", "duplicate_of", F.lit(level).alias("level"))


def groups_with_copies(docs: DataFrame, key: Column, least: int = 2) -> DataFrame:
    return docs.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where(F.col("n") >= least)


def cascade(docs: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Each document's first level that finds an earlier copy: (doc_id, duplicate_of, level).

    The texts are read once: ids and keys are written, and all else works on them. A level's side of its join is its
    repeated keys with their first document, which is small where copies are few, so that Spark can send it to the
    documents instead of shuffling them.
    """
    names = list(keys)
    keyed = out = written(docs.select("doc_id", *[k.alias(f"k{i}") for i, k in enumerate(keys.values())]), "cascade-keys")
    for i in range(len(names)):
        stored = keyed.select(f"k{i}", "doc_id").where(f"k{i} IS NOT NULL").groupBy(f"k{i}").agg(F.min("doc_id").alias(f"d{i}"), F.count("*").alias("n")).where("n > 1").drop("n")
        out = out.join(stored, f"k{i}", "left").withColumn(f"d{i}", F.when(F.col(f"d{i}") != F.col("doc_id"), F.col(f"d{i}")))
    first, level = F.coalesce(*[F.col(f"d{i}") for i in range(len(names))]), F.lit(None).cast("string")
    for i, name in reversed(list(enumerate(names))):
        level = F.when(F.col(f"d{i}").isNotNull(), name).otherwise(level)
    return out.select("doc_id", first.alias("duplicate_of"), level.alias("level")).where("duplicate_of IS NOT NULL")


def probe(candidates: DataFrame, library: DataFrame, keys: dict[str, Column], candidate_id: str) -> DataFrame:
    """Each candidate with the level and document that match it first, or No_Duplicate: keys are over columns of both sides."""
    out = candidates.select(candidate_id, *[k.alias(f"k{i}") for i, k in enumerate(keys.values())])
    hit, level = F.lit(None).cast("long"), F.lit(None).cast("string")
    for i, (name, key) in enumerate(keys.items()):
        stored = library.select(key.alias(f"k{i}"), "doc_id").where(f"k{i} IS NOT NULL").groupBy(f"k{i}").agg(F.min("doc_id").alias(f"d{i}"))
        out = out.join(stored, f"k{i}", "left")
        hit, level = F.coalesce(hit, F.col(f"d{i}")), F.coalesce(level, F.when(F.col(f"d{i}").isNotNull(), F.lit(name)))
    return out.select(candidate_id, hit.alias("duplicate_of"), F.coalesce(level, F.lit("No_Duplicate")).alias("level"))


def time_saved(result: Column, bytes_: Column, elapsed: Column) -> Column:
    """Seconds that finding the duplicate saved; null unless it was one."""
    return F.when(result == "duplicate_found", F.greatest(F.lit(0.0), BASE_SECONDS + MB_SECONDS * bytes_ / (1024.0 * 1024.0) - elapsed))


def log_statistics(log: DataFrame, as_of: Column, days: int) -> DataFrame:
    """One row over the log's last days: counts by result and layer, rates, time saved in minutes, mean time of level 0."""
    recent = log.where(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days)))
    of = lambda c: F.count_if(c)
    sums = recent.agg(
        F.count("*").alias("total"), of(F.col("detection_result") == "duplicate_found").alias("duplicates"), of(F.col("detection_result") == "error").alias("errors"),
        of(F.col("detection_layer") == LEVELS[0]).alias("level_0_hits"), of(F.col("detection_layer") == LEVELS[1]).alias("level_1_hits"),
        F.coalesce(F.sum(time_saved(F.col("detection_result"), F.col("file_size"), F.col("total_processing_time"))), F.lit(0.0)).alias("saved"),
        F.coalesce(F.avg("layer_0_time"), F.lit(0.0)).alias("avg0"), F.coalesce(F.avg("total_processing_time"), F.lit(0.0)).alias("avg_all"),
    )
    return sums.select(
        "total", "duplicates", "errors", "level_0_hits", "level_1_hits", F.round(rate(F.col("duplicates"), F.col("total")), 6).alias("detection_rate"),
        F.round(rate(F.col("level_0_hits"), F.col("duplicates")), 6).alias("level_0_share"), F.round(rate(F.col("level_1_hits"), F.col("duplicates")), 6).alias("level_1_share"),
        F.round(F.col("saved") / 60, 6).alias("minutes_saved"), F.round("avg0", 6).alias("avg_layer_0_time"), F.round("avg_all", 6).alias("avg_time"),
    )


def hashes_of(papers: DataFrame, **stores: DataFrame) -> DataFrame:
    """doc_id with an exists_<name> flag and the newest key of each hash store (key, paper_id, created_at)."""
    out = papers.select("doc_id")
    for name, store in stores.items():
        newest = store.groupBy(F.col("paper_id").alias("doc_id")).agg(F.max_by("key", F.struct("created_at", "key")).alias(f"{name}_key"))
        out = out.join(newest, "doc_id", "left").withColumn(f"exists_{name}", F.col(f"{name}_key").isNotNull())
    return out


def store_coverage(papers: DataFrame, hashes: DataFrame) -> DataFrame:
    """Hashes, join rows and distinct papers that have one, and hashes in percent of papers (over 100 where papers have several)."""
    n = papers.agg(F.count("*").alias("papers"))
    joined = hashes.join(papers.select(F.col("doc_id").alias("paper_id")), "paper_id")
    counts = joined.agg(F.count("*").alias("joined_rows"), F.count_distinct("paper_id").alias("papers_with_hash"))
    return one_row(n, hashes.agg(F.count("*").alias("hashes")), counts).withColumn("coverage", F.round(rate(F.col("hashes"), F.col("papers")), 6))


def newest(hashes: DataFrame, *by: str) -> DataFrame:
    """The newest row for each value of `by`; ties by key."""
    w = Window.partitionBy(*by).orderBy(F.desc("created_at"), F.desc("key"))
    return hashes.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def recent_hashes(hashes: DataFrame, papers: DataFrame, most: int = 10) -> DataFrame:
    """The newest hashes (key, paper_id, created_at) of papers (doc_id, filename) that are there, newest first, with the file's name."""
    named = hashes.join(papers.select(F.col("doc_id").alias("paper_id"), "filename"), "paper_id")
    return named.orderBy(F.desc("created_at"), F.desc("key")).limit(most)
