"""Resampling towards a target distribution: importance weights over hashed features, kept as a sparse count matrix.

Texts become a document-by-bucket count matrix, written as small blocks of compressed sparse rows, of which a task holds
many at once when it reads them again. Its column sums are the
corpus' distribution; the target's come the same way. What a bucket is worth, its gain, is the scaled logarithm of both
distributions' ratio, smoothed by one in each bucket. The product of the matrix and the gains, divided by the row sums,
weighs each document; a Gumbel number drawn from a hash of its id turns the highest scores into a sample without
replacement. The rank of a drawn document comes from a histogram of the integral scores and its place among equal ones,
so no task holds all documents.

Defined results: a null or wordless text has no features, weight 0 and, having too few words, no rank. Words are found in
whole texts, however long; a text has at most as many cells as there are buckets, and all of them are in one block.
A null doc_id hashes as an empty one and comes after others of its score. Rows equal in id and score take consecutive
ranks, in the order of weight and n_features. Tables without rows give none; without a target all gains say how rare a
bucket is. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import bounded_batches, columns, materialize
from foliant.llm.textvec import runs

BUCKETS = 10_000
#: Texts of about so many bytes are counted at once; a longer text by itself.
BLOCK_BYTES = 1 << 20
#: Texts begin a new block of the matrix after so many cells.
BLOCK_CELLS = 2048
#: Up to so many bytes a feature is hashed with all others of its batch.
TOGETHER = 64
#: Scores are counted in steps of so many first.
STEP = 512

#: Bytes that belong to words: digits, small letters, all of other code points.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

BLOCK = "doc_ids array<long>, n_words array<int>, starts array<int>, buckets array<short>, counts array<int>"


def _crc_steps() -> np.ndarray:
    """What the low byte of a CRC-32 register turns into (reflected polynomial 0xEDB88320)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_STEPS = _crc_steps()


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each run of bytes: the k-th bytes of all runs at once, long runs one by one."""
    length = ends - starts
    order = np.argsort(-np.minimum(length, TOGETHER + 1), kind="stable")
    at, size = starts[order], length[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for k in range(min(TOGETHER, int(size[0])) if len(size) else 0):
        m = len(size) - int(np.searchsorted(size[::-1], k, "right"))
        c = crc[:m]
        crc[:m] = _STEPS[(c ^ data[at[:m] + k]) & 255] ^ (c >> 8)
    out = np.empty(len(at), np.uint32)
    out[order] = ~crc
    for i in np.flatnonzero(length > TOGETHER).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each text's begin (and one past the last); null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with a blank after each text, and starts and ends of words."""
    n = np.diff(at)
    spread = np.full(len(data) + len(n), 32, np.uint8)
    spread[np.arange(len(data)) + np.repeat(np.arange(len(n)), n)] = _LOWER[data]
    return spread, *runs(_WORD[spread])


def _runs_of_words(data: np.ndarray, s: np.ndarray, e: np.ndarray, text: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 and text of every run of one to `most` words, joined by one space."""
    if most == 1:
        return crc32_of(data, s, e), text
    n = e - s
    joined = np.full(int(n.sum()) + len(n), 32, np.uint8)
    to = np.cumsum(n + 1) - n - 1
    shift = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    joined[np.repeat(to, n) + shift] = data[np.repeat(s, n) + shift]
    found, owner = [], []
    for k in range(most):
        same = np.flatnonzero(text[: max(0, len(text) - k)] == text[k:])
        found.append(crc32_of(joined, to[same], (to + n)[same + k]))
        owner.append(text[same])
    return np.concatenate(found), np.concatenate(owner)


def _counted(texts: pa.Array, most: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch: first and last text, words of each, and the rows' starts, buckets and counts."""
    data, at = _bytes(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK_BYTES, "right")) - 1)
        part, s, e = _words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        text = np.searchsorted(at[lo:hi] - at[lo] + np.arange(hi - lo), s, "right") - 1
        crc, owner = _runs_of_words(part, s, e, text, most)
        cell, count = np.unique(owner * buckets + (crc % np.uint32(buckets)).astype(np.int64), return_counts=True)
        starts = np.searchsorted(cell, np.arange(hi - lo + 1) * buckets)
        yield lo, hi, np.bincount(text, minlength=hi - lo), starts, cell % buckets, count
        lo = hi


def count_matrix(docs: DataFrame, most_words: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Blocks of the document-by-bucket matrix: ids, words of each document, where its cells start, their buckets and counts."""
    if not 0 < buckets <= 1 << 15:
        raise ValueError("there are 1 to 32768 buckets")
    bounded_batches(docs.sparkSession)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words, starts, bucket, count in _counted(batch.column(1), most_words, buckets):
                first = np.flatnonzero(np.diff(starts[:-1] // BLOCK_CELLS, prepend=-1))
                texts, cells = np.append(first, hi - lo), np.append(starts[first], starts[-1])
                own = np.concatenate([starts[i : j + 1] - starts[i] for i, j in zip(texts[:-1], texts[1:], strict=True)])
                ids = batch.column(0).slice(lo, hi - lo).cast(pa.int64())
                lists = [(ids, texts), (pa.array(words, pa.int32()), texts), (pa.array(own, pa.int32()), texts + np.arange(len(texts))), (pa.array(bucket, pa.int16()), cells), (pa.array(count, pa.int32()), cells)]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat) for flat, at in lists], names=["doc_ids", "n_words", "starts", "buckets", "counts"])

    return columns(docs, "doc_id", "text").mapInArrow(blocks, BLOCK)


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket. A task sums its blocks; as many numbers as there are buckets reach the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0)), _flat(batch.column(1)), buckets).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in matrix.select("buckets", "counts").mapInArrow(sums, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What each bucket is worth: 1000 times the logarithm of how much likelier it is in the target, rounded down."""
    k = len(corpus)
    over, under = float(corpus.sum() + k), float(target.sum() + k)
    return np.array([math.floor(1000 * math.log((t + 1.0) * over / ((s + 1.0) * under))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the matrix times the gains, over the row sums, rounded down."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, words, starts, bucket, count = (batch.column(c).slice(i, 1).flatten() for c in range(5))
                at, count = starts.to_numpy(), count.to_numpy().astype(np.int64)
                size, value = (np.concatenate([[0], np.cumsum(x)]) for x in (count, gain[bucket.to_numpy()] * count))
                n, v = size[at[1:]] - size[at[:-1]], value[at[1:]] - value[at[:-1]]
                yield pa.RecordBatch.from_arrays([ids, words.cast(pa.int64()), pa.array(n), pa.array(v // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return matrix.select("doc_ids", "n_words", "starts", "buckets", "counts").mapInArrow(product, "doc_id long, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """scored (doc_id, n_words, n_features, weight, score) with rank: 1, 2, ... for the highest percent of the rows that have enough words, else null.

    Scores are integers of a narrow range, so their histogram is small whatever the table's size.
    """
    enough = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    counts = materialize(scored.where(enough).groupBy("score").agg(F.count("*").alias("n")).withColumn("step", F.floor(F.col("score") / STEP)), "resample-scores")
    drawn = (counts.agg(F.sum("n").alias("n")).first()["n"] or 0) * percent // 100
    above = lambda w: F.coalesce(F.sum("n").over(w.orderBy(F.desc("of")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = counts.groupBy("step").agg(F.sum("n").alias("n")).withColumn("of", F.col("step"))
    steps = steps.select("step", above(Window.partitionBy()).alias("higher_steps"))
    places = counts.withColumn("of", F.col("score")).withColumn("within", above(Window.partitionBy("step"))).join(F.broadcast(steps), "step")
    places = places.select("score", (F.col("higher_steps") + F.col("within")).alias("higher")).where(F.col("higher") < drawn)
    placed = scored.join(F.broadcast(places), "score", "left").withColumn("higher", F.when(enough, F.col("higher")))
    alike = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "weight", "n_features")
    high = placed.where("higher is not null").withColumn("rank", F.col("higher") + F.row_number().over(alike))
    high = high.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    low = placed.where("higher is null").withColumn("rank", F.lit(None).cast("long"))
    return high.unionByName(low).drop("higher")


def resample(docs: DataFrame, target: DataFrame, most_words: int = 1, buckets: int = BUCKETS, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text); target has texts like those wanted."""
    matrix = materialize(count_matrix(docs, most_words, buckets), "resample-matrix")
    wanted = count_matrix(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), most_words, buckets)
    weighed = weights(matrix, gains(column_sums(matrix, buckets), column_sums(wanted, buckets)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))
    scored = materialize(weighed.withColumn("score", F.col("weight") + gumbel), "resample-scored")
    return ranked(scored, least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")
