"""Best-fit packing by patterns: few lengths that fill a sequence, repeated as non-negative least squares says.

Only the histogram of piece lengths reaches the driver, at most one count for each length up to the sequence length, and
only the resulting pattern list goes back, bounded by the sequence length as well. The rank of a piece among those of its
length, counted in cells of bounded size, decides its slot; pieces are dealt to cells by their place in the written table,
so that pieces alike in everything spread as well.

Defined results: a null or empty text is a document of the closing id alone. Repeated rows are packed each. Of a text
longer than a sequence the first piece may be shorter, all others are full. Other columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm import textvec as tv
from foliant.llm.bpe import encoder
from foliant.llm.common import bounded_batches, columns, materialize, partitions_of

#: Pieces of one length that are ranked in one task, at most about; fewer, down to LEAST_CELL, while there are tasks to spare.
CELL_ROWS, LEAST_CELL = 200_000, 2000
#: Steps of the projected gradient.
STEPS = 400

Pattern = tuple[int, ...]


def pieces(docs: DataFrame, tokenizer: str, length: int = 1024, closing_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and the closing id, cut into pieces."""
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(tokenizer)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in tv.chunks(texts):
                ids, bounds = library.encode(texts[lo:hi])
                out: dict[str, list] = defaultdict(list)
                for i in range(hi - lo):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], closing_id).astype("<u4")
                    ends = np.arange((len(own) - 1) % length + 1, len(own) + 1, length).tolist()
                    for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                        part = own[a:b].tobytes()
                        for name, value in (("row", lo + i), ("piece", k), ("start", a), ("length", b - a), ("ids_crc32", zlib.crc32(part))):
                            out[name].append(value)
                        if keep_ids:
                            out["ids"].append(own[a:b])
                arrays = [names.take(pa.array(out["row"])), pa.array(out["piece"], pa.int32()), *[pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32")]]
                if keep_ids:
                    arrays.append(pa.array(out["ids"], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])

    return columns(docs, "doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids)


def enumerate_patterns(present: np.ndarray, length: int) -> np.ndarray:
    """All ways to fill a sequence exactly with one to three of the present lengths, ascending, 0 for none."""
    have = np.zeros(length + 1, bool)
    have[present] = True
    found = [np.array([[0, 0, length]])] if have[length] else []
    a = present[(present * 2 <= length)]
    a = a[have[length - a]]
    found.append(np.stack([np.zeros_like(a), a, length - a], 1))
    for x in present[present * 3 <= length]:
        y = present[(present >= x) & (present * 2 <= length - x)]
        y = y[have[length - x - y]]
        found.append(np.stack([np.full_like(y, x), y, length - x - y], 1))
    return np.concatenate(found)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """How often to use each pattern: least squares against the histogram with no negative count, by accelerated projected gradient."""
    size = len(histogram)

    def filled(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(patterns[:, k], x, size) for k in range(3))
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return sum(r[patterns[:, k]] for k in range(3))

    v = np.ones(len(patterns))
    for _ in range(20):
        v = back(filled(v))
        norm = np.linalg.norm(v)
        v /= norm
    step, target = 1 / (1.05 * norm), histogram.astype(float)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(STEPS):
        new = np.maximum(0, y - step * back(filled(y) - target))
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (old - 1) / t * (new - x)
    return x


def round_repeats(patterns: np.ndarray, repeats: np.ndarray, histogram: np.ndarray) -> tuple[list[tuple[Pattern, int]], np.ndarray]:
    """Whole repeats, rounded as the caller did, most used patterns first, none beyond what the histogram still has; and what stays unpacked."""
    left, used = histogram.copy(), []
    for i in np.argsort(-repeats, kind="stable"):
        if repeats[i] <= 0:
            break
        lengths = tuple(int(x) for x in patterns[i] if x)
        n = min(int(repeats[i]), *(int(left[x]) // lengths.count(x) for x in lengths))
        if n > 0:
            used.append((lengths, n))
            for x in lengths:
                left[x] -= n
    return used, left


def best_fit(histogram: np.ndarray, length: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on counts: alike sequences are filled together."""
    room: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    for size in range(length, 0, -1):
        count = int(histogram[size])
        while count:
            free = next((f for f in range(size, length) if room[f]), None)
            if free is None:
                each = min(length // size, count)
                n = count // each
                room[length - each * size].append(((size,) * each, n))
                count -= n * each
                continue
            pattern, n = room[free].pop()
            use = min(n, count)
            if n > use:
                room[free].append((pattern, n - use))
            room[free - size].append(((*pattern, size), use))
            count -= use
    return [x for groups in room.values() for x in groups]


def plan_patterns(histogram: np.ndarray, length: int) -> list[tuple[Pattern, int]]:
    """Patterns with repeats that pack the histogram (count by length) whole."""
    full, rest = int(histogram[length]), histogram.copy()
    rest[length] = 0
    present = np.flatnonzero(rest)
    used: list[tuple[Pattern, int]] = [((length,), full)] if full else []
    if len(present):
        patterns = enumerate_patterns(present, length)
        repeats = fit_repeats(patterns, rest) if len(patterns) else np.zeros(0)
        tried = []
        for rounded in (np.floor(repeats), np.floor(repeats * 0.9), np.ceil(repeats)):
            some, residual = round_repeats(patterns, rounded, rest)
            tried.append(some + best_fit(residual, length))
        used += min(tried, key=lambda x: sum(n for _, n in x))
    return used


def slots(plan: list[tuple[Pattern, int]], length: int) -> dict[str, np.ndarray]:
    """For each run of slots of one length: the first rank it takes, how many, the first sequence, the offset there. Sorted by length and rank."""
    taken, rows, sequence = np.zeros(length + 1, np.int64), [], 0
    for pattern, n in plan:
        offset = 0
        for x in pattern:
            rows.append((x, taken[x], sequence, offset))
            taken[x] += n
            offset += x
        sequence += n
    rows.sort()
    return {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(("length", "rank", "sequence", "offset"))}


def ranked(cut: DataFrame) -> DataFrame:
    """cut (place_, length, ...) with `rank`, from 0 among the pieces of equal length. Cells of a length are ranked apart, so a common length is no single task."""
    n = cut.count()
    cells = max(1, -(-n // CELL_ROWS), min(partitions_of(cut), n // LEAST_CELL))
    dealt = cut.withColumn("cell", F.pmod(F.xxhash64("place_"), F.lit(cells)))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "cell").agg(F.count("*").alias("n")).select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("length", "cell").orderBy("place_")) - 1
    return dealt.withColumn("own", own).join(sizes, ["length", "cell"]).withColumn("rank", F.col("first") + F.col("own")).drop("cell", "own", "first")


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, closing_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    cut = pieces(docs, tokenizer, length, closing_id, keep_ids).withColumn("place_", F.monotonically_increasing_id())
    cut = materialize(cut, "packing-pieces")
    histogram = np.zeros(length + 1, np.int64)
    for row in cut.groupBy("length").count().collect():
        histogram[row["length"]] = row["count"]
    table = slots(plan_patterns(histogram, length), length)
    span = int(histogram.max()) + 1
    keys = table["length"] * span + table["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.searchsorted(keys, size * span + rank, "right") - 1
            sequence = table["sequence"][at] + rank - table["rank"][at]
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(sequence), pa.array(table["offset"][at])], names=[*kept, "sequence_id", "offset"])

    order = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids + ", sequence_id long, offset long"
    return ranked(cut).select(*order, "rank").mapInArrow(place, schema)
