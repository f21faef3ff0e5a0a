"""Vector stores: nearest rows, pooling, filters."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import vector as fn

#: Results of one search at most; rows of one block of vectors, and of them multiplied at once.
MOST_RESULTS, BLOCK, AT_ONCE = 100, 8192, 256


def where(filters: dict[str, Any]) -> Column:
    """A predicate from {field: value} or {field: {operator: value}}, with $and and $or over lists of such."""
    out = F.lit(True)
    for name, value in filters.items():
        if name in ("$and", "$or"):
            parts = [where(f) for f in value]
            joined = parts[0]
            for p in parts[1:]:
                joined = joined & p if name == "$and" else joined | p
            out = out & joined
            continue
        c = F.col(name)
        for operator, x in (value if isinstance(value, dict) else {"$eq": value}).items():
            known = {"$eq": lambda: c == x, "$ne": lambda: c != x, "$gt": lambda: c > x, "$gte": lambda: c >= x, "$lt": lambda: c < x, "$lte": lambda: c <= x, "$in": lambda: c.isin(*x), "$nin": lambda: ~c.isin(*x)}
            if operator not in known:
                raise ValueError(f"unknown operator {operator}")
            out = out & known[operator]()
    return out


def similar_to(vectors: DataFrame, query: list[float], k: int = 10, filters: dict[str, Any] | None = None) -> DataFrame:
    """(vec_id, similarity) of the k rows nearest to a vector; only k rows of each partition travel."""
    rows = vectors.where(where(filters)) if filters else vectors
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select("vec_id", fn.cosine(F.col("v"), q).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(min(k, MOST_RESULTS))


def similar_documents(vectors: DataFrame, vec_id: int, k: int = 10, filters: dict[str, Any] | None = None, count_self: bool = False) -> DataFrame:
    """The k rows nearest to a stored one, itself left out; with count_self it takes one of the k places first, as older callers expect."""
    found = vectors.where(F.col("vec_id") == vec_id).select("v").first()
    if found is None:
        return vectors.select("vec_id", F.lit(0.0).alias("similarity")).limit(0)
    others = vectors.where(F.col("vec_id") != vec_id)
    return similar_to(others, found["v"], k - 1 if count_self else k, filters)


NEAR = pa.schema([("vec_id", pa.int64()), ("other", pa.int64()), ("similarity", pa.float64())])


def nearest_of(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int) -> pa.RecordBatch:
    """(vec_id, other, similarity) of the k of the normalised rows y nearest to each of x, but for rows of its own id."""
    s = x @ y.T
    s[ids[:, None] == others[None, :]] = -np.inf
    # All that reach the k-th value are kept, so that ties fall to the smaller id.
    least = np.partition(s, -k, 1)[:, -k][:, None] if len(others) > k else np.full((len(ids), 1), -np.inf)
    row, column = np.nonzero((s >= least) & np.isfinite(s))
    order = np.lexsort((others[column], -s[row, column], row))
    row, column = row[order], column[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, column = row[first], column[first]
    return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(others[column]), pa.array(s[row, column])], schema=NEAR)


def nearest_rows(vectors: DataFrame, k: int = 10, same: str | None = None) -> DataFrame:
    """(vec_id, rank, other, similarity) of the k rows nearest to every row; with `same`, among rows of equal value there.

    Rows of a group go into blocks of bounded size; each pair of blocks of a group meets in one task, which multiplies
    them a few rows at a time and keeps k rows for each. All pairs are compared, so rows shuffled grow with a group's
    rows times its blocks: 2 n n / BLOCK.
    """
    group = F.coalesce(F.col(same).cast("string"), F.lit("")) if same else F.lit("")
    named = vectors.select("vec_id", "v", group.alias("g"))
    blocks = named.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    rows = named.join(F.broadcast(blocks) if not same else blocks, "g").withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    left = rows.select("vec_id", "v", "g", F.col("b").alias("i"), every.alias("j"), F.lit(True).alias("asks"))
    right = rows.select("vec_id", "v", "g", every.alias("i"), F.col("b").alias("j"), F.lit(False).alias("asks"))

    def meet(t: pa.Table) -> pa.Table:
        asks, ids = t["asks"].to_numpy(), t["vec_id"].to_numpy()
        cells = t["v"].combine_chunks()
        x = np.stack(cells.to_numpy(zero_copy_only=False)) if len(ids) else np.zeros((0, 1))
        size = np.linalg.norm(x, axis=1)
        x = x / np.where(size > 0, size, 1)[:, None]
        q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
        theirs = x[c]
        found = []
        for lo in range(0, len(q) if len(c) else 0, AT_ONCE):
            own = q[lo : lo + AT_ONCE]
            found.append(nearest_of(ids[own], x[own], ids[c], theirs, k))
        return pa.Table.from_batches(found, NEAR)

    pairs = left.unionByName(right).groupBy("g", "i", "j").applyInArrow(meet, "vec_id long, other long, similarity double")
    order = Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "other")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("vec_id", "rank", "other", "similarity")


def semantic_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, other, similarity): each row's nearest other row, if it is near enough."""
    return nearest_rows(vectors, 1).where(F.col("similarity") >= threshold).select("vec_id", "other", "similarity")


def mean_vectors(vectors: DataFrame, by: str) -> DataFrame:
    """(by, v, n): the normalised mean of each group's vectors, zero ones left out; a sum for each component, so a large group is pre-aggregated."""
    parts = vectors.where(fn.nonzero(F.col("v"))).select(by, F.posexplode("v").alias("i", "x"))
    means = parts.groupBy(by, "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    whole = means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"), F.max("n").alias("n"))
    return whole.withColumn("v", fn.normalized(F.col("v")))


def without_nulls(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda _, v: v.isNotNull())


def page_rows(pages: DataFrame) -> DataFrame:
    """Rows of the page collection: id, preview, metadata without nulls."""
    info = F.create_map(F.lit("page_number"), F.col("page_number").cast("string"), F.lit("model_name"), F.col("model_name"))
    return pages.select(F.concat(F.col("paper_id").cast("string"), F.lit("_page_"), F.col("page_number").cast("string")).alias("id"), "paper_id", F.substring("page_text", 1, 500).alias("preview"), without_nulls(info).alias("metadata"))


def _to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = [None if v is None else np.asarray(v, "<f4").tobytes() for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], names=["key", "data"])


def serialised(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, data): each vector's little-endian single-precision bytes."""
    return df.select(F.col(key).alias("key"), F.col(vector).cast("array<float>")).mapInArrow(_to_bytes, f"key {df.schema[key].dataType.simpleString()}, data binary")


def deserialised(stored: DataFrame, dim: int) -> DataFrame:
    """(key, v, error): the vectors of (key, data); null with an error where the bytes aren't those of dim components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(1).to_pylist()
            fit = [c is not None and len(c) == 4 * dim for c in cells]
            v = pa.array([np.frombuffer(c, "<f4").tolist() if ok else None for c, ok in zip(cells, fit, strict=True)], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), v, pa.array([None if ok else "length" for ok in fit], pa.string())], names=["key", "v", "error"])

    return stored.select("key", "data").mapInArrow(run, f"key {stored.schema['key'].dataType.simpleString()}, v array<float>, error string")


def content_duplicates(vectors: DataFrame, digests: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, duplicate_of, method): an earlier vector of the same bytes, else the nearest other one if it is near enough. digests has (key, digest)."""
    first = digests.groupBy("digest").agg(F.min("key").alias("duplicate_of"))
    same = digests.join(first, "digest").where("key <> duplicate_of").select(F.col("key").alias("vec_id"), "duplicate_of", F.lit("content_id").alias("method"))
    near = semantic_duplicates(vectors.join(same, "vec_id", "left_anti"), threshold)
    return same.unionByName(near.select("vec_id", F.col("other").alias("duplicate_of"), F.lit("vector").alias("method")))
