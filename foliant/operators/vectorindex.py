"""A stored index over vectors: an inverted file of cells around centroids, as a table in versions.

Centroids are fitted by k-means on a bounded sample, and every row then belongs to the cell of its nearest centroid. The
rows are a store of `versions` with a partition for each cell, so that adding, changing or deleting rows writes only the
cells these are in. A search looks into the few cells whose centroids are nearest to its query; other cells' folders
aren't read. Looking into all cells is exact search.

Vectors are kept normalised, so that nearness is the cosine; zero vectors are near nothing and are kept in cell -1, which
no search reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import vector as fn
from foliant.operators import versions
from foliant.operators.vectors import AT_ONCE, nearest_of

#: Rows that centroids are fitted on at most; rows of a block of a cell.
SAMPLE, BLOCK = 50_000, 8192
NO_CELL = -1


def fit(vectors: DataFrame, cells: int, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Centroids (cells x dim) of vectors (vec_id, v), fitted on at most about `sample` rows chosen by a hash of their ids."""
    rows = vectors.where(fn.nonzero(F.col("v")))
    n = rows.count()
    if not n:
        return np.zeros((0, 0))
    kept = rows if n <= sample else rows.where(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    points = kept.select(array_to_vector(fn.normalized(F.col("v"))).alias("features"))
    model = KMeans(k=max(2, min(cells, n)), seed=seed, maxIter=12, distanceMeasure="cosine").fit(points)
    found = np.stack(model.clusterCenters())
    return found / np.maximum(np.linalg.norm(found, axis=1), 1e-12)[:, None]


def _nearest_cells(vectors: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """(vec_id, v, cells): normalised vectors and the cells of their nearest centroids, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            size = np.linalg.norm(x, axis=1)
            x = x / np.where(size > 0, size, 1)[:, None]
            order = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            cells = [[NO_CELL] if s == 0 else o.tolist() for s, o in zip(size, order, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), pa.array(cells, pa.list_(pa.int32()))], names=["vec_id", "v", "cells"])

    return vectors.select("vec_id", F.col("v").cast("array<double>")).where("v is not null").mapInArrow(run, "vec_id long, v array<double>, cells array<int>")


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, v, cell) of vectors (vec_id, v)."""
    return _nearest_cells(vectors, centroids, 1).select("vec_id", "v", F.get("cells", F.lit(0)).alias("cell"))


def build(vectors: DataFrame, folder: str, cells: int, sample: int = SAMPLE) -> int:
    """Index vectors (vec_id, v) in a new folder; the number of the index' version."""
    centroids = fit(vectors, cells, sample)
    spark = vectors.sparkSession
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.json(f"{folder}/centroids")
    return versions.commit(assigned(vectors, centroids), folder, F.col("cell"), note="built")


def centroids_of(spark: SparkSession, folder: str) -> np.ndarray:
    """The centroids of an index: as many rows as it has cells."""
    rows = sorted(spark.read.schema("cell int, centroid array<double>").json(f"{folder}/centroids").collect())
    return np.array([r["centroid"] for r in rows]).reshape(len(rows), -1)


def upsert(vectors: DataFrame, folder: str, gone: DataFrame | None = None) -> int:
    """Add or replace rows (vec_id, v), and delete those of gone (vec_id); the number of the new version."""
    spark = vectors.sparkSession
    placed = assigned(vectors, centroids_of(spark, folder))
    now = versions.read(spark, folder).select("vec_id", F.col("cell").cast("string").alias("part"))
    return versions.merge(placed, folder, "vec_id", F.col("cell"), gone=gone, where=now)


def similar_to(spark: SparkSession, folder: str, query: list[float], k: int = 10, probes: int | None = None) -> DataFrame:
    """(vec_id, similarity) of the k rows nearest to one vector, of the cells nearest to it; of all cells without probes."""
    q = np.asarray(query, float)
    centroids = centroids_of(spark, folder)
    order = np.argsort(-(centroids @ q), kind="stable")[: probes or len(centroids)]
    rows = versions.read(spark, folder, parts=[str(c) for c in order.tolist()])
    asked = F.array(*[F.lit(float(x)) for x in q])
    return rows.select("vec_id", fn.cosine(F.col("v"), asked).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(k)


def nearest(queries: DataFrame, folder: str, k: int = 10, probes: int | None = None) -> DataFrame:
    """(vec_id, rank, other, similarity) of the k indexed rows nearest to each of queries (vec_id, v), the row of its own id left out.

    A query goes to its cells, a cell of many rows is dealt to blocks, and each block meets a cell's queries in one task,
    which holds the block and lets the queries pass. Rows that travel are the indexed ones once, and each query once for
    each block of its cells.
    """
    spark = queries.sparkSession
    centroids = centroids_of(spark, folder)
    rows = versions.read(spark, folder).where(F.col("cell") != NO_CELL)
    blocks = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(blocks), "cell").select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("asks"))
    asked = _nearest_cells(queries, centroids, probes or len(centroids)).select("vec_id", "v", F.explode("cells").alias("cell"))
    asked = asked.join(F.broadcast(blocks), "cell").select("vec_id", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"))

    both = rows.unionByName(asked).repartition("cell", "block").sortWithinPartitions("cell", "block", "asks")
    pairs = both.mapInArrow(lambda batches: met(batches, k), "vec_id long, other long, similarity double")
    order = Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "other")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("vec_id", "rank", "other", "similarity")


def met(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, other, similarity) of the k rows of its block nearest to each query. Batches (vec_id, v, cell, block, asks) are in the order of the last three, so a block's rows come before its queries; only they are held."""
    block, ids, held = None, [], []
    for batch in batches:
        x = np.array(batch["v"].flatten()).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))
        own, *places = (np.array(batch[c]) for c in ("vec_id", "cell", "block", "asks"))
        cuts = np.flatnonzero(np.any([p[1:] != p[:-1] for p in places], 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(own)], strict=True) if len(own) else ():
            now = places[0][lo], places[1][lo]
            if now != block:
                block, ids, held = now, [], []
            if not places[2][lo]:
                ids.append(own[lo:hi])
                held.append(x[lo:hi])
            elif ids:
                ids, held = [np.concatenate(ids)], [np.concatenate(held)]
                for at in range(lo, hi, AT_ONCE):
                    yield nearest_of(own[at : min(hi, at + AT_ONCE)], x[at : min(hi, at + AT_ONCE)], ids[0], held[0], k)


def probes_for(queries: DataFrame, folder: str, k: int = 10, target: float = 0.9, sample: int = 256) -> int:
    """The least number of cells to look into for this recall, measured exactly on a sample of queries (vec_id, v): how far down each query's list of cells its true neighbours are."""
    spark = queries.sparkSession
    centroids = centroids_of(spark, folder)
    asked = queries.orderBy(F.xxhash64(F.lit(11), "vec_id")).limit(sample)
    asked = spark.createDataFrame(asked.select("vec_id", "v").collect(), "vec_id long, v array<double>")
    exact = nearest(asked, folder, k).select("vec_id", F.col("other").alias("near"))
    cells = versions.read(spark, folder).select(F.col("vec_id").alias("near"), "cell")
    lists = _nearest_cells(asked, centroids, len(centroids)).select("vec_id", "cells")
    places = exact.join(cells, "near").join(F.broadcast(lists), "vec_id").select(F.array_position("cells", F.col("cell")).alias("place"))
    counts = sorted((r["place"], r["count"]) for r in places.groupBy("place").count().collect())
    wanted, seen = target * sum(n for _, n in counts), 0
    for place, n in counts:
        seen += n
        if seen >= wanted:
            return int(place)
    return max(1, len(centroids))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact results (vec_id, other) that were found."""
    wanted = exact.select("vec_id", "other")
    total = wanted.count()
    return found.select("vec_id", "other").join(wanted, ["vec_id", "other"], "left_semi").count() / total if total else 1.0


def describe(spark: SparkSession, folder: str) -> DataFrame:
    """(cell, rows) of the newest version."""
    return versions.entries(spark, folder).select(F.col("part").cast("int").alias("cell"), "rows")
