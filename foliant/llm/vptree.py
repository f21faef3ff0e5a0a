"""Nearest neighbours by cosine: a vantage-point tree per shard, with triangle-inequality pruning relaxed by a factor.

Vectors of one length are dealt to shards by a hash of their id, and every query goes to every shard. A task gets a
shard's vectors first and then its queries, batch by batch: it builds the shard's tree once, over unit vectors (their
chord length is a metric and falls as the cosine grows), lets every query descend to its nearest leaf for a first bound,
and then walks the tree with all the queries at hand that no bound excludes. A subtree is left out for a query if factor
times its lower bound exceeds the distance of the query's last place so far; factor 1 is exact search. Equal vectors are
one point of the tree with its least ids. All points as near as the last place, but for rounding, are kept; their cosines
are then computed anew in one way.

Every vector is shuffled once, every query once for each shard: q * n / SHARD rows of queries. A task holds one shard and
one block of queries, both of bounded size; shards and blocks hold fewer rows of long vectors.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows
without an id; vectors of other lengths are not compared. An empty table, or one without queries, gives no rows. Rows with the query's id are its own and no candidates; equal
query rows give one answer. Ties go to the smaller vec_id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.common import bounded_batches, partitions_of

#: Vectors of a shard and queries of a group, at most about, and the components of either; smaller shards only where there are tasks to spare.
SHARD, LEAST_SHARD, GROUP, CELLS = 16_384, 1024, 16_384, 1 << 20
LEAF = 48
#: Measured against brute force: see README.
FACTOR = 4.0


class Tree:
    """Nodes over the rows of x (unit vectors). A node is (vantage row, inner, outer, bounds of distances to inner and outer rows) or a leaf's rows."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.leaf, rng = x, leaf, np.random.default_rng(3)
        self.nodes: list = []
        self.root = self._build(np.arange(len(x)), rng)

    def _build(self, rows: np.ndarray, rng: np.random.Generator) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        if len(rows) <= self.leaf:
            self.nodes[at] = rows
            return at
        k = rng.integers(len(rows))
        vantage, rows = rows[k], np.delete(rows, k)
        d = chord(self.x[rows] @ self.x[vantage])
        half = len(rows) // 2
        part = np.argpartition(d, half)
        inner, outer = part[:half], part[half:]
        bounds = (d[inner].min(), d[inner].max(), d[outer].min(), d[outer].max())
        self.nodes[at] = (vantage, self._build(rows[inner], rng), self._build(rows[outer], rng), bounds)
        return at

    def search(self, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """For each unit vector of q the rows of its k nearest, and their cosines; -1 and -inf where there are fewer."""
        best, score = np.full((len(q), k), -1), np.full((len(q), k), -np.inf)
        leaf_of = np.empty(len(q), int)
        self._descend(self.root, q, np.arange(len(q)), leaf_of)
        for leaf in np.unique(leaf_of):
            self._offer(q, np.flatnonzero(leaf_of == leaf), self.nodes[leaf], best, score)
        stack = [(self.root, np.arange(len(q)))]
        while stack:
            at, who = stack.pop()
            node = self.nodes[at]
            if isinstance(node, np.ndarray):
                who = who[leaf_of[who] != at]
                if len(who):
                    self._offer(q, who, node, best, score)
                continue
            vantage, inner, outer, (a, b, c, d) = node
            cosine = q[who] @ self.x[vantage]
            self._offer(q, who, np.array([vantage]), best, score, cosine[:, None])
            to = chord(cosine)
            last = chord(score[who, -1]) + 1e-7
            for child, low, high in ((outer, c, d), (inner, a, b)):
                bound = np.maximum(np.maximum(to - high, low - to), 0)
                go = who[factor * bound <= last]
                if len(go):
                    stack.append((child, go))
        return best, score

    def within(self, q: np.ndarray, least: float, factor: float) -> np.ndarray:
        """The rows whose cosine with the unit vector q is at least `least`, as far as the relaxed bounds leave their subtrees in."""
        out, stack, last = [], [self.root], chord(np.float64(least)) + 1e-7
        while stack:
            node = self.nodes[stack.pop()]
            rows = node if isinstance(node, np.ndarray) else np.array([node[0]])
            cosine = self.x[rows] @ q
            out.append(rows[cosine >= least])
            if not isinstance(node, np.ndarray):
                _, inner, outer, (a, b, c, d) = node
                to = chord(cosine[0])
                stack += [child for child, low, high in ((outer, c, d), (inner, a, b)) if factor * max(to - high, low - to, 0) <= last]
        return np.concatenate(out)

    def _descend(self, at: int, q: np.ndarray, who: np.ndarray, leaf_of: np.ndarray) -> None:
        node = self.nodes[at]
        if isinstance(node, np.ndarray):
            leaf_of[who] = at
            return
        vantage, inner, outer, (_, b, c, _) = node
        near = chord(q[who] @ self.x[vantage]) <= (b + c) / 2
        for child, some in ((inner, who[near]), (outer, who[~near])):
            if len(some):
                self._descend(child, q, some, leaf_of)

    def _offer(self, q: np.ndarray, who: np.ndarray, rows: np.ndarray, best: np.ndarray, score: np.ndarray, cosine: np.ndarray | None = None) -> None:
        if not len(rows):
            return
        cosine = q[who] @ self.x[rows].T if cosine is None else cosine
        better = np.flatnonzero(cosine.max(1) > score[who, -1])
        if len(better):
            who, cosine = who[better], cosine[better]
            both = np.hstack([score[who], cosine])
            order = np.argsort(-both, 1, kind="stable")[:, : score.shape[1]]
            ids = np.hstack([best[who], np.broadcast_to(rows, cosine.shape)])
            score[who], best[who] = np.take_along_axis(both, order, 1), np.take_along_axis(ids, order, 1)


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


def distinct_rows(x: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct rows of x, and for each the least `most` of its ids, ascending."""
    order = np.argsort(ids, kind="stable")
    x, ids = np.ascontiguousarray(x[order]), ids[order]
    _, first, of = np.unique(x.view([("", x.dtype)] * x.shape[1]).ravel(), return_index=True, return_inverse=True)
    by = np.argsort(of, kind="stable")
    groups = np.split(ids[by], np.cumsum(np.bincount(of))[:-1])
    return x[first], [np.unique(g)[:most] for g in groups]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by powers of two such that their largest components lie between 1/2 and 1: cosines stay what they are, squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def cosines(points: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of scaled rows with one scaled vector, computed in more digits than a double and rounded once, so that what is equal comes out equal."""
    a, b = points.astype(np.longdouble), q.astype(np.longdouble)
    return ((a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum())).astype(np.float64)


class Shard:
    """The tree of a shard's distinct vectors, made once for all its queries."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, k: int, factor: float):
        self.k, self.factor, self.slack = k, factor, (x.shape[1] + 16) * 2.0**-50
        points, self.owners = distinct_rows(x, ids, k + 1)
        self.points = scaled(points)
        self.tree = Tree(self.points / np.linalg.norm(self.points, axis=1, keepdims=True))

    def search(self, q: np.ndarray, q_ids: np.ndarray) -> list[tuple[int, int, float]]:
        """(query's id, vec_id, cosine) of each query's k nearest in the shard, least ids first among equals.

        One point more than k is kept for the query itself, and one more to see whether others may be as near as the last:
        then all that come as near, but for rounding, are gathered.
        """
        k, q = self.k, scaled(q)
        asked = q / np.linalg.norm(q, axis=1, keepdims=True)
        found, near = self.tree.search(asked, min(k + 2, len(self.points)), self.factor)
        out = []
        for i in range(len(q)):
            rows = found[i][found[i] >= 0]
            if len(rows) == k + 2 and near[i, k + 1] >= near[i, k] - self.slack:
                rows = self.tree.within(asked[i], near[i, k] - self.slack, self.factor)
            hits = sorted((-c, v) for r, c in zip(rows.tolist(), cosines(self.points[rows], q[i]).tolist(), strict=True) for v in self.owners[r].tolist() if v != q_ids[i])
            out += [(int(q_ids[i]), v, -c) for c, v in hits[:k]]
        return out


def in_shards(batches: Iterator[pa.RecordBatch], build: Callable[[np.ndarray, np.ndarray], Shard]) -> Iterator[list[tuple[int, int, float]]]:
    """What each shard finds for its queries, block by block, out of rows (dim, shard, asks, vec_id, vector) in order of the first three."""
    key, tree, held = None, None, ([], [])

    def taken(side: int) -> tuple[np.ndarray, np.ndarray]:
        parts, held[side][:] = list(held[side]), []
        return np.concatenate([x for x, _ in parts]), np.concatenate([i for _, i in parts])

    def found() -> list[tuple[int, int, float]]:
        nonlocal tree
        if not held[1]:
            return []
        q, ids = taken(1)
        if tree is None and held[0]:
            tree = build(*taken(0))
        return tree.search(q, ids) if tree else []

    for batch in batches:
        dim, shard, asks, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        cuts = np.flatnonzero((np.diff(dim) != 0) | (np.diff(shard) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(ids)], strict=True):
            if hi > lo and (dim[lo], shard[lo]) != key:
                yield found()
                key, tree = (dim[lo], shard[lo]), None
                held[0].clear()
            if hi > lo:
                x = pc.list_flatten(batch.column(4).slice(lo, hi - lo)).to_numpy().reshape(hi - lo, -1)
                held[int(asks[lo])].append((x, ids[lo:hi]))
            if sum(len(i) for _, i in held[1]) >= block_of(int(dim[lo])):
                yield found()
    yield found()


def block_of(dim: int) -> int:
    """So many queries of this length are searched at once."""
    return max(64, min(GROUP, CELLS // max(1, dim)))


def usable(vector: Column) -> Column:
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def shard_by_group(vectors: DataFrame, is_query: Column, task: Callable, schema: str, shard: int = SHARD, group: int = GROUP, least_shard: int = LEAST_SHARD) -> DataFrame:
    """Apply task to every shard of vectors with every group of queries, of each vector length.

    vectors has (vec_id, vector). The task gets (ids, x, query ids, queries) and returns rows of the schema.
    """
    lengths = {r["dim"]: (r["n"], r["q"]) for r in vectors.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).collect()}
    spare = partitions_of(vectors)
    shards, groups = F.lit(1), F.lit(1)
    for dim, (n, q) in lengths.items():
        fit = max(64, CELLS // max(1, dim))
        many = max(-(-n // min(shard, fit)), min(spare, n // least_shard), 1)
        shards = F.when(F.size("vector") == dim, many).otherwise(shards)
        groups = F.when(F.size("vector") == dim, max(1, -(-q // min(group, fit)))).otherwise(groups)
    sized = vectors.select("vec_id", "vector", F.size("vector").alias("dim"), shards.alias("shards"), groups.alias("groups"), is_query.alias("asks"))
    index = sized.select("dim", F.pmod(F.xxhash64("vec_id"), "shards").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(False).alias("asks"), "vec_id", "vector")
    queries = sized.where("asks").dropDuplicates(["vec_id", "vector"])
    queries = queries.select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("vec_id"), "groups").cast("int").alias("group"), "asks", "vec_id", "vector")

    def run(rows: pa.Table) -> pa.Table:
        asks = rows["asks"].to_numpy()
        ids = rows["vec_id"].to_numpy()
        cells = rows["vector"].combine_chunks()
        x = pc.list_flatten(cells).to_numpy().reshape(len(ids), -1)
        names = [f.split(" ")[0] for f in schema.split(", ")]
        found = task(ids[~asks], x[~asks], ids[asks], x[asks]) if asks.any() and not asks.all() else []
        return pa.table([pa.array([f[i] for f in found], kind) for i, kind in enumerate(KINDS[f.split(" ")[1]] for f in schema.split(", "))], names=names)

    return index.unionByName(queries).groupBy("dim", "shard", "group").applyInArrow(run, schema)


KINDS = {"long": pa.int64(), "double": pa.float64()}


def first_by_score(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ranked from 1; ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest of each query among vectors (vec_id, embedding)."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(F.exists("vector", lambda x: x != 0))

    dim = F.size("vector")
    n, cells, longest = rows.agg(F.count("*"), F.coalesce(F.sum(dim), F.lit(0)), F.coalesce(F.max(dim), F.lit(1))).first()
    spare = partitions_of(vectors)
    shards = max(-(-n // SHARD), -(-cells // CELLS), min(spare, n // LEAST_SHARD), 1)
    bounded_batches(vectors.sparkSession, max(1, min(2048, CELLS // longest)))

    index = rows.select(dim.alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "vec_id", "vector")
    queries = rows.where(is_query).dropDuplicates(["vec_id", "vector"])
    queries = queries.select(dim.alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "vector")
    both = index.unionByName(queries).repartition(max(spare, shards), "dim", "shard").sortWithinPartitions("dim", "shard", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hits in in_shards(batches, lambda x, ids: Shard(x, ids, k, factor)):
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return first_by_score(both.mapInArrow(run, "query_id long, vec_id long, score double"), k)
