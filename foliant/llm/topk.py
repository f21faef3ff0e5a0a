"""Exact top-k by integer inner product: aggregation of sorted lists without random access.

Vectors are dealt to shards and queries to groups by hashes of their ids, and each shard meets each group. A shard keeps one list for each
component, sorted by value, and nothing else: no vector is ever looked up. For a query every list is read from the end
where its products are greatest, all lists in step. A vector's lower bound is what was read of it plus the least products
of the lists where it wasn't met, its upper bound the same with the products last read. Outsiders are all vectors but the
k with the greatest lower bounds, met or not; those whose upper bounds stay below the k-th lower bound are out. When no
outsider can qualify, the lists are read on until they have met the k vectors, whose final scores are then known; with
ties that takes the whole lists.

Bounds are doubles with a margin for their rounding; final scores are summed in longs where every sum fits, else in
Python's integers. Vectors of very different size have lists of their own, so that the margin stays small for each.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, nor do rows without
an id; vectors of other lengths are not compared. Rows with the query's id are its own and no candidates; equal query
rows give one answer. A product that doesn't fit a long counts as the nearest long. Ties go to the smaller vec_id. An
empty table, or one without queries, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.vptree import first_by_score, shard_by_group, usable

SCALE = 256
#: Components below 2 ** SMALL share one set of lists; larger vectors have one for every STEP powers of two.
SMALL, STEP = 12, 16
#: The range of a long, and from where on a double needn't hold an integer exactly, with room for the sums.
LEAST, MOST, EXACT = -(1 << 63), (1 << 63) - 1, 2.0**50
#: Depths, in parts of the last, at which the bounds are looked at; share of the vectors from which on only those still in question are followed.
STEPS, FEW = (2, 8, 16, 24, 32, 38, 44, 50, 56, 60, 64), 0.5
LEAST_SHARD = 4096


def integers(y: np.ndarray) -> np.ndarray:
    """SCALE * y: longs where all fit well, else Python's integers."""
    if np.abs(y).max(initial=0) < 2.0**54:
        return (y * SCALE).astype(np.int64)
    return np.frompyfunc(lambda v: int(v * SCALE) if abs(v) < 2.0**54 else int(v) * SCALE, 1, 1)(y)


def doubles(x: np.ndarray) -> tuple[np.ndarray, int]:
    """x / 2 ** shift as doubles, and the shift that keeps their products finite."""
    if x.dtype != object:
        return x.astype(np.float64), 0
    shift = max(0, largest(x).bit_length() - 64)
    return np.frompyfunc(lambda v: float(v >> shift), 1, 1)(x).astype(np.float64), shift


def largest(x: np.ndarray) -> int:
    """The greatest absolute value."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


class SortedLists:
    """Two lists for each component, from its greatest value down and from its least value up, and nothing by vector.

    rows has the vectors in each list's order, gains how far each value is from the list's last one: the falling lists,
    then the rising ones. whole has the falling lists' values as integers.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.ids, self.most = ids, largest(x)
        near, self.shift = doubles(x)
        falling = np.ascontiguousarray(np.argsort(-near, axis=0, kind="stable").T)
        self.rows = np.vstack([falling, falling[:, ::-1]])
        value = np.take_along_axis(near.T, falling, 1)
        self.first, self.last = value[:, 0], value[:, -1]
        self.gains = np.vstack([value - value[:, -1:], value[:, :1] - value[:, ::-1]])
        self.whole = np.take_along_axis(x.T, falling, 1)

    def top(self, q: np.ndarray, q_id: int, k: int) -> tuple[list[tuple[int, int]], float]:
        """(score, vec_id) of the k best, best first; and the part of the lists that was read."""
        near, shift = doubles(q)
        use = np.flatnonzero(near)
        weight, rising = np.abs(near[use]), near[use] < 0
        lists, wide, n = use + len(q) * rising, len(use), len(self.ids)
        least = np.where(rising, self.first[use], self.last[use]) * near[use]
        most = np.ldexp(1.0, 63 - shift - self.shift)
        greatest = float(np.maximum(np.abs(self.first[use]), np.abs(self.last[use])) @ weight)
        margin = 0.0 if greatest < EXACT and not shift + self.shift else greatest * (len(q) + 16) * 2.0**-48

        def reached(value: np.ndarray) -> float:
            """What a vector's value must reach to be among the k best: products beyond a long are equal."""
            bar = np.partition(value, len(value) - k)[len(value) - k] if len(value) >= k else -np.inf
            return -np.inf if bar - margin <= -most else min(bar, most) - 2 * margin

        lower, alive, at = np.full(n, least.sum()), np.arange(n), 0
        lower[self.ids == q_id] = -np.inf
        each = n * np.arange(wide)[:, None]
        met = place = None  # met: which lists have met which vectors; place: of each vector among the few still in question
        for step in STEPS if wide else ():
            to = -(-n * step // STEPS[-1])
            if to == at:
                continue
            rows, gain = self.rows[lists, at:to], self.gains[lists, at:to]
            gain *= weight[:, None]
            if place is None:
                lower += np.bincount(rows.ravel(), gain.ravel(), n)
                if met is not None:
                    met.ravel()[(rows + each).ravel()] = 1
            else:
                here = place[rows].ravel()
                some = np.flatnonzero(here >= 0)
                lower += np.bincount(here[some], gain.ravel()[some], len(alive))
                met[some // (to - at), here[some]] = 1
            at, gap, bar = to, gain[:, -1], reached(lower)
            if met is None:
                if least.sum() + gap.sum() >= bar and at < n:
                    continue  # a vector that no list has met could still qualify
                met = np.zeros((wide, n), np.float32)
                met.ravel()[(self.rows[lists, :at] + each).ravel()] = 1
            # Where a list hasn't met a vector, its least product stands in the lower bound and the last one read in the upper; what single precision may lose is added.
            upper = lower + (gap.sum() * (1 + wide * 2.0**-22) - np.einsum("j,jn->n", gap.astype(np.float32), met))
            keep = (upper >= bar) & (lower > -np.inf)
            if keep.sum() <= FEW * n:
                alive, lower, met = alive[keep], lower[keep], met[:, keep]
                place = np.full(n, -1)
                place[alive] = np.arange(len(alive))
            if len(alive) <= k and met.all():
                break
        if margin:
            score = self._whole_scores(q, use, rising, alive)
        else:
            alive, score = alive[lower > -np.inf], lower[lower > -np.inf].tolist()
        found = sorted(((min(MOST, max(LEAST, int(s))), v) for s, v in zip(score, self.ids[alive].tolist(), strict=True) if v != q_id), key=lambda f: (-f[0], f[1]))[:k]
        return found, at / max(n, 1)

    def _whole_scores(self, q: np.ndarray, use: np.ndarray, rising: np.ndarray, alive: np.ndarray) -> list[int]:
        """Scores of the vectors in question from the lists' whole values, where doubles don't hold them."""
        place = np.full(len(self.ids), -1)
        place[alive] = np.arange(len(alive))
        here = place[self.rows[use]]
        some, at = np.nonzero(here >= 0)
        score = np.zeros(len(alive), object)
        np.add.at(score, here[some, at], self.whole[use[some], at].astype(object) * q[use[some]].astype(object))
        return score.tolist()


def by_size(x: np.ndarray) -> np.ndarray:
    """The number of the lists that each vector belongs to."""
    return np.maximum(0, -(-(np.frexp(np.abs(x).max(1, initial=0))[1] - SMALL) // STEP))


def quantized(vector: Column) -> Column:
    """floor(256 * x) / 256 of each component, exactly; a large double is whole already."""

    def whole(x: Column) -> Column:
        x = x.cast("double")
        return F.when(F.abs(x) < float(1 << 50), F.floor(x * float(SCALE)).cast("double") / float(SCALE)).otherwise(x)

    return F.transform(vector, whole)


def top_products(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k greatest integer inner products of each query among vectors (vec_id, embedding)."""
    sound = F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    rows = vectors.where(sound).select("vec_id", quantized(F.col("embedding")).alias("vector"))

    def task(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray) -> list[tuple]:
        sizes = by_size(x)
        lists = [SortedLists(integers(x[sizes == v]), ids[sizes == v]) for v in np.unique(sizes)]
        return [(int(q_ids[i]), v, s) for i in range(len(q)) for own in lists for s, v in own.top(integers(q[i]), q_ids[i], k)[0]]

    return first_by_score(shard_by_group(rows, is_query, task, "query_id long, vec_id long, score long", least_shard=LEAST_SHARD), k)
