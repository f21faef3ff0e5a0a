"""Two tokenizers' tokens of the same text, aligned by the bytes they cover.

Both tokenizers cut between a character and a space after it, so tokens of both sides end there and a text is aligned if
its parts are. A task encodes and aligns each distinct part of its texts once. Rows of parts, and after them the texts
that consist of these and of earlier parts, stream through three steps of one stage:

Python tokenises: parts stand one after another in rows of about ROW_BYTES, each token of both sides as one number, its end
and its id, with its bytes, and the offsets at which tokens end.

Spark's array functions align. Offsets where tokens of both sides end (array_intersect) cut a row into groups: tokens and
cuts are sorted together by place, joined and split again. The offsets where a token of either side ends (array_union) cut
it into segments, and each segment is the overlap of just one token of each side, so segments are the links; their ids come
from arrays with one element a byte. No step is quadratic in a text's length.

Python puts the groups and links of each text together from those of its parts, and digests the groups.

Pairs of ids are counted over the corpus and looked up for each link.

Defined results: a null or empty text, and one whose tokens' bytes aren't space and text on either side (a vocabulary
that folds characters), has no tokens: all counts 0, an empty digest column. Special strings inside texts are plain text.
Texts of any length are aligned whole. Rows are told apart by their place, so repeated rows, repeated and null ids each
give a row and count each; ties for an id's highest count are all highest. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import textvec as tv
from foliant.llm.common import bounded_batches, columns, materialize, shared_dir
from foliant.llm.pieces import Paired, paired

#: Up to so many pairs of ids are broadcast with their counts; more are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000
#: More than any id; what is left of a number that holds a place, or an id, above another id. The last marks the end of a group.
ROOM = 1 << 21
GROUP_END = ROOM - 1
#: Characters of the parts that a task remembers at most; then it begins anew.
MEMORY = 4_000_000
#: A row of parts has about so many bytes; a longer part is not cut.
ROW_BYTES = 1 << 14
#: Texts are put together in batches of about so many links; a longer text is a batch of its own.
BATCH_LINKS = 1_000_000
SIDES = ["a", "a_sizes", "a_ends", "b", "b_sizes", "b_ends"]
TOKENS = "doc_id long, first int, parts array<int>, n_a int, n_b int, a array<long>, a_sizes array<int>, a_ends array<int>, b array<long>, b_sizes array<int>, b_ends array<int>"


def _before(counts: np.ndarray) -> np.ndarray:
    """How many come before each place, and all at last."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of runs that begin at starts, one run after another."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


def _lists(flat: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat, kind))


def _part_rows(library: Paired) -> pa.RecordBatch:
    """The parts first met in the last call, in rows: parts has where each ends in its row. A part whose tokens have other bytes has no tokens."""
    new = np.arange(library.new.start, library.new.stop)
    good = library.sound[new]
    sides, size = library.tokens_of(new[good]), np.zeros(len(new), np.int64)
    ids, sizes, own = sides[0]
    size[good] = np.diff(_before(sizes)[_before(own)])
    end = np.cumsum(size)
    lead = np.flatnonzero(np.diff((end - size) // ROW_BYTES, prepend=-1))
    rows, start = np.append(lead, len(new)), (end - size)[lead]
    cells = [_lists((end - np.repeat(start, np.diff(rows))).astype(np.int32), rows, pa.int32())]
    cells += [pa.array(np.zeros(len(lead), np.int32))] * 2
    for ids, sizes, own in sides:
        every = np.zeros(len(new), np.int64)
        every[good] = own
        at = _before(every)[rows]
        ends = np.cumsum(sizes) - np.repeat(start, np.diff(at))
        cells += [_lists(ends * ROOM + ids, at, pa.int64()), _lists(sizes.astype(np.int32), at, pa.int32()), _lists(ends.astype(np.int32), at, pa.int32())]
    return pa.RecordBatch.from_arrays([pa.nulls(len(lead), pa.int64()), pa.array((lead + library.new.start).astype(np.int32)), *cells], names=["doc_id", "first", "parts", "n_a", "n_b", *SIDES])


def tokens(docs: DataFrame, byte_file: str, piece_file: str, memory: int = MEMORY) -> DataFrame:
    """Rows of parts (first: the number of the first part in it; 0 begins anew), and for every row of docs (doc_id, text) one with first -1 and its parts' numbers; a text's parts come before it."""
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = paired(byte_file, piece_file)
        library.forget()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in tv.chunks(texts):
                if library.chars > memory:
                    library.forget()
                parts, at = library.parts_of(texts[lo:hi])
                if library.new:
                    yield _part_rows(library)
                counts = [pa.array(np.diff(_before(np.diff(start)[parts])[at]).astype(np.int32)) for start in library.start]
                none = [_lists(np.zeros(0, np.int64), np.zeros(hi - lo + 1), kind) for kind in (pa.int64(), pa.int32(), pa.int32())]
                cells = [pa.array(np.full(hi - lo, -1, np.int32)), _lists(parts.astype(np.int32), at, pa.int32()), *counts, *none, *none]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), *cells], names=["doc_id", "first", "parts", "n_a", "n_b", *SIDES])
        library.forget()

    return columns(docs, "doc_id", "text").mapInArrow(cut, TOKENS)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is computed once: Spark would repeat an expression inside a lambda for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _group_texts(side: str, marks: Column) -> Column:
    """The ids of one side between the ends of groups, joined by commas. Tokens and marks are numbers that sort by place."""
    ids = F.transform(F.sort_array(F.concat(side, marks)), lambda x: x.bitwiseAND(F.lit(ROOM - 1)))
    return F.split(F.array_join(ids.cast("array<string>"), ","), f",{GROUP_END},?")


def _groups(common: Column) -> Column:
    """`a1,a2|b1;a3|b2,b3`: ids of a group by commas, sides by a bar, groups by semicolons."""
    both = lambda marks: F.zip_with(_group_texts("a", marks), _group_texts("b", marks), lambda a, b: F.concat(a, F.lit("|"), b))
    groups = _bound(F.transform(common, lambda end: end.cast("long") * ROOM + GROUP_END), both)
    return F.array_join(F.slice(groups, 1, F.size(common)), ";")


def _links() -> Column:
    """The links, one for each of ends: numbers of which link_sides gives both ids."""
    at_bytes = lambda side: F.flatten(F.zip_with(side, f"{side}_sizes", lambda x, n: F.array_repeat(x, n)))
    one = lambda at, end: F.get(at["a"], end - 1).bitwiseAND(F.lit(ROOM - 1)) * ROOM + F.get(at["b"], end - 1).bitwiseAND(F.lit(ROOM - 1))
    return _bound(F.struct(at_bytes("a").alias("a"), at_bytes("b").alias("b")), lambda at: F.transform("ends", lambda end: one(at, end)))


class _Parts:
    """The groups, as bytes, and links of a task's parts, by their numbers."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.texts: list[bytes] = []
        self.counts: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
        self.links: list[np.ndarray] = [np.zeros(0, np.int64)]

    def learn(self, rows: pa.RecordBatch) -> None:
        """Take in rows of parts, each cut where its parts end."""
        for first, parts, common, groups, ends, links in zip(*(rows.column(c) for c in ("first", "parts", "common", "groups", "ends", "links")), strict=True):
            if first.as_py() == 0:
                self.forget()
            if first.as_py() != len(self.texts):
                raise RuntimeError("rows of parts came out of order")
            last, said = parts.values.to_numpy(), groups.as_py().encode().split(b";")
            at = [np.searchsorted(x.values.to_numpy(), last, "right") for x in (common, ends)]
            self.texts += [b";".join(said[i:j]) for i, j in pairwise([0, *at[0].tolist()])]
            self.counts.append(np.array([np.diff(x, prepend=0) for x in at]))
            self.links.append(links.values.to_numpy())

    def put_together(self, rows: pa.RecordBatch, keep_groups: bool, limit: int = BATCH_LINKS) -> Iterator[pa.RecordBatch]:
        """The texts that these rows give by their parts, in batches of about limit links."""
        self.counts, self.links = [np.concatenate(self.counts, 1)], [np.concatenate(self.links)]
        before = _before(self.counts[0][1])
        at = _before(rows.column("parts").value_lengths().to_numpy())
        reached = _before(self.counts[0][1][rows.column("parts").flatten().to_numpy()])[at]
        for lo, hi in pairwise([*np.flatnonzero(np.diff(reached[:-1] // limit, prepend=-1)).tolist(), rows.num_rows]):
            yield self._batch(rows.slice(lo, hi - lo), before, keep_groups)

    def _batch(self, rows: pa.RecordBatch, before: np.ndarray, keep_groups: bool) -> pa.RecordBatch:
        """before: how many links come before each part's."""
        numbers, at = rows.column("parts").flatten().to_numpy(), _before(rows.column("parts").value_lengths().to_numpy())
        n_groups, n_links = self.counts[0][:, numbers]
        listed = numbers.tolist()
        groups = [b";".join([self.texts[k] for k in listed[i:j]]) for i, j in pairwise(at.tolist())]
        digests = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
        n = [pa.array(np.diff(_before(x)[at]).astype(np.int32)) for x in (n_groups, n_links)]
        cells = [*(rows.column(c) for c in ("doc_id", "n_a", "n_b")), *n, pa.array(digests, pa.string())]
        kept = [pa.array([g.decode() for g in groups], pa.string())] if keep_groups else []
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * keep_groups, "links"]
        links = self.links[0][_spread(before[numbers], n_links)]
        return pa.RecordBatch.from_arrays([*cells, *kept, _lists(links, _before(n_links)[at], pa.int64())], names=names)


def aligned(cut: DataFrame, keep_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links) of tokens: links as numbers; with keep_groups also groups as text."""
    found = cut.withColumn("common", F.array_intersect("a_ends", "b_ends")).withColumn("ends", F.sort_array(F.array_union("a_ends", "b_ends")))
    found = found.select("doc_id", "first", "parts", "n_a", "n_b", "common", "ends", _groups(F.col("common")).alias("groups"), _links().alias("links"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Parts()
        for batch in batches:
            text = batch.column("first").to_numpy() < 0
            for lo, hi in pairwise([0, *(np.flatnonzero(np.diff(text)) + 1).tolist(), len(text)]):
                if hi > lo and text[lo]:
                    yield from known.put_together(batch.slice(lo, hi - lo), keep_groups)
                elif hi > lo:
                    known.learn(batch.slice(lo, hi - lo))

    return found.mapInArrow(join, f"doc_id long, n_a int, n_b int, n_groups int, n_links int, groups_sha256 string, {'groups string, ' * keep_groups}links array<long>")


def link_sides(link: Column) -> tuple[Column, Column]:
    """The ids of both sides of a link."""
    return F.floor(link / ROOM).cast("int"), link.bitwiseAND(F.lit(ROOM - 1)).cast("int")


def pair_counts(links: DataFrame) -> DataFrame:
    """(link, n, best) of links (link): how often both ids are linked, and whether no partner of the second has more."""
    counts = materialize(links.groupBy("link").agg(F.count("*").alias("n")).withColumn("b", link_sides(F.col("link"))[1]), "align-pairs")
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    return materialize(counts.join(top, "b").select("link", "n", (F.col("n") == F.col("top")).alias("best")), "align-best")


def align(docs: DataFrame, byte_file: str, piece_file: str, broadcast_pairs: int = BROADCAST_PAIRS, keep_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs (doc_id, text); with keep_groups also the groups' text."""
    found = aligned(tokens(docs, byte_file, piece_file), keep_groups).withColumn("row_", F.monotonically_increasing_id())
    path = shared_dir(docs.sparkSession, "align-links")
    found.write.option("compression", "zstd").parquet(path)
    found = docs.sparkSession.read.schema(found.schema).parquet(path)

    links, times = found.select("row_", F.explode("links").alias("link")), F.lit(1)
    pairs = pair_counts(links.select("link"))
    if pairs.count() <= broadcast_pairs:
        pairs = F.broadcast(pairs)
    else:
        links, times = links.groupBy("row_", "link").agg(F.count("*").alias("times")), F.col("times")
    sums = links.join(pairs, "link").groupBy("row_").agg(F.sum(F.when(F.col("best"), times).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("n") * times).alias("count_sum"))
    out = found.drop("links").join(sums, "row_", "left")
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", *[whole(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], "groups_sha256", *(["groups"] if keep_groups else []))
