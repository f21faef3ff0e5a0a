"""Near duplicates: MinHash bands find candidates, odd sketches sift them, full shingle sets confirm them.

Texts with equal shingle sets form one class, and all later work is on classes. Classes that share a band meet in that
band's bucket. In each bucket every class is first held against one pivot only, the bucket's least class; of its pivots
a class is confirmed against the one whose odd sketch is nearest. That joins almost all that belongs together, with at
most one pair for each class. What a bucket then still holds in different components is compared through the sketches,
outsiders of the bucket's main component against all its classes, in blocks; pairs whose sketches don't rule out the
threshold are confirmed on the full sets, inside the block, which returns confirmed links only. So no bucket is capped, and no group of copies becomes all its pairs.

Defined results: a null or wordless text has an empty set, n_shingles 0, is linked with nothing and is kept. Rows are
classed by their text, so repeated rows are copies of each other, and rows of one id with different texts are in the
classes of their texts. A null doc_id joins its class; the component is then named by the least doc_id there is, null if
there is none. Texts of any length are taken whole; an empty table gives no rows. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import textvec as tv
from foliant.llm.common import bounded_batches, columns, materialize, named
from foliant.llm.graph import components

#: 128 hash functions in 32 bands of 4: two sets of similarity 0.75 miss every band with probability 5e-6.
BANDS, ROWS = 32, 4
SKETCH_BITS = 512
SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]
#: Differing bits up to which a pair goes on to the exact check. At similarity 0.75 the mean is 57, the deviation 9.
SKETCH_LIMIT = 104
#: A list of so many ids at most is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Buckets of up to so many classes are compared by a join; larger ones in blocks of about so many shingles a side.
FEW, BLOCK_SHINGLES = 16, 250_000

_random = np.random.default_rng(20240601)
_XOR = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None], width: int = 5) -> Iterator[list[np.ndarray]]:
    """For each text the sorted distinct hashes of its shingles, chunk by chunk."""
    for lo, hi in tv.chunks(texts):
        cp, at = tv.codepoints(texts[lo:hi])
        cp = tv.lower_ascii(cp)
        s, e, first = tv.words(cp, at)
        word = tv.word_hashes(cp, s, e)
        rolled = np.zeros(max(0, len(word) - width + 1), np.uint64)
        for k in range(width):
            rolled += tv.mix(word[k : k + len(rolled)] + np.uint64(k + 1))
        rolled = tv.mix(rolled)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                h = np.sort(rolled[a : b - width + 1])
                out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
            elif b > a:
                whole = np.uint64(b - a)
                for k in range(a, b):
                    whole = tv.mix(np.array([whole ^ word[k]], np.uint64) * np.uint64(31))[0]
                out.append(np.array([whole], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
        yield out


def _signed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (sets x BANDS) and odd sketches (sets x words) of sets that aren't empty."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]])
    least = np.empty((BANDS * ROWS, len(sets)), np.uint64)
    for k in range(BANDS * ROWS):
        least[k] = np.minimum.reduceat((flat ^ _XOR[k]) * _MUL[k], at)
    numbered = tv.mix(least + np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15))
    keys = np.zeros((BANDS, len(sets)), np.uint64)
    for r in range(ROWS):
        keys = tv.mix(keys + numbered[r::ROWS][:BANDS])
    bit = (numbered % np.uint64(SKETCH_BITS)).astype(np.int64) + np.arange(len(sets)) * SKETCH_BITS
    odd = np.bincount(bit.ravel(), minlength=len(sets) * SKETCH_BITS).astype(np.uint8) & 1
    return keys.T.view(np.int64), np.packbits(odd.reshape(len(sets), SKETCH_BITS), axis=1).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        lo = 0
        for sets in shingle_sets(texts):
            full = [i for i, x in enumerate(sets) if len(x)]
            prints: list[bytes | None] = [None] * len(sets)
            bands: list[np.ndarray | None] = [None] * len(sets)
            sketch = np.zeros((len(sets), len(SKETCH)), np.int64)
            if full:
                keys, sketch[full] = _signed([sets[i] for i in full])
                for j, i in enumerate(full):
                    prints[i], bands[i] = _print(sets[i]), keys[j]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, len(sets)), pa.array([len(x) for x in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())), *[pa.array(sketch[:, i]) for i in range(len(SKETCH))]],
                names=["doc_id", "n_shingles", "fp", "bands", *SKETCH],
            )
            lo += len(sets)


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, fp, bands, s0..): fp names the shingle set, null if it is empty."""
    if width != 5:
        raise ValueError("shingles have five words")
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_shingles long, fp binary, bands array<long>, " + ", ".join(f"{c} long" for c in SKETCH)
    return columns(docs, "doc_id", "text").mapInArrow(_signatures, schema)


def _print(shingles: np.ndarray) -> bytes:
    """What names a set of shingles."""
    return hashlib.md5(shingles.tobytes()).digest()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for sets in shingle_sets(batch.column(0).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array([_print(x) for x in sets], pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["fp", "shingles"])


def _full_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(fp, shingles) of the needed classes, once each. Texts are found by the least id of a class; each names its own set, so rows that share an id, or have none, can't be taken for each other."""
    ids = materialize(needed.select("least").distinct(), "minhash-ids")
    texts, known = columns(docs, "doc_id", "text").where("text is not null"), ids.where("least is not null")
    found = texts.join(sized_broadcast(known, known.count()), F.col("doc_id") == F.col("least"), "left_semi").select("text")
    if not ids.where("least is null").isEmpty():
        found = found.union(texts.where("doc_id is null").select("text"))
    sets = materialize(found.mapInArrow(_sets, "fp binary, shingles array<long>"), "minhash-sets")
    return sets if sets.groupBy("fp").count().where("count > 1").isEmpty() else sets.dropDuplicates(["fp"])


def sized_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it was counted and is small enough; else Spark shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _differing() -> Column:
    return sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in SKETCH), F.lit(0))


def _comparable(similarity: float) -> Column:
    """Sizes that allow the similarity."""
    return (F.col("x.n") >= similarity * F.col("y.n")) & (F.col("y.n") >= similarity * F.col("x.n"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets are similar enough."""
    x, y = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("xs")), sets.select(F.col("fp").alias("b"), F.col("shingles").alias("ys"))
    both = F.size(F.array_intersect("xs", "ys"))
    joined = pairs.join(x, "a").join(y, "b").select("a", "b", F.size("xs").alias("nx"), F.size("ys").alias("ny"), both.alias("both"))
    return joined.where(F.col("both") * 100 >= (F.col("nx") + F.col("ny") - F.col("both")) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text)."""
    similarity = percent / 100
    signed = materialize(signatures(docs), "minhash-signatures")
    classes = signed.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), *[F.first(c).alias(c) for c in SKETCH])
    classes = materialize(classes, "minhash-classes")
    members = classes.select("fp", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("m"), F.min("fp").alias("pivot")).where("m > 1")
    members = materialize(members.join(shared, "bucket").select("bucket", "pivot", "fp"), "minhash-members")

    needed = members.select("fp").distinct().join(classes, "fp").select("fp", "least", "n", *SKETCH)
    needed = materialize(needed, "minhash-needed")
    sets = _full_sets(docs, needed)

    pairs = members.where("fp <> pivot").select("fp", "pivot").distinct()
    near = pairs.alias("p").join(needed.alias("x"), F.col("p.fp") == F.col("x.fp")).join(needed.alias("y"), F.col("p.pivot") == F.col("y.fp")).where(_comparable(similarity)).select(F.col("p.fp").alias("a"), F.col("p.pivot").alias("b"), _differing().alias("apart")).where(F.col("apart") <= SKETCH_LIMIT)
    nearest = near.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))
    links = materialize(_confirmed(nearest, sets, percent), "minhash-links")
    comps = components(links)

    torn = materialize(_torn(members, needed, comps), "minhash-torn")
    few = materialize(_few(torn.where(F.col("m") <= FEW), similarity), "minhash-few")
    more = _confirmed(few, sets, percent).union(_many(torn.where(F.col("m") > FEW), sets, percent))
    more = materialize(more, "minhash-links")
    if not more.isEmpty():
        comps = components(links.union(more))

    labels = classes.select("fp", "least").join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp"))
    names = labels.groupBy("comp").agg(F.min("least").alias("component"))
    labels = labels.join(names, "comp").select("fp", "component")
    out = signed.select("doc_id", "n_shingles", "fp").join(labels, "fp", "left")
    found = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.col("doc_id").eqNullSafe(found).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """Rows of docs without the near duplicates of a document with a lesser id; of rows with that id, and of those without one, all stay."""
    found = near_duplicates(docs)
    gone = materialize(found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept").select("doc_id"), "minhash-gone")
    return docs.join(sized_broadcast(gone, gone.count()), "doc_id", "left_anti").select(*[named(c) for c in docs.columns])


def _torn(members: DataFrame, needed: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of buckets that hold several components: bucket, fp, comp, n, sketch; main, the bucket's largest component; m, its members; volume and outer, the shingles of all and of those outside the main component."""
    placed = members.select("bucket", "fp").join(comps.withColumnRenamed("node", "fp"), "fp", "left").join(needed, "fp").select("bucket", "fp", F.coalesce("comp", "fp").alias("comp"), "n", *SKETCH)
    sizes = placed.groupBy("bucket", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("volume"))
    buckets = sizes.groupBy("bucket").agg(F.max(F.struct("m", "comp", "volume")).alias("top"), F.count("*").alias("parts"), F.sum("m").alias("m"), F.sum("volume").alias("volume")).where("parts > 1")
    return placed.join(buckets.select("bucket", F.col("top.comp").alias("main"), "m", "volume", (F.col("volume") - F.col("top.volume")).alias("outer")), "bucket")


def _few(torn: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of small buckets in different components whose sketches are near."""
    x, y = torn.alias("x"), torn.alias("y")
    on = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.fp") < F.col("y.fp"))
    return x.join(y, on & _comparable(similarity) & (_differing() <= SKETCH_LIMIT)).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()


def _many(torn: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components of large buckets: those outside the main component against all, in blocks of bounded volume. A block returns one link for each class and component it reaches."""
    whole = torn.join(sets, "fp").withColumn("inner_blocks", F.ceil(F.col("volume") / BLOCK_SHINGLES).cast("int")).withColumn("outer_blocks", F.ceil(F.col("outer") / BLOCK_SHINGLES).cast("int"))
    own = ["fp", "comp", "n", *SKETCH, "shingles"]
    spread = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    outside = whole.where("comp <> main").withColumn("i", F.pmod(F.hash("fp"), F.col("outer_blocks"))).withColumn("j", spread("inner_blocks")).select("bucket", "i", "j", F.lit(True).alias("outside"), *own)
    everyone = whole.withColumn("j", F.pmod(F.hash("fp"), F.col("inner_blocks"))).withColumn("i", spread("outer_blocks")).select("bucket", "i", "j", F.lit(False).alias("outside"), *own)

    def block(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        outer, n = rows["outside"].to_numpy(), rows["n"].to_numpy()
        sketch = np.stack([rows[c].to_numpy() for c in SKETCH], 1).view(np.uint64)
        comp = pd.factorize(np.array(rows["comp"].to_pylist(), object))[0]
        cells = rows["shingles"].combine_chunks()
        code, distinct = pd.factorize(cells.flatten().to_numpy())
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(cells).to_numpy())])
        inner, found = np.flatnonzero(~outer), []
        for y in np.flatnonzero(outer).tolist():
            near = (np.bitwise_count(sketch[inner] ^ sketch[y]).sum(1) <= SKETCH_LIMIT) & (comp[inner] != comp[y]) & (n[inner] * 100 >= percent * n[y]) & (n[y] * 100 >= percent * n[inner])
            xs = inner[near]
            if len(xs):
                mark = np.zeros(len(distinct), np.int64)
                mark[code[at[y] : at[y + 1]]] = 1
                size = at[xs + 1] - at[xs]
                flat = code[np.repeat(at[xs] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                both = np.add.reduceat(mark[flat], np.cumsum(size) - size)
                hit = xs[both * 100 >= (size + n[y] - both) * percent]
                found += [(y, x) for x in hit[np.unique(comp[hit], return_index=True)[1]].tolist()]
        a, b = ([f[k] for f in found] for k in (0, 1))
        return pa.table({"a": rows["fp"].take(pa.array(a, pa.int64())), "b": rows["fp"].take(pa.array(b, pa.int64()))})

    return outside.union(everyone).groupBy("bucket", "i", "j").applyInArrow(block, "a binary, b binary")
