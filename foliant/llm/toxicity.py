"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their beginnings of three to seven letters, hashed. The machine adds to each present
term's weight the inner product of the factors of each pair of present terms, so that words that are harmful only
together count together. It is fitted on a bounded sample (POSITIVE and NEGATIVE labelled texts that aren't held out)
over all terms of at least LEAST_TEXTS sampled texts; a ridge holds back those that say little. Weights are learned first,
then factors with them. Every text is scored whole.

Defined results: a null or empty text has no terms and gets the score of the bias. Without labels of both kinds every
score is the share of label 1, or 0. Of several labels of a document the greatest holds. Rows are scored one by one, so
repeated rows agree, and a score of just the threshold is toxic. Texts of any length are scored whole; a long one has
no more terms than there are buckets. An empty table of documents gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm import textvec as tv
from foliant.llm.common import bounded_batches, named
from foliant.llm.learning import chance, cut, held_out, thin

POSITIVE, NEGATIVE = 2500, 4500
BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6, 7)
#: The settings were compared on rows that may be learned from, fitted on one half and told on the other.
#: A term is learned if so many sampled texts hold it.
LEAST_TEXTS = 3
FACTORS, UPDATES, BATCH, RATE, RIDGE, FACTOR_RIDGE = 6, 800, 128, 0.1, 3e-3, 1e-2
#: Spread of the first factors; least leaning of a term.
START, LEAST_LEANING = 0.01, 0.1
THRESHOLD = 0.7

_alnum: list[np.ndarray] = []


def terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of all texts, and the text of each; terms may repeat."""
    if not _alnum:
        table = np.zeros(0x110000, bool)
        table[[i for i in range(0x110000) if chr(i).isalnum()]] = True
        _alnum.append(table)
    cp, at = tv.codepoints([(t or "").lower() for t in texts])
    s, e = tv.runs(_alnum[0][cp])
    doc = np.searchsorted(at, s, "right") - 1
    hashes, owner = [tv.run_hashes(cp, s, e)], [doc]
    for n in PREFIXES:
        long = e - s > n
        hashes.append(tv.mix(tv.run_hashes(cp, s[long], s[long] + n) + np.uint64(n)))
        owner.append(doc[long])
    return (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owner)


def _distinct(term: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms by text, and the bounds of each text's."""
    key = np.unique(doc * BUCKETS + term)
    return key % BUCKETS, np.searchsorted(key // BUCKETS, np.arange(n + 1))


class Machine:
    """bias, and for each kept bucket a weight and FACTORS factors. place: of each bucket among the kept, or -1."""

    def __init__(self, bias: float, kept: np.ndarray, weight: np.ndarray, factors: np.ndarray):
        self.bias, self.kept, self.weight, self.factors = bias, kept, weight, factors
        self._place: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_place": None}

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self._place is None:
            self._place = np.full(BUCKETS, -1, np.int64)
            self._place[self.kept] = np.arange(len(self.kept))
        term, doc = terms(texts)
        at = self._place[term]
        index, bounds = _distinct(at[at >= 0], doc[at >= 0], len(texts))
        return 1 / (1 + np.exp(-np.clip(self.margin(index, bounds), -40, 40)))

    def margin(self, index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        linear, total, square = (_segment_sums(x, bounds) for x in (self.weight[index], self.factors[index], self.factors[index] ** 2))
        return self.bias + linear + 0.5 * (total**2 - square).sum(1)


def _segment_sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)])
    return run[bounds[1:]] - run[bounds[:-1]]


class Batch:
    """Some rows of the sample: their entries by text, and again by term, so that both sums run over neighbours."""

    def __init__(self, rows: np.ndarray, index: np.ndarray, own: np.ndarray, label: np.ndarray):
        sizes = own[rows + 1] - own[rows]
        some = np.flatnonzero(sizes)
        to = np.concatenate([[0], np.cumsum(sizes)])
        x = index[np.repeat(own[rows] - to[:-1], sizes) + np.arange(to[-1])]
        self.n, self.label, self.some, self.texts = len(rows), label[rows], some, to[some]
        found, place = np.unique(x, return_inverse=True)
        self.terms = found.astype(np.int32)
        self.place = place.astype(np.int32)
        by = np.argsort(place, kind="stable")
        self.doc = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)[by]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(self.terms)))[:-1]]).astype(np.int64)

    def by_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over each text of its terms' values."""
        out = np.zeros((self.n, values.shape[1]), values.dtype)
        if len(self.some):
            out[self.some] = np.add.reduceat(values[self.place], self.texts, axis=0)
        return out

    def by_term(self, values: np.ndarray) -> np.ndarray:
        """Sums over each term of its texts' values."""
        return np.add.reduceat(values[self.doc], self.starts, axis=0) if len(self.terms) else np.zeros((0, values.shape[1]), values.dtype)


def leaning(index: np.ndarray, own: np.ndarray, label: np.ndarray, n: int) -> np.ndarray:
    """The scale of each term's weight under the ridge: its squared log ratio of the labels, LEAST_LEANING at least. None is left out."""
    y = np.repeat(label.astype(np.int8), np.diff(own))
    one, zero = (np.bincount(index[y == v], minlength=n) + 0.5 for v in (1, 0))
    odds = np.log(one / ((label == 1).sum() + 1)) - np.log(zero / ((label == 0).sum() + 1))
    return (np.maximum(np.abs(odds), LEAST_LEANING) ** 2).astype(np.float32)[:, None]


def fit_machine(index: np.ndarray, bounds: np.ndarray, label: np.ndarray, prior: float) -> Machine:
    """AdaGrad on the logistic loss. The bias is moved from the sample's share of label 1 to the prior."""
    kept = np.flatnonzero(np.bincount(index, minlength=BUCKETS) >= LEAST_TEXTS)
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    use = place[index] >= 0
    own = np.concatenate([[0], np.cumsum(use)])[bounds]
    index = place[index[use]]
    scale = leaning(index, own, label, len(kept))
    rng = np.random.default_rng(5)
    share = label.mean()
    # One row for each term: its weight, then its factors.
    both = np.hstack([np.zeros((len(kept), 1)), rng.normal(0, START, (len(kept), FACTORS))]).astype(np.float32)
    seen, bias, seen_b = np.full(both.shape, 1e-2, np.float32), float(np.log(share / (1 - share))), 1e-2
    order = rng.permutation(len(label))
    batches = [Batch(order[lo : lo + BATCH], index, own, label) for lo in range(0, len(order), BATCH)]
    del index  # the batches hold all entries
    ridge = np.array([RIDGE] + [FACTOR_RIDGE] * FACTORS, np.float32)
    # A ridge on all terms, laid on when a term comes up: the rarer it is, the more at once.
    held = len(batches) / np.maximum(1, np.bincount(np.concatenate([b.terms for b in batches]), minlength=len(kept))).astype(np.float32)[:, None]
    rounds = max(6, UPDATES * BATCH // len(label))
    for at in range(rounds):
        for b in (batches[i] for i in rng.permutation(len(batches))):
            t = both[b.terms]
            w = scale[b.terms] * t[:, :1]
            sums = b.by_text(np.hstack([w, t[:, 1:], (t[:, 1:] ** 2).sum(1, keepdims=True)]))
            total = sums[:, 1:-1]
            margin = bias + sums[:, 0] + 0.5 * ((total**2).sum(1) - sums[:, -1])
            error = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - b.label) / b.n).astype(np.float32)
            slope = b.by_term(np.hstack([error[:, None], error[:, None] * total]))
            slope[:, 1:] -= slope[:, :1] * t[:, 1:]
            slope[:, :1] *= scale[b.terms]
            slope += held[b.terms] * ridge * t
            # Factors explain what the weights leave open, so they move in the second half only.
            slope[:, 1:] *= 2 * at >= rounds
            seen[b.terms] += slope**2
            both[b.terms] = t - RATE * slope / np.sqrt(seen[b.terms])
            seen_b += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(seen_b)
    bias += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return Machine(bias, kept, scale[:, 0] * both[:, 0], both[:, 1:].copy())


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch["text"].to_pylist()
        for lo, hi in tv.chunks(texts):
            index, bounds = _distinct(*terms(texts[lo:hi]), hi - lo)
            cells = pa.array([index[bounds[i] : bounds[i + 1]].astype(np.int32).tobytes() for i in range(hi - lo)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch[c].slice(lo, hi - lo) for c in ("doc_id", "toxic", "chance")], cells], names=["doc_id", "toxic", "chance", "x"])


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    """The machine, from a bounded sample of labelled rows that aren't held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = shares.get(1, 0) / max(1, sum(shares.values()))
    if 0 in shares and 1 in shares:
        most = {1: POSITIVE, 0: NEGATIVE}
        chosen = thin(known, "toxic", most)  # of a bounded number, so it may be broadcast
        rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("chance", chance(F.col("doc_id")))
        found = cut(rows.mapInArrow(_sampled, "doc_id long, toxic int, chance double, x binary").collect(), "toxic", most)
        label = np.array([r["toxic"] for r in found])
        if 0 < label.sum() < len(label):
            bounds = np.concatenate([[0], np.cumsum([len(r["x"]) // 4 for r in found])])
            entries = np.frombuffer(b"".join(r["x"] for r in found), np.int32)
            del found  # one copy of the sample is enough
            return fit_machine(entries, bounds, label, prior)
    flat = float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))
    return Machine(flat, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(row_, held_out, score, predicted): docs' own rows as a struct, so that no column's name matters. docs has doc_id and text, labels doc_id and toxic."""
    bounded_batches(docs.sparkSession)
    model = fit(docs, labels)
    rows = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row_"), F.col("text"), held_out(F.col("doc_id")).alias("held_out"))
    schema = T.StructType([rows.schema["row_"], rows.schema["held_out"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for lo, hi in tv.chunks(texts):
                p = model.score(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([*[batch[c].slice(lo, hi - lo) for c in ("row_", "held_out")], pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["row_", "held_out", "score", "predicted"])

    return rows.mapInArrow(scored, schema)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic."""
    found = score(docs, labels).where("predicted = 0")
    return found.select(*[F.col("row_").getField(c).alias(c) for c in docs.columns])


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    found = score(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return found.select("row_.doc_id", "held_out", "score", "predicted")
