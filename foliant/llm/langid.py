"""Language identification in two steps: the family first, then one-versus-one linear SVMs within the family.

A text is the vector of its hashed letter bigrams and trigrams, square roots of counts, length one. The models are
squared-hinge linear SVMs fitted on a bounded sample of the labelled rows that aren't held out: SAMPLE texts, shared
evenly by the languages, but LEAST of each language at least; every language with a label is learned, and every text is
predicted whole. Families are listed ones; languages of none are families of their own while they are few (ALONE), and
else are put together by their mean vectors, about as many in a family as there are such families.

Defined results: `und` with score 0 for a null text, a text without a letter, or when nothing could be learned. Very long
texts are predicted whole, one at a time. Rows are predicted one by one, so repeated rows agree, ties of votes and margins
go to the language first by name. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import textvec as tv
from foliant.llm.common import bounded_batches
from foliant.llm.learning import chance, cut, held_out, thin

#: Language families by code; fixed values.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
#: Texts learned from, of all languages together, or of each at least; languages outside the list that are families each.
SAMPLE, LEAST, ALONE = 2400, 20, 12
BUCKETS = 4096


def family(lang: str) -> str | None:
    return next((f for f, members in FAMILIES.items() if lang.split("-")[0] in members), None)


def families(x: np.ndarray, langs: np.ndarray) -> dict[str, str]:
    """The family of each language. Of many unlisted ones some far apart begin a family each, and others join the nearest."""
    found = {v: family(v) for v in sorted(set(langs))}
    rest = [v for v, f in found.items() if f is None]
    centre = np.stack([x[langs == v].mean(0) for v in rest]) if rest else np.zeros((0, x.shape[1]))
    first = [0] if rest else []
    while len(first) < (len(rest) if len(rest) <= ALONE else -(-len(rest) // int(np.sqrt(len(rest))))):
        nearest = (centre @ centre[first].T / np.linalg.norm(centre[first], axis=1) / np.linalg.norm(centre, axis=1)[:, None]).max(1)
        nearest[first] = np.inf
        first.append(int(nearest.argmin()))
    if rest:
        near = centre @ centre[first].T / np.linalg.norm(centre[first], axis=1)
        near[first, range(len(first))] = np.inf
        found |= {v: f"with {rest[first[k]]}" for v, k in zip(rest, near.argmax(1).tolist(), strict=True)}
    return found


def _letters() -> np.ndarray:
    every = np.zeros(0x110000, bool)
    every[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return every


_table: list[np.ndarray] = []


def vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length (texts x BUCKETS), and whether each text has a letter."""
    if not _table:
        _table.append(_letters())
    cp, at = tv.codepoints([(t or "").lower() for t in texts])
    letter = _table[0][cp]
    c = np.where(letter, cp, 32).astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    n = len(c)
    counts = np.zeros(len(texts) * BUCKETS)
    for width in (2, 3):
        code, some = c[: n - width + 1].copy(), letter[: n - width + 1].copy()
        for k in range(1, width):
            code = code * np.uint64(0x110000) + c[k : n - width + 1 + k]
            some |= letter[k : n - width + 1 + k]
        some &= doc[: n - width + 1] == doc[width - 1 :]  # none reaches into the next text
        bucket = (tv.mix(code + np.uint64(width)) % np.uint64(BUCKETS)).astype(np.int64)[some]
        counts += np.bincount(doc[: n - width + 1][some] * BUCKETS + bucket, minlength=len(counts))
    x = np.sqrt(counts.reshape(len(texts), BUCKETS))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.maximum(norm, 1e-12)).astype(np.float32), np.add.reduceat(letter, at[:-1]) > 0


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 30.0, steps: int = 150) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, y in {-1, 1}, classes weighing alike, by accelerated gradient."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * cost
    step = 1 / (1 + 4 * cost)
    w = v = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (v - 2 * x.T @ (share * slack * y))
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        w, v = new, new + (old - 1) / t * (new - w)
    return w.astype(np.float32)


class Hierarchy:
    """Pairwise SVMs of the families, and of the languages of each family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        named = np.array(langs)
        known = families(x, named)
        of = np.array([known[v] for v in langs])
        self.families = sorted(set(of))
        self.members = {f: sorted(set(named[of == f])) for f in self.families}
        self.top = self._pairs(x, of, self.families)
        self.within = {f: self._pairs(x[of == f], named[of == f], m) for f, m in self.members.items()}

    @staticmethod
    def _pairs(x: np.ndarray, label: np.ndarray, classes: list[str]) -> dict[tuple[int, int], np.ndarray]:
        out = {}
        for i, j in combinations(range(len(classes)), 2):
            rows = (label == classes[i]) | (label == classes[j])
            out[i, j] = fit_svm(x[rows], np.where(label[rows] == classes[i], 1.0, -1.0).astype(np.float32))
        return out

    @staticmethod
    def _vote(x: np.ndarray, pairs: dict[tuple[int, int], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        """The class with most votes, ties to the greater sum of margins, and how sure: the least sigmoid of its margins."""
        votes, sure = np.zeros((len(x), n)), np.ones((len(x), n))
        for (i, j), w in pairs.items():
            m = x @ w[:-1] + w[-1]
            p = 1 / (1 + np.exp(np.clip(-4 * m, -50, 50)))
            votes[:, i] += (m > 0) + 1e-3 * p
            votes[:, j] += (m <= 0) + 1e-3 * (1 - p)
            sure[:, i], sure[:, j] = np.minimum(sure[:, i], p), np.minimum(sure[:, j], 1 - p)
        best = votes.argmax(1)
        return best, sure[np.arange(len(x)), best]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top, sure = self._vote(x, self.top, len(self.families))
        lang = np.empty(len(x), object)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(top == k)
            if len(rows):
                own, p = self._vote(x[rows], self.within[f], len(self.members[f]))
                lang[rows] = np.array(self.members[f], object)[own]
                sure[rows] *= p
        return lang, sure


def _vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch["text"].to_pylist()
        for lo, hi in tv.chunks(texts):
            x, some = vectors(texts[lo:hi])
            half = x.astype(np.float16)
            cells = pa.array([half[i].tobytes() if some[i] else None for i in range(hi - lo)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch[c].slice(lo, hi - lo) for c in ("doc_id", "lang", "chance")], cells], names=["doc_id", "lang", "chance", "x"])


def fit(docs: DataFrame) -> Hierarchy | None:
    """The models, from a bounded sample of rows (doc_id, text, lang) that aren't held out."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    every = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not every:
        return None
    most = dict.fromkeys(every, max(LEAST, SAMPLE // len(every)))
    sample = thin(rows, "lang", most).withColumn("chance", chance(F.col("doc_id")))
    found = cut([r for r in sample.mapInArrow(_vectors_of, "doc_id long, lang string, chance double, x binary").where("x is not null").collect()], "lang", most)
    if not found:
        return None
    return Hierarchy(np.stack([np.frombuffer(r["x"], np.float16) for r in found]).astype(np.float32), [r["lang"] for r in found])


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs (doc_id, text, lang)."""
    bounded_batches(docs.sparkSession)
    model = fit(docs)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for lo, hi in tv.chunks(texts):
                x, some = vectors(texts[lo:hi])
                lang, score = model.predict(x) if model else (np.full(hi - lo, "und", object), np.zeros(hi - lo))
                lang[~some], score = "und", np.where(some, score, 0.0)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), batch["held_out"].slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def accuracy(predicted: DataFrame, docs: DataFrame) -> dict[str, float]:
    """Share of right predictions by language among held-out rows."""
    both = predicted.where("held_out").join(docs.select("doc_id", "lang").where("lang is not null"), "doc_id")
    out: dict[str, float] = defaultdict(float)
    for r in both.groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right")).collect():
        out[r["lang"]] = r["right"]
    return dict(out)
