"""Functions over text columns: cleaning, chunks, language scores, quality."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"(?U)\s+"
NOT_TEXT = r"(?U)[^\w\s.,!?;:\-()]"
#: Characters a chunk has at most; texts up to this are one piece.
CHUNK = 4000
#: Codes of the recognition languages by ISO code, and the order in which they are tried; fixed values.
RECOGNITION = {"en": "eng", "ko": "kor", "ja": "jpn", "zh": "chi_sim", "fr": "fra", "de": "deu", "es": "spa", "it": "ita", "pt": "por", "ru": "rus"}
PRIORITY = ("eng", "kor", "jpn", "chi_sim", "fra", "deu", "spa")

def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """White space to single blanks, then characters that are neither word, space nor common marks to blanks, stripped; '' of nothing."""
    return F.coalesce(F.btrim(F.regexp_replace(F.regexp_replace(text, BLANK, " "), NOT_TEXT, " ")), F.lit(""))


def for_embedding(text: Column, most: int = 50_000) -> Column:
    """White space collapsed, stripped, cut."""
    return F.coalesce(F.substring(F.btrim(F.regexp_replace(text, BLANK, " ")), 1, most), F.lit(""))


def solid_length(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.coalesce(F.length(F.regexp_replace(text, BLANK, "")), F.lit(0))


def needs_recognition(text: Column, least: int = 100) -> Column:
    return solid_length(text) < least


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def line_count(text: Column) -> Column:
    """Lines as split at line ends, with no empty last one."""
    lines = F.split(text, r"\r\n|[\n\r\u000B\f\u001C-\u001E\u0085  ]", -1)
    n = F.size(lines)
    return F.when(text == "", 0).otherwise(n - F.when(F.element_at(lines, -1) == "", 1).otherwise(0))


def distinct_characters(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.array_distinct(F.split(text, ""))))


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def chunk(text: str, most: int = CHUNK) -> list[str]:
    """Sentences packed greedily into chunks of at most `most` characters; a longer sentence is cut between words, and its last part goes on as the current chunk."""
    out, now = [], ""
    for sentence in re.split(r"[.!?]\s+", text):
        if len(sentence) > most:
            if now:
                out.append(now)
            now = ""
            for word in sentence.split():
                if now and len(now) + 1 + len(word) > most:
                    out.append(now)
                    now = word
                else:
                    now = f"{now} {word}" if now else word
        elif now and len(now) + 1 + len(sentence) > most:
            out.append(now)
            now = sentence
        else:
            now = f"{now} {sentence}" if now else sentence
    out = [c.strip() for c in [*out, now] if c.strip()]
    return out or [text[:most]]


def chunks(df: DataFrame, key: str, text: str, most: int = CHUNK) -> DataFrame:
    """(key, chunk_no, chunk) of each text, batch by batch."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, n, c) for i, t in enumerate(batch.column(1).to_pylist()) for n, c in enumerate(chunk(t or "", most))]
            at, no, parts = ([f[k] for f in found] for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(parts, pa.string())], names=[key, "chunk_no", "chunk"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, chunk_no int, chunk string")


def recognition_language(iso: Column) -> Column:
    """The recognition code of an ISO code, region ignored; English by default."""
    code = F.element_at(F.split(iso, "-"), 1)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RECOGNITION.items() for x in kv]), code), F.lit("eng"))


def iso_language(code: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in RECOGNITION.items() for x in (v, k)]), code), F.lit("en"))


def language_score(text: Column, confidence: Column, probability: Column | None, match: Column) -> Column:
    """How well a recognition in one language went: confidence in percent, length, and what a detector says of the text."""
    size = F.least(F.length(text) / 100.0, F.lit(1.0))
    plain = confidence / 100.0 * 0.6 + size * 0.4
    full = plain if probability is None else F.when(probability.isNull(), plain).otherwise(confidence / 100.0 * 0.4 + size * 0.3 + probability * 0.2 + F.when(match, 0.5).otherwise(0.0))
    return F.when((F.coalesce(F.length(strip(text)), F.lit(0)) == 0) | (confidence <= 0), 0.0).otherwise(full)


def answered_language(answer: Column) -> Column:
    """The first known code that a model's answer names."""
    out = F.lit(None).cast("string")
    for code in reversed(PRIORITY):
        out = F.when(F.contains(F.lower(answer), F.lit(code)), code).otherwise(out)
    return out


def change(old: Column, new: Column) -> Column:
    """Percent of change; null from nothing."""
    return F.try_divide((new - old) * 100.0, old)


def quality_change(old: Column, new: Column) -> dict[str, Column]:
    """Counts of both texts, the score of the new one and what it means; the meaning is unknown where the old text is empty."""
    measures = {"chars": F.length, "words": word_count, "lines": line_count, "unique_chars": distinct_characters}
    out = {f"{side}_{name}": f(c) for side, c in (("old", old), ("new", new)) for name, f in measures.items()}
    more = lambda n: out[f"new_{n}"] > out[f"old_{n}"]
    ratio = F.try_divide(out["new_chars"] * 1.0, out["old_chars"])
    drift = F.abs(F.coalesce(change(out["old_words"], out["new_words"]), F.lit(0.0)))
    points = ((more("words"), 30), (ratio.between(0.8, 1.2), 20), (more("unique_chars"), 20), (drift < 50, 30))
    score = F.when(out["old_chars"] > 0, sum((F.when(hit, n).otherwise(0) for hit, n in points), F.lit(0)))
    return out | {"score": score, "assessment": F.when(score.isNull(), "unknown").when(score >= 70, "improved").when(score >= 40, "similar").otherwise("degraded")}


def overall_change(cosine: Column, assessment: Column) -> Column:
    """What a new recognition did, from the vectors' cosine and the texts' assessment."""
    better = assessment == "improved"
    known = F.when((cosine > 0.95) & (assessment == "similar"), "minimal_change").when((cosine > 0.85) & better, "minor_improvement").when((cosine < 0.85) & better, "significant_improvement")
    return F.when(cosine.isNull(), "embedding_unavailable").otherwise(known.when(assessment == "degraded", "quality_degraded").otherwise("changed"))


def interpretation(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 65, "good").when(score >= 50, "fair").when(score >= 30, "poor").otherwise("very poor")
