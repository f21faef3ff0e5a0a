"""Models behind one interface: a function over a batch of texts, its failures as a column, its defaults where it is off."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators.vectors import similar_to

Scorer = Callable[[list[str]], list[str | None]]


def answered(df: DataFrame, key: str, text: str, scorer: Scorer) -> DataFrame:
    """(key, answer, error): what a model says of each text. A batch that fails is tried text by text, so one bad text costs one answer."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, errors = _replies(scorer, [t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=[key, "answer", "error"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, answer string, error string")


def _replies(scorer: Scorer, texts: list[str]) -> tuple[list[str | None], list[str | None]]:
    """Answers and errors of all texts; those of a batch that fails are asked one by one."""
    if not texts:
        return [], []
    try:
        return list(scorer(texts)), [None] * len(texts)
    except Exception as e:  # noqa: BLE001
        if len(texts) == 1:
            return [None], [str(e)]
        each = [_replies(scorer, [t]) for t in texts]
        return [a for (a,), _ in each], [e for _, (e,) in each]


def asked(df: DataFrame, prompt: Column, scorer: Scorer, name: str) -> DataFrame:
    """df with what a model answers to each row's prompt as column `name`, and its failure as `name`_error. Rows whose prompt is null aren't asked and have neither. Rows go through whole, so the answers need no join."""
    own = df.columns
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row_"), prompt.alias("prompt_"))
    schema = T.StructType([rows.schema["row_"], T.StructField(name, T.StringType()), T.StructField(f"{name}_error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prompts = batch.column(1)
            places = [i for i, p in enumerate(prompts.to_pylist()) if p is not None]
            answers: list[str | None] = [None] * batch.num_rows
            errors = answers.copy()
            for i, a, e in zip(places, *_replies(scorer, prompts.take(pa.array(places, pa.int64())).to_pylist()), strict=True):
                answers[i], errors[i] = a, e
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=schema.names)

    # As a struct, so that no column's name matters.
    return rows.mapInArrow(run, schema).select(*[F.col("row_").getField(c).alias(c) for c in own], name, f"{name}_error")


def first_known(*candidates: Column) -> Column:
    """The first answer there is: the ladder of better and plainer models and rules."""
    return F.coalesce(*candidates)


def deployment(quality_up: Column, layout_up: Column) -> Column:
    return F.when(quality_up & layout_up, "GPU").when(~quality_up & ~layout_up, "CPU").otherwise("Mixed")



def embedded(df: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]], dim: int) -> DataFrame:
    """(key, v): a model's vector of each text. A blank text has a zero vector, as have the texts of a batch that fails one by one."""
    kind = df.schema[key].dataType.simpleString()
    zero = [0.0] * dim

    def vectors(texts: list[str]) -> list[list[float]]:
        try:
            return model(texts)
        except Exception:  # noqa: BLE001  one bad text costs one vector
            if len(texts) == 1:
                return [zero]
            return [v for t in texts for v in vectors([t])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").strip() for t in batch.column(1).to_pylist()]
            said = iter(vectors([t for t in texts if t]) if any(texts) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([next(said) if t else zero for t in texts], pa.list_(pa.float64()))], names=[key, "v"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, v array<double>")


def text_search(store: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]], k: int = 10) -> DataFrame:
    """(vec_id, similarity) of the stored vectors nearest to a text's."""
    return similar_to(store, model([text])[0], k)


def with_default(answer: Column, enabled: Column, off: Column, failed: Column) -> Column:
    """An answer's record, or the record for a model that is switched off, or that gave none."""
    return F.when(~enabled, off).otherwise(F.coalesce(answer, failed))


#: What stands for a quality assessment that failed; fixed values.
FAILED_QUALITY = {
    "overall_quality": "unknown", "text_clarity": "unknown", "image_quality": "unknown", "scan_artifacts": "unknown", "readability_score": 50,
    "issues": ["analysis_failed"], "recommendations": ["Manual review recommended"], "confidence": 0, "error": "Assessment failed",
}
#: Why a layout wasn't analysed, and the megabytes of a file up to which it is; fixed values.
LAYOUT_OFF, MOST_LAYOUT_MB = "Layout analysis service disabled (CPU-only mode)", 50


def failed_quality() -> Column:
    """The record of a quality assessment that failed."""
    value = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
    return F.struct(*[value(v).alias(k) for k, v in FAILED_QUALITY.items()])


def layout_result(pages: Column, enabled: Column, size_mb: Column) -> Column:
    """The record of a layout analysis that has this many pages: a failed one where the service is off, the file too large, or no answer came (null)."""
    large = F.format_string(f"File too large: %.1fMB (max: {MOST_LAYOUT_MB}MB)", size_mb.cast("double"))
    error = F.when(~enabled, LAYOUT_OFF).when(size_mb > MOST_LAYOUT_MB, large).when(pages.isNull(), "No answer")
    return F.struct(error.isNull().alias("success"), error.alias("error"), F.when(error.isNull(), pages).otherwise(0).alias("page_count"), F.when(~enabled, "disabled").when(error.isNotNull(), "failed").otherwise("done").alias("status"))
