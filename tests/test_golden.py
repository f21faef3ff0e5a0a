"""Small inputs with results worked out by hand."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import extract, security, texts, vector
from foliant.operators import catalog, consistency, duplicates, layouts, maintenance, telemetry, uploads
from foliant.operators import vectors as vs


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lines(spark, *rows, gap=20.0, x=0.0):
    df = spark.createDataFrame([("p", i, t, i * gap, x, 0.0) for i, t in enumerate(rows)], "page string, line_no long, text string, y double, x double, width double")
    return df.withColumns({"height": F.lit(20.0)} | {k: F.lit(v) for k, v in layouts.DEFAULT_GAPS.items()})


def tiers(spark, *rows, **kw):
    return [r["line_no"] for r in layouts.breaks(lines(spark, *rows, **kw)).where("tier IS NOT NULL").orderBy("line_no").collect()]


def test_paragraph_rules(spark):
    assert tiers(spark, "1. a", "2. b", "3. c", gap=10.0) == [0, 1]
    assert tiers(spark, "Abstract", "text", "Introduction", "text", gap=10.0) == [0, 1, 2]
    assert tiers(spark, "so it is", "A cat", gap=10.0) == [0]
    assert tiers(spark, "end.", "Next one", gap=35.0) == [0]
    assert tiers(spark, "one", "two", gap=100.0) == [0]


def test_thresholds(spark):
    schema = "page string, text string, height double, conf double"
    none = layouts.thresholds(spark.createDataFrame([("p", "w", 9.0, 40.0)], schema), "page").first()
    assert (none["height"], none["large_gap"], none["line_gap"]) == (20.0, 60.0, 16.0)
    one = layouts.thresholds(spark.createDataFrame([("p", "w", 20.0, 90.0)], schema), "page").first()
    assert (one["height"], one["large_gap"], one["line_gap"]) == (20.0, 50.0, 16.0)


def test_lists_and_titles(spark):
    v = lambda f, t: value(spark, f(F.lit(t)))
    assert v(extract.name_list, "Ann Lee and Bo Chan; C. Oh") == ["Ann Lee", "Bo Chan", "C. Oh"]
    assert v(extract.name_list, "Sandra Fox") == ["S", "ra Fox"]
    assert v(extract.stored_list, '["a","b"]') == ["a", "b"]
    assert v(extract.stored_list, "a, b") == ["a", "b"]
    assert value(spark, extract.stored_list(F.lit(None).cast("string"))) == []
    years = "1999 2003 2021 2019"
    assert (v(extract.first_year, years), v(extract.latest_year, years)) == (2003, 2021)
    assert v(extract.bare_doi, "see 10.1234/abc.1, next") == "10.1234/abc.1,"
    assert v(extract.title_after_head, "Vol. 3 No. 2 | page 7\nOn the growth of trilobites\nin warm water\nx") == "On the growth of trilobites in warm water"
    assert v(extract.authors, "A title\nBy Ann Lee, Bo Chan") == ["Ann Lee", "Bo Chan"]
    assert v(lambda c: extract.labelled(c, "Title"), "Title: a\nYear: 2\nTitle: b ") == "b"
    said = value(spark, extract.quality_from_words(F.lit("Not good, slightly blurry")))
    assert (said["quality"], said["score"], said["issues"], said["artifacts"], said["rescan"]) == ("good", 70, ["blurry_text"], "moderate", False)
    kept = value(spark, extract.quality_record(F.lit('so {"overall_quality": "fair"} ok')))
    assert (kept["overall_quality"], kept["readability_score"]) == ("fair", 50.0)


def test_estimates(spark):
    est = lambda mb: value(spark, telemetry.estimate(F.lit(mb).cast("double")))
    assert [est(x) for x in (0.5, None, 100.0, 0.0)] == [135.0, 180.0, 1200.0, 180.0]
    assert value(spark, duplicates.time_saved(F.lit("duplicate_found"), F.lit(1048576), F.lit(5.0))) == 75.0
    delays = spark.range(1, 6).select(F.lit(2.0).alias("base"), F.lit(1.5).alias("factor"), F.col("id").alias("attempt"), F.lit(60.0).alias("longest")).select(telemetry.backoff().alias("d"))
    assert [r["d"] for r in delays.collect()] == [2.0, 3.0, 4.5, 6.75, 10.125]
    kinds = [value(spark, telemetry.error_kind(F.lit(m))) for m in ("Connection timeout", "OOM killed", "Access denied", "crash")]
    assert kinds == ["timeout", "memory", "permission", "other"]
    sample = spark.createDataFrame([(1, 10.0, 20.0, 60.0)], "sample_id long, cpu double, memory double, disk double").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert tuple(telemetry.health(sample).first()) == (70.0, "good")


def test_text_change(spark):
    m = texts.quality_change(F.lit("aa bb"), F.lit("aa bb"))
    assert (value(spark, m["score"]), value(spark, m["assessment"])) == (50, "similar")
    assert value(spark, texts.quality_change(F.lit(""), F.lit("x"))["assessment"]) == "unknown"
    assert [value(spark, texts.interpretation(F.lit(s))) for s in (80, 65, 50, 30, 29)] == ["excellent", "good", "fair", "poor", "very poor"]
    assert value(spark, texts.line_count(F.lit("a\nb\n"))) == 2
    assert value(spark, texts.clean(F.lit("é  a*b"))) == "é a b"


def test_chunks_keep_words():
    text = ". ".join(["word " * 30] * 20) + " " + "x" * 50
    got = texts.chunk(text, 200)
    assert all(len(c) <= 200 for c in got) and " ".join(got).replace(".", "").split() == text.replace(".", "").split()
    assert texts.chunk("y" * 500, 200) == ["y" * 500] and texts.chunk("", 10) == [""]


def test_vectors(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert value(spark, vector.cosine(arr(1, 0), arr(0, 0))) == 0.0
    assert value(spark, vector.cosine(arr(1, 2), arr(1, 2, 3))) == 0.0
    assert value(spark, vector.euclidean(arr(1), arr(1, 2))) == float("inf")
    df = spark.createDataFrame([("d", [1.0, 0.0]), ("d", [0.0, 0.0]), ("d", [0.0, 1.0])], "paper string, v array<double>")
    assert np.allclose(vs.mean_vectors(df, "paper").first()["v"], [0.70710678, 0.70710678])


def test_files(spark):
    names = {"a/b.pdf": "traversal", "a?.pdf": "bad_characters", "a.txt": "type", "ok.pdf": None, "": "empty"}
    assert {n: value(spark, security.name_problem(F.lit(n))) for n in names} == names
    assert value(spark, security.dubious_urls(F.lit("see http://bit.ly:8080/x now"))) == ["http://bit.ly:8080/x"] * 2
    assert [value(spark, security.threat_level(F.lit(n))) for n in (0, 3, 4)] == ["safe", "medium", "high"]
    assert [value(spark, duplicates.sampled_pages(F.lit(n))) for n in (1, 2, 3, 10)] == [[0], [0, 1], [0, 1, 2], [0, 5, 9]]
    pdf = value(spark, security.content_problem(F.lit(b"%PDF-1.7 x")))
    assert pdf is None and value(spark, security.content_problem(F.lit(b""))) == "empty"


def test_breaker():
    b = uploads.Breaker(3, 300, 2)
    seen = [b.call(t, ok)[1] for t, ok in ((0, False), (1, True), (2, False), (3, False))]
    assert seen == ["CLOSED", "CLOSED", "CLOSED", "OPEN"]
    assert b.call(100, True) == (False, "OPEN") and b.next_attempt() == 303
    assert [b.call(t, True)[1] for t in (303, 304)] == ["HALF_OPEN", "CLOSED"]


def test_limiter():
    f = uploads.Limiter(2, 3)
    assert [f(t) for t in (0, 1, 2, 3601, 3602, 90000)] == [True, True, False, True, False, True]


def test_consistency(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "id string") for s in ("ab", "bc"))
    issues = consistency.everything(consistency.id_differences(a, b, "id"), consistency.total_difference(a, b))
    assert issues.count() == 2 and consistency.status(issues).first()["status"] == "good"
    assert consistency.status(issues.limit(0)).first()["status"] == "excellent"


def test_page_navigation(spark):
    pages = spark.createDataFrame([("p", n) for n in (1, 2, 4)], "paper_id string, page_number int")
    row = catalog.neighbours(pages).where("page_number = 2").first()
    assert (row["prev_page"], row["next_page"], row["position"], row["total_pages"]) == (1, 4, 2, 3)


def test_upsert_and_cleanup_repeat(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k long, u string, v string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", "")], "k long, u string, v string")
    merged = maintenance.upsert(old, new, "k", keep_empty=("v",))
    assert sorted(map(tuple, merged.collect())) == [(1, "a", "x"), (2, "b", "y"), (3, "c", None)]
    again = maintenance.upsert(merged, new, "k", keep_empty=("v",))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, merged.collect()))


def test_parameters():
    assert catalog.checked(5, 1, 365, "days") == 5
    with pytest.raises(ValueError):
        catalog.checked(0, 1, 365, "days")
    with pytest.raises(ValueError):
        vs.where({"a": {"$near": 1}})


def test_samples_as_stored(spark):
    """Worked out by hand: each page's first 1000 characters, a backslash and an n after each, 4000 at most, then stripped."""
    sample = lambda *pages: value(spark, duplicates.sample_text(F.array(*[F.lit(p) for p in pages]), duplicates.sampled_pages(F.lit(len(pages)))))
    assert sample(" one ", "two") == "one \\ntwo\\n"
    assert sample("a", "", "c") == "a\\n\\nc\\n"
    assert sample("x" * 1500, None) == "x" * 1000 + "\\n\\n"
    assert sample("a", "b", "c", "d", "e") == "a\\nc\\ne\\n"


def test_copies_by_sample(spark):
    """Documents that share their first 2000 characters are told apart by what follows; those that share all samples aren't."""
    from foliant.plans.duplicates import keyed

    opening = "".join(f"word{i} " for i in range(300))[:2000]
    rest = ["".join(f"{w}{i} " for i in range(300)) for w in ("left", "right")]
    rows = [(1, opening + rest[0]), (2, opening + rest[1]), (3, opening + rest[0]), (4, "short"), (5, "short"), (6, None)]
    found = {r["doc_id"]: r["k_sample"] for r in keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    assert found[1] == found[3] != found[2] and found[1] is not None and found[4] is found[5] is found[6] is None


def test_model_memory(spark):
    """Stored estimates: the first listed name that the model's contains, so those behind `llama3.2` and `llava` never count."""
    from foliant.sources import files

    names = {"llama3.2:1b": 4000, "LLaVA:13b": 3000, "codellama:7b": 4000, "mistral:latest": 4000, "gemma": 2000}
    for name, mb in names.items():
        assert value(spark, files.model_memory(F.lit(name))) == mb
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert files.memory_estimate(df).first()["mb"] == 17_500 and files.memory_estimate(df.limit(0)).first()["mb"] == 0


def test_first_step_has_no_time(spark):
    rows = [(1, 1, "initializing", 0), (2, 1, "ocr", 5), (3, 1, None, 9), (4, 1, "end", 11)]
    df = spark.createDataFrame(rows, "step_id long, job_id long, step string, s long").withColumn("created_at", F.timestamp_seconds("s"))
    assert {r["step_id"]: r["seconds"] for r in telemetry.step_times(df, "job_id").collect()} == {1: None, 2: 4.0, 3: 2.0, 4: None}


def test_vector_digests(spark, sf):
    import hashlib

    from foliant.sources import tables as src

    rows = src.table(spark, sf, "embeddings").select("vec_id", "embedding").collect()
    got = {r["key"]: r["digest"] for r in duplicates.vector_digest(src.table(spark, sf, "embeddings"), "vec_id", "embedding").collect()}
    assert got == {r["vec_id"]: hashlib.sha256(np.array(r["embedding"], "<f4").tobytes()).hexdigest() for r in rows}


def test_chunks_of_whole_documents(spark, sf):
    """Every document's words come once and in order, and no chunk is longer than allowed."""
    from foliant.sources import tables as src

    docs = src.table(spark, sf, "documents").select("doc_id", "text")
    got: dict[int, list[str]] = {}
    for r in sorted(texts.chunks(docs, "doc_id", "text", 1500).collect(), key=lambda r: (r["doc_id"], r["chunk_no"])):
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    for r in docs.collect():
        own = got.get(r["doc_id"], [])
        assert all(len(c) <= 1500 or len(c.split()) == 1 or len(r["text"]) <= 1500 for c in own)
        assert " ".join(own).replace(".", " ").split() == (r["text"] or "").replace(".", " ").split() or len(r["text"] or "") <= 1500


def test_languages_of_held_out_documents(spark, sf):
    from foliant.operators import languages
    from foliant.sources import tables as src

    docs = src.table(spark, sf, "documents")
    known = languages.profiles(docs.where("doc_id % 3 <> 1"))
    found = languages.detected(docs.where("doc_id % 3 = 1"), known, "doc_id").withColumnRenamed("lang", "said").join(docs.where("length(text) >= 200").select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").collect()
    assert len(found) > 20 and sum(r["said"] == r["lang"] for r in found) >= 0.95 * len(found)
    short = languages.detected(spark.createDataFrame([(1, "kurz"), (2, None), (3, "12345 " * 20)], "doc_id long, text string"), known, "doc_id")
    assert {r["doc_id"]: r["lang"] for r in short.collect()} == {1: "en", 2: "en", 3: "en"}


def test_layout_answers(spark):
    """Lists and objects, missing and malformed values, fields that aren't known."""
    answers = [
        (1, '{"pages": [{"elements": [{"type": "title", "text": "T", "confidence": 0.5, "bbox": [1, 2, 3, 4], "extra": {}}, {"text": 7, "confidence": "high"}]}, {"elements": {"a": {"type": "table"}, "b": {}}}], "more": 1}'),
        (2, '{"pages": []}'), (3, "not json"), (4, None), (5, '{"pages": [{"width": 1}, {"elements": []}]}'), (6, "[1]"),
    ]
    rows = layouts.elements(spark.createDataFrame(answers, "k long, layout_json string"), "k").collect()
    assert sorted((r["k"], r["page_number"], r["element_no"], r["type"], r["text"], r["confidence"], r["bbox"]) for r in rows) == [
        (1, 1, 0, "title", "T", 0.5, [1.0, 2.0, 3.0, 4.0]), (1, 1, 1, "unknown", "7", 0.0, [0.0] * 4), (1, 2, 0, "table", "", 0.0, [0.0] * 4), (1, 2, 1, "unknown", "", 0.0, [0.0] * 4),
    ]


def test_words_become_paragraphs(spark):
    """Worked out by hand: a heading, two lines of one paragraph, and a line after a large gap; blank words don't count."""
    lines = [(0, "Introduction"), (24, "this is text"), (48, "that goes on"), (148, "New part")]
    words = [("p", i, w, 60.0 * k, float(top), 50.0, 20.0, 90.0) for i, (top, k, w) in enumerate((top, k, w) for top, line in lines for k, w in enumerate([*line.split(), " "]))]
    df = spark.createDataFrame(words, "page string, word_no long, text string, left double, top double, width double, height double, conf double")
    limits = layouts.thresholds(df, "page")
    found = layouts.lines(df, limits)
    assert [(r["line_no"], r["text"], r["y"], r["x"], r["width"]) for r in found.orderBy("line_no").collect()] == [
        (0, "Introduction", 0.0, 0.0, 50.0), (1, "this is text", 24.0, 0.0, 170.0), (2, "that goes on", 48.0, 0.0, 170.0), (3, "New part", 148.0, 0.0, 110.0),
    ]
    whole = layouts.page_text(layouts.paragraphs(layouts.breaks(found.join(limits, "page")))).collect()
    assert [(r["page"], r["text"]) for r in whole] == [("p", "Introduction\n\nthis is text\nthat goes on\n\nNew part")]


def test_record_of_a_paper(spark):
    text = "Journal of Shells Vol. 3 No. 2\nOn the growth of trilobites\nin warm water\nBy Ann Lee, Bo Chan\nann.lee@uni.edu\nReceived 2018, published 2021\ndoi: 10.1234/abc.5\n\nAbstract: " + "The shells grew in warm water for many years. " * 4 + "\n\nKeywords: shells\n"
    r = value(spark, extract.record(F.lit(text)))
    assert (r["year"], r["doi"], r["email"], r["authors"]) == (2021, "10.1234/abc.5", "ann.lee@uni.edu", ["Ann Lee", "Bo Chan"])
    assert r["title"].startswith("On the growth of trilobites") and r["abstract"].startswith("The shells grew in warm water")
    assert value(spark, extract.record(F.lit("too short"))) is None
