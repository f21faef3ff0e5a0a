"""Records by models and rules, pages read anew, job records and histories: values worked out by hand, and plain versions over whole tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from foliant.functions import extract
from foliant.operators import backups, jobs, records, rereading, versions
from foliant.session import scratch
from foliant.sources import scorers
from foliant.sources import tables as src


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_records_in_json(spark):
    read = lambda text: value(spark, extract.structured_record(F.lit(text)))
    r = read('Here: {"title": " A b ", "authors": ["X", null, "none", " Y "], "year": 1999.7, "doi": "doi 10.1/a", "abstract": "This one is long enough.", "keywords": "a; b, none", "journal": 5, "pages": "N/A", "email": ["x"]} ok')
    assert (r["title"], r["authors"], r["year"], r["doi"], r["abstract"]) == ("A b", ["X", "Y"], 1999, "doi 10.1/a", "This one is long enough.")
    assert r["keywords"] == ["a", "b", "none"] and (r["journal"], r["pages"], r["email"], r["volume"]) == (None, None, None, None)
    r = read('{"title": "null", "authors": "[\\"P\\", \\"Q\\"]", "year": " 2031 ", "doi": "11.5/a", "abstract": "too short", "keywords": "[a, b"}')
    assert (r["title"], r["authors"], r["year"], r["doi"], r["abstract"], r["keywords"]) == (None, ["P", "Q"], 0, None, None, ["[a", "b"])
    assert [read(f'{{"year": {y}}}')["year"] for y in ('"2020"', '"2020.5"', "true", '"+1950"', "null", '"soon"')] == [2020, 0, 0, 1950, 0, 0]
    assert read("no braces") is None and read("{broken") is None and read("{broken}") is None and read(None) is None
    assert read("{}")["authors"] == [] and read("{}")["title"] is None


def test_records_in_lines(spark):
    read = lambda text: value(spark, extract.labelled_record(F.lit(text)))
    r = read("Title: one\n  Title: two\nTitle: [exact title]\nAuthors: A;; B\nAuthors:\nYear: in 1987 or 1990\nYear: later\nJournal: J\nAbstract: [first sentence of abstract if found]\nnot Title: three")
    assert (r["title"], r["authors"], r["year"], r["journal"], r["abstract"]) == ("two", ["A", "B"], 1987, "J", None)
    for nothing in ("", None, "what?"):
        r = read(nothing)
        assert (r["title"], r["authors"], r["year"]) == (None, [], 0)


def test_models_are_asked_only_where_needed(spark):
    """Each model sees the texts that come down to it, and no other; one that fails in a batch fails for its own text only."""
    def first(prompts):
        assert all("short" not in p for p in prompts), "a short text was shown"
        if any("fail" in p for p in prompts):
            raise ValueError("down")
        return ['{"title": "T"}' if "json" in p else "words" for p in prompts]

    def second(prompts):
        assert all("json" not in p for p in prompts), "an answered text was shown"
        if any("all" in p for p in prompts):
            raise ValueError("down")
        return [f"Title: {len(p)}" for p in prompts]

    fill = "x" * 3000
    rows = [(1, "short"), (2, None), (3, "json " + fill), (4, "fail " + fill), (5, "fail all 2019 " + fill), (6, "words " + fill), (6, "words " + fill)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    got = records.extracted(df, "text", first, second)
    assert got.columns == ["id", "text", "record", "method", "success", "error"]
    said = sorted((r["id"], r["method"], r["success"], r["error"], r["record"]["title"], r["record"]["year"]) for r in got.collect())
    assert said == [
        (1, "none", False, "Text too short", None, 0), (2, "none", False, "Text too short", None, 0), (3, "structured_llm", True, None, "T", 0), (4, "fallback_llm", True, None, "2000", 0),
        (5, "rule_based", True, None, "fail all 2019 " + fill, 2019), (6, "fallback_llm", True, None, "2000", 0), (6, "fallback_llm", True, None, "2000", 0),
    ]
    alone = {r["id"]: r["method"] for r in records.extracted(df.where("id > 3"), "text", first).collect()}
    assert alone == {4: "rule_based", 5: "rule_based", 6: "rule_based"}
    off = {r["id"]: (r["method"], r["success"]) for r in records.extracted(df.where("id < 3"), "text").collect()}
    assert off == {1: ("rule_based_fallback", False), 2: ("rule_based_fallback", False)}
    assert records.extracted(df.limit(0), "text", first, second).count() == 0


def plain_title(text):
    every = [t.strip() for t in text.split("\n")[:50]]
    start = 0
    for i, t in enumerate(every[:15]):
        if any(m in t.lower() for m in extract.HEAD_MARKS):
            start = i + 1
        elif len(t) > 20:
            break
    for i in range(start, min(start + 10, len(every))):
        t = every[i]
        if not 15 < len(t) < 250 or any(p in t.lower() for p in extract.NO_TITLE_PARTS) or any(c in t for c in extract.NO_TITLE_SIGNS) or len(t.split()) < 3:
            continue
        after = every[i + 1] if i + 1 < len(every) else ""
        return f"{t} {after}" if after and not after[0].isupper() and len(t) + 1 + len(after) < 250 else t
    return None


def plain_authors(text):
    out = []
    for t in [x.strip() for x in text.split("\n")[:20]]:
        ends = [(t.lower().find(m), -len(m)) for m in ("author:", "authors:", "by ") if m in t.lower()]
        if ends:
            at, size = min(ends)
            rest = t[at - size :].strip()
            out += [n.strip() for n in rest.split(",") if n.strip()] if rest and len(rest) < 100 else []
    return out[:5]


def test_rules_over_all_documents(spark, sf):
    """Titles and authors by a plain version, over documents as they are, with heads, and cut into lines at sentences."""
    texts = [r["text"] for r in src.table(spark, sf, "documents").where("text IS NOT NULL").select("text").collect()]
    texts += [f"Vol. 3 No. {i} | page\nBy Ann Lee, B {i}\n{t}" for i, t in enumerate(texts)]
    texts += [t.replace(". ", ".\n").replace(", ", "\nauthors: ") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: (r["t"], r["a"]) for r in df.select("i", extract.title_after_head(F.col("text")).alias("t"), extract.authors(F.col("text")).alias("a")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (plain_title(t), plain_authors(t)), t[:300]
    assert sum(got[i][0] is not None for i in got) > 100 and sum(bool(got[i][1]) for i in got) > 100


def ones(texts):
    return [[float(len(t)), 1.0] for t in texts]


def test_pages_read_anew(spark):
    pages = spark.createDataFrame([("p", 1, "one two", [3.0, 4.0]), ("p", 2, "keep", [1.0, 0.0]), ("q", 1, "other", [1.0, 1.0]), ("q", 2, None, None)], "paper_id string, page_number int, page_text string, v array<double>")
    fresh = spark.createDataFrame([("p", 1, "one two three four"), ("p", 2, "  "), ("p", 3, "added"), ("q", 2, "now")], "paper_id string, page_number int, page_text string")
    stored, report = rereading.reread(pages, fresh, ones, 2)
    rows = {(r["paper_id"], r["page_number"]): (r["page_text"], r["v"]) for r in stored.collect()}
    assert rows == {("p", 1): ("one two three four", [18.0, 1.0]), ("p", 2): ("keep", [1.0, 0.0]), ("p", 3): ("added", [5.0, 1.0]), ("q", 1): ("other", [1.0, 1.0]), ("q", 2): ("now", [3.0, 1.0])}
    said = {(r["paper_id"], r["page_number"]): r["report"] for r in report.collect()}
    assert set(said) == {("p", 1), ("p", 3), ("q", 2)}
    one = said["p", 1]
    assert one["vector"]["cosine"] == pytest.approx((3 * 18 + 4) / (5 * (18**2 + 1) ** 0.5)) and one["text"]["new_words"] == 4
    # More words and more letters, but much longer: 30 + 20 points of 100.
    assert (one["text"]["score"], one["text"]["assessment"], one["overall"]) == (50, "similar", "changed")
    assert said["p", 3]["overall"] == said["q", 2]["overall"] == "embedding_unavailable" and said["p", 3]["vector"]["cosine"] is None
    papers = spark.createDataFrame([("p", "old", [0.0]), ("q", "stays", [7.0])], "paper_id string, text string, v array<double>")
    made = {r["paper_id"]: (r["text"], r["v"]) for r in rereading.papers_again(stored, fresh.where("paper_id = 'p'"), papers, ones, 2).collect()}
    whole = "one two three four\n\nkeep\n\nadded"
    assert made == {"p": (whole, [float(len(whole)), 1.0]), "q": ("stays", [7.0])}
    heads = {r["paper_id"]: r["head"] for r in rereading.joined_pages(stored).collect()}
    assert heads == {"p": "one two three four\n\nkeep", "q": "other\n\nnow"}
    again = {(r["paper_id"], r["page_number"]): r["v"] for r in rereading.pages_again(pages, papers.where("paper_id = 'q'"), ones, 2).collect()}
    assert again == {("p", 1): [3.0, 4.0], ("p", 2): [1.0, 0.0], ("q", 1): [5.0, 1.0], ("q", 2): [0.0, 0.0]}


def test_records_of_finished_jobs(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    made = spark.createDataFrame(
        [(1, "a", 1.0, at(0), at(60), True, None, '{"steps_completed": ["ocr"], "data": {"page_count": 3, "ocr_quality_score": 0.5}}'), (2, "b", None, at(0), at(9), False, "", "not json"), (3, "c", 1.0, at(0), None, True, None, None), (4, "d", 1.0, at(5), at(5), False, "boom", None)],
        "job_id long, filename string, size_mb double, started_at timestamp, ended_at timestamp, ok boolean, error string, result string",
    )
    steps = spark.createDataFrame([(1, 1, "initializing", at(0)), (1, 2, "ocr", at(5)), (1, 3, "layout", at(20)), (1, 4, "ocr", at(30)), (1, 5, "hashes", at(32)), (2, 6, "ocr", at(1)), (3, 7, "ocr", at(1)), (3, 8, "x", at(2))], "job_id long, step_id long, step string, created_at timestamp")
    samples = spark.createDataFrame([(1, 1, at(10), 900.0, 90.0, 1.0, 2.0), (1, 2, at(60), 500.0, 5.0, 3.0, 4.0), (1, 3, at(61), 999.0, 9.0, 9.0, 9.0), (3, 4, at(1), 1.0, 1.0, 1.0, 1.0)], "job_id long, sample_id long, at timestamp, memory_mb double, cpu_percent double, read_mb double, write_mb double")
    got = {r["job_id"]: r for r in jobs.metrics(made, steps, samples).collect()}
    assert set(got) == {1, 2, 4}
    assert (got[1]["duration"], got[1]["success"], got[1]["error_message"], got[1]["step_durations"]) == (60.0, True, None, {"ocr": 2.0, "layout": 10.0})
    assert (got[1]["steps_completed"], got[1]["steps_failed"], got[1]["page_count"], got[1]["ocr_quality_score"], got[1]["embedding_dimension"]) == (["ocr"], [], 3, 0.5, None)
    assert (got[1]["memory_mb"], got[1]["cpu_percent"], got[1]["read_mb"], got[1]["write_mb"]) == (500.0, 5.0, 3.0, 4.0)
    assert (got[2]["duration"], got[2]["error_message"], got[2]["step_durations"], got[2]["page_count"], got[2]["memory_mb"]) == (9.0, "Unknown error", {}, None, None)
    assert (got[4]["duration"], got[4]["error_message"]) == (0.0, "boom")


def test_history_keeps_the_newest(spark):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i % 7)) for i in range(20)]
    df = spark.createDataFrame(rows, "backup_id long, timestamp timestamp")
    folder = scratch(spark, "kept")
    for lo in (0, 8, 15):
        backups.keep_history(df.where(F.col("backup_id").between(lo, lo + 7)).where(f"backup_id < {20}").dropDuplicates(["backup_id"]), folder, 5)
    held = [r["backup_id"] for r in backups.history(versions.read(spark, folder)).collect()]
    # Entries 15 came twice: with the second run and with the third.
    everyone = sorted([*range(16), *range(15, 20)], key=lambda i: (i % 7, i), reverse=True)
    assert held == everyone[:5]


def test_answers_along_whole_rows(spark):
    """Rows with odd columns go through whole; null prompts aren't asked."""
    df = spark.createDataFrame([(1, "a", [1.0]), (None, None, None), (1, "a", [1.0])], "x long, answer string, v array<double>").toDF("a.b", "answer", "v")
    got = scorers.asked(df, F.col("answer"), lambda texts: [t.upper() for t in texts], "said").collect()
    assert sorted((r["said"], r["said_error"]) for r in got if r["said"]) == [("A", None)] * 2 and [r["a.b"] for r in got if r["said"] is None] == [None]
    failed = scorers.asked(df, F.col("answer"), lambda texts: 1 / 0, "said").where("said_error IS NOT NULL").count()
    assert failed == 2
