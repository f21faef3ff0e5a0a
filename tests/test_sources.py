from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import backups, uploads
from foliant.sources import files, scorers
from foliant.sources import tables as src
from foliant.streaming import jobs


def test_stream_decides_as_batch_does(spark, sf):
    stream = jobs.event_stream(spark, sf).select("event_id", (F.col("user_id") % 5).alias("client"), "ts")
    got = jobs.run_once(jobs.upload_decisions(stream, 2, 10), "append")
    events = src.events(spark, sf).select("event_id", (F.col("user_id") % 5).alias("client"), F.col("ts").alias("at"))
    want = uploads.decisions(events, 2, 10).select("event_id", "client", "accepted")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_breaker_stream_as_batch(spark, sf):
    stream = jobs.event_stream(spark, sf).select("event_id", F.col("event_type").alias("service"), "ts", (F.col("value") > 20).alias("ok"))
    got = jobs.run_once(jobs.breaker_states(stream), "append")
    calls = src.events(spark, sf).select("event_id", F.col("event_type").alias("service"), F.col("ts").alias("at"), (F.col("value") > 20).alias("ok"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, uploads.breaker(calls).select("event_id", "service", "allowed", "state").collect()))


def test_backup_round_trip(spark, tmp_path):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    entry = backups.write_backup(df, str(tmp_path), "b1")
    assert sorted(backups.restore(spark, entry).collect()) == sorted(df.collect())
    assert not backups.verify(spark, entry | {"checksum": "0"})


def test_files(spark, tmp_path):
    for name in ("a.pdf", "a.json", "b.pdf", "c.tar.gz"):
        (tmp_path / name).write_bytes(b"one\ftwo" if name != "b.pdf" else b"bad")
    held = {r["name"]: r["noted"] for r in files.quarantine(spark, str(tmp_path)).collect()}
    assert held == {"a.pdf": True, "b.pdf": False, "c.tar.gz": False}
    assert files.archive_totals(spark, str(tmp_path)).first()["files"] == 1

    def reader(content: bytes) -> list[str]:
        if content == b"bad":
            raise ValueError("not a document")
        return content.decode().split("\f")

    found = files.page_texts(spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(str(tmp_path)), reader)
    assert sorted((r["page_number"], r["text"], r["error"]) for r in found.collect() if r["error"] is None) == [(1, "one", None), (2, "two", None)]
    assert found.where("error IS NOT NULL").first()["error"] == "not a document"


def test_size_marks(spark):
    spans = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(t).alias("text")) for s, t in ((18.0, "Title"), (10.0, "body"), (11.0, "more"))])
    assert spark.range(1).select(files.size_marks(spans).alias("x")).first()["x"] == "[FONT_SIZE:18]\nTitle\n\n[FONT_SIZE:10]\nbody\nmore"


def test_failing_model(spark):
    def model(texts: list[str]) -> list[str | None]:
        if "bad" in texts:
            raise RuntimeError("down")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "k long, t string").coalesce(1)
    got = sorted((r["k"], r["answer"], r["error"]) for r in scorers.answered(df, "k", "t", model).collect())
    assert got == [(1, "A", None), (2, None, "down"), (3, "", None)]
