"""Stores in versions, the vector index, and documents as a data source: damage, conflicts, recall, pruning."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliant.operators import backups, vectorindex, versions
from foliant.operators import vectors as exact
from foliant.sources import documents, files
from foliant.sources import tables as src


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(200).select("id", (F.col("id") % 7).alias("x"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("t"), F.col("id"))).alias("a.b")).cache()


def part():
    return F.col("id") % 8


def test_versions(spark, rows, tmp_path):
    folder = str(tmp_path)
    assert versions.commit(rows, folder, part(), note="one") == 1
    changed = rows.withColumn("x", F.when(F.col("id") == 11, 99).otherwise(F.col("x")))
    assert versions.commit(changed, folder, part()) == 2
    written = {r["v"]: r["written"] for r in versions.history(spark, folder).collect()}
    assert written == {1: 8, 2: 1}
    assert sorted(versions.read(spark, folder, 1).collect()) == sorted(rows.collect())
    assert sorted(versions.read(spark, folder).collect()) == sorted(changed.collect())
    assert versions.read(spark, folder, parts=["3"]).count() == 25
    assert versions.verify(spark, folder).where("sound").count() == 8
    assert versions.unreferenced(spark, folder, [2]).count() == 1
    with pytest.raises(versions.Conflict):
        versions.commit(rows, folder, part(), base=1)
    versions.merge(rows.where("id = 12").withColumn("x", F.lit(1).cast("long")), folder, "id", part(), gone=rows.where("id IN (20, 3)").select("id"))
    now = {r["id"]: r["x"] for r in versions.read(spark, folder).collect()}
    assert len(now) == 198 and now[12] == 1 and now[11] == 99 and 20 not in now
    safety, restored = versions.restore(versions.read(spark, folder), folder, part(), 1)
    assert sorted(versions.read(spark, folder, restored).collect()) == sorted(rows.collect()) and versions.read(spark, folder, safety).count() == 198
    assert {r["v"]: r["written"] for r in versions.history(spark, folder).collect()}[restored] == 0


def test_empty_versions(spark, rows, tmp_path):
    folder = str(tmp_path)
    assert versions.commit(rows.limit(0), folder, part()) == 1 and versions.commit(rows, folder, part()) == 2
    assert versions.commit(rows.limit(0), folder, part()) == 3
    assert versions.read(spark, folder).count() == 0 and versions.read(spark, folder, 2).count() == 200
    nulls = rows.withColumn("id", F.when(F.col("id") > 5, F.col("id")))
    versions.commit(nulls, folder, part())
    assert versions.read(spark, folder).where("id IS NULL").count() == 6


def test_damage_is_found(spark, rows, tmp_path):
    folder = str(tmp_path)
    entry = backups.write_backup(rows, folder, "b", part=part())
    assert backups.verify(spark, entry)
    hurt = next(Path(folder, "data").glob("part=5/*/*.parquet"))
    hurt.write_bytes(hurt.read_bytes()[:40] + b"x" * 200)
    hurt.with_name(f".{hurt.name}.crc").unlink(missing_ok=True)
    assert [r["part"] for r in versions.verify(spark, folder).where("not sound").collect()] == ["5"]
    with pytest.raises(ValueError, match="damaged"):
        backups.restore(spark, entry)
    Path(hurt).unlink()
    assert not backups.verify(spark, entry)


def test_damaged_write_is_found(spark, rows, tmp_path, monkeypatch):
    stored = versions._stored
    monkeypatch.setattr(versions, "_stored", lambda *a, **b: stored(*a, **b).where("id <> 17"))
    with pytest.raises(OSError, match="differ"):
        versions.commit(rows, str(tmp_path), part())
    assert versions.latest(spark, str(tmp_path)) == 0


def test_index(spark, sf, tmp_path):
    folder, own = str(tmp_path / "i"), src.vectors(spark, sf).select("vec_id", "v")
    vectorindex.build(own, folder, 16)
    want = exact.nearest_rows(own, 10).cache()
    probes = vectorindex.probes_for(own, folder, 10, 0.95)
    found = vectorindex.nearest(own, folder, 10, probes)
    assert probes < 16 and vectorindex.recall(found, want) >= 0.9
    assert vectorindex.recall(vectorindex.nearest(own, folder, 10), want) == 1.0
    vectorindex.upsert(spark.createDataFrame([(10**6, own.where("vec_id = 4").first()["v"]), (10**6 + 1, [0.0] * 64)], "vec_id long, v array<double>"), folder, own.where("vec_id = 7").select("vec_id"))
    first = vectorindex.nearest(own.where("vec_id = 4"), folder, 1, 1).first()
    assert first["other"] == 10**6 and abs(first["similarity"] - 1) < 1e-9
    held = {r["vec_id"] for r in versions.read(spark, folder).select("vec_id").collect()}
    assert 7 not in held and 10**6 + 1 in held and len(held) == own.count() + 1
    plan = vectorindex.similar_to(spark, folder, own.first()["v"], 5, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part#" in plan.split("PartitionFilters")[1][:200]


def test_clustered_vectors_need_few_cells(spark, tmp_path):
    """Where vectors do have neighbourhoods, a search looks into few of them."""
    import random

    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    data = [(i, [c + rng.gauss(0, 0.15) for c in centres[i % 12]]) for i in range(600)]
    own = spark.createDataFrame(data, "vec_id long, v array<double>")
    vectorindex.build(own, str(tmp_path / "c"), 12)
    probes = vectorindex.probes_for(own, str(tmp_path / "c"), 5, 0.95)
    assert probes <= 3 and vectorindex.recall(vectorindex.nearest(own, str(tmp_path / "c"), 5, probes), exact.nearest_rows(own, 5)) >= 0.9


def test_document_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"%Title: A title\n%Author: Ann\nfirst \x0csecond\x0c\x0cfourth")
    (tmp_path / "b.txt").write_bytes(b"one \xff\x0ctwo")
    (tmp_path / "c.txt").write_bytes(b"x" * 500)
    (tmp_path / "d.bin").write_bytes(b"no")
    (tmp_path / "e.txt").write_bytes(b"")
    spark.dataSource.register(documents.DocumentFiles)
    read = lambda **o: spark.read.format("documents").options(pattern="*.txt", maxBytes=400, partitionBytes=1, **o).load(f"file://{tmp_path}")
    pages = sorted((r["path"][-5:], r["page_number"] or 0, r["text"] or "", (r["error"] or "")[:9]) for r in read().collect())
    assert pages == [("a.txt", 1, "first", ""), ("a.txt", 2, "second", ""), ("a.txt", 3, "", ""), ("a.txt", 4, "fourth", ""), ("b.txt", 0, "", "'utf-8' c"), ("c.txt", 0, "", "too_large"), ("e.txt", 1, "", "")]
    whole = {r["path"][-5:]: r for r in read(detail="files").collect()}
    assert (whole["a.txt"]["title"], whole["a.txt"]["author"], whole["a.txt"]["page_count"], whole["a.txt"]["pages"]) == ("A title", "Ann", 4, ["first ", "second", ""])
    assert whole["c.txt"]["error"] == "too_large" and whole["e.txt"]["page_count"] == 1
    assert read().rdd.getNumPartitions() == 4


def test_page_blocks(spark):
    one = lambda *p: spark.range(1).select(files.page_blocks(F.array(*[F.lit(x) for x in p])).alias("x")).first()["x"]
    assert one("a ", "b", "c") == "[PAGE 1]\na\n\n[PAGE 2]\nb"
    assert one("a", " \n", "c") == "[PAGE 1]\na" and one("", "b") == "" and one(None, "b") == ""
