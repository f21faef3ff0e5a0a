"""Work and memory that grow no faster than the input: inputs on which earlier versions took too long or too much."""

from __future__ import annotations

import time

from pyspark.sql import functions as F


def test_grams_of_a_long_text_take_one_pass(spark):
    from foliant.operators import languages

    text = "Straße 𝒜𝓑 été, 12 " * 12_000
    letters = " " + "straße 𝒜𝓑 été " * 12_000
    begun = time.monotonic()
    rows = spark.createDataFrame([(1, text), (2, None), (3, "12"), (4, "a")], "doc_id long, text string")
    found = {r["doc_id"]: r["g"] for r in rows.select("doc_id", languages.grams(F.col("text")).alias("g")).collect()}
    assert found == {1: [letters[i : i + 3] for i in range(len(letters) - 2)], 2: [], 3: [], 4: [" a "]}
    assert time.monotonic() - begun < 60


def test_languages_of_whole_texts(spark):
    """Shares of whole texts against a plain count: what comes after the first 1000 characters, pieces' borders, long runs of blanks."""
    import re
    from collections import Counter

    from foliant.operators import languages

    german, french = "Straße und Fluß 𝒜a𝒜a ", "été où ça 𝒜𝒜 va "
    known = {(lang, g): r for lang, own in (("de", german), ("fr", french)) for r, g in enumerate(sorted({(own * 3).lower()[i : i + 3] for i in range(len(own))}), 1)}
    texts = [german * 60 + french * 300, " " * 3000 + french * 9, "ab" + " " * 300_000 + german * 9, "12 " * 400 + french * 40, "a𝒜" * 3000 + german]
    texts += [" " + (german * 50 + french * 100)[:n] + " " for n in (47, 48, 49, 50, 51, 52, *range(996, 1006), *range(1994, 2004))] + [None, "", " " * 99, "7" * 99]

    def plain(text):
        letters = " " + re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip(" ") + " "
        counts, points = Counter(letters[i : i + 3] for i in range(len(letters) - 2)), Counter()
        for (lang, g), rank in known.items():
            points[lang] += counts[g] * (languages.RANKS + 1 - rank)
        if len((text or "").strip()) < 50 or not sum(points.values()):
            return "en", 0.0
        top = max(points, key=lambda lang: (points[lang], lang))
        return top, points[top] / sum(points.values())

    profiles = spark.createDataFrame([(lang, g, r) for (lang, g), r in known.items()], "lang string, gram string, rank int")
    begun = time.monotonic()
    found = languages.detected(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), profiles, "doc_id").collect()
    assert {r["doc_id"]: (r["lang"], r["score"]) for r in found} == {i: plain(t) for i, t in enumerate(texts)}
    assert [plain(t)[0] for t in texts[:4]] == ["fr", "fr", "de", "fr"]
    assert time.monotonic() - begun < 60


def test_blocks_of_a_matrix_are_small(spark):
    from foliant.llm import resample

    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit("w"), (F.col("doc_id") * 7 + i).cast("string"))), " ")
    docs = spark.range(0, 900, 1, 2).withColumnRenamed("id", "doc_id").withColumn("text", F.when(F.col("doc_id") % 10 != 3, words))
    matrix = resample.count_matrix(docs)
    rows = matrix.collect()
    assert max(len(r["buckets"]) for r in rows) <= resample.BLOCK_CELLS + 300
    assert sorted(i for r in rows for i in r["doc_ids"]) == list(range(900))
    assert all(r["starts"][0] == 0 and r["starts"][-1] == len(r["buckets"]) == len(r["counts"]) and len(r["starts"]) == len(r["doc_ids"]) + 1 for r in rows)
    assert {i: n for r in rows for i, n in zip(r["doc_ids"], r["n_words"], strict=True)} == {i: 0 if i % 10 == 3 else 300 for i in range(900)}
    whole = resample.column_sums(matrix)
    assert whole.sum() == 810 * 300
    weighed = resample.weights(matrix, resample.gains(whole, whole[::-1])).collect()
    assert len(weighed) == 900 and all(r["n_features"] == r["n_words"] for r in weighed)


def test_queries_of_an_index_pass_by_a_held_block():
    import numpy as np
    import pyarrow as pa

    from foliant.operators import vectorindex

    rng = np.random.default_rng(5)
    rows, queries = rng.normal(size=(40, 4)), rng.normal(size=(5000, 4))
    most, left = [0], [0]

    def batches():
        """One block, whose queries come in many batches; how many were given before a result was taken."""
        for lo in range(0, 5040, 30):
            asks = np.arange(lo, lo + 30) >= 40
            v = np.concatenate([rows, queries])[lo : lo + 30]
            left[0] += 1
            most[0] = max(most[0], left[0])
            n = len(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + n)), pa.array(list(v), pa.list_(pa.float64())), pa.array([1] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array(asks)], names=["vec_id", "v", "cell", "block", "asks"])

    found = 0
    for part in vectorindex.met(batches(), 3):
        left[0] = 0
        for i in range(0, part.num_rows, 3):
            q = part["vec_id"][i].as_py()
            assert part["other"][i].as_py() == int((rows @ queries[q - 40]).argmax())
        found += part.num_rows
    assert found == 5000 * 3 and most[0] <= 2


def test_samples_go_to_a_model_together(spark):
    import hashlib

    import numpy as np

    from foliant.operators import duplicates as op

    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(1)
        return op.term_vectors(texts)

    texts = ["a b a " * 20, "b a a " * 20, "b b a " * 20, None, "short"] * 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, sample string").coalesce(1)
    found = [r["h"] for r in op.with_sample_hash(df, "sample", "h", model).orderBy("doc_id").collect()]
    assert calls.value == 1 and found == found[:5] * 50
    assert found[0] == found[1] != found[2] is not None and found[3:5] == [None, None]
    plain = np.zeros(op.DIMENSIONS, np.float32)
    for word, n in (("a", 40), ("b", 20)):
        drawn = np.frombuffer(hashlib.blake2b(word.encode(), digest_size=16).digest(), "<u4")
        np.add.at(plain, drawn % op.DIMENSIONS, np.where(drawn >> 31, -n, n).astype(np.float32))
    assert found[0] == hashlib.sha256(plain.tobytes()).hexdigest()


def test_content_keys_need_no_python(spark, sf):
    from foliant.plans import duplicates as plans

    plan = lambda i: plans.keyed(plans.docs(spark, sf), "doc_id", (i,))._jdf.queryExecution().toString()
    assert "MapInArrow" in plan(2) and "MapInArrow" not in plan(1)


def test_a_part_arrives_by_many_tasks(spark):
    from foliant.plans import streams

    made = lambda arrived: arrived.withColumn("file", F.input_file_name())

    df = spark.range(0, 4000, 1, 8).withColumnRenamed("id", "n")
    found = streams.arriving(df, 4, "n", made)
    parts = {r["part"]: r["files"] for r in found.groupBy(F.floor(F.col("n") / 1000).alias("part")).agg(F.count_distinct("file").alias("files")).collect()}
    assert found.count() == 4000
    assert parts == {0: 2, 1: 2, 2: 2, 3: 2}


def test_character_classes_are_made_in_little_memory():
    import subprocess
    import sys
    from pathlib import Path

    code = "import resource; from foliant.llm import bpe; m = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; a = m(); bpe._classes(); print((m() - a) // 1024)"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parent.parent)
    assert int(said.stdout) < 80
