"""The operators on vectors, pages and conversations against plain versions; the pipeline's stages."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import public_tokenizers
import pyarrow.fs
import zstandard
from hypothesis import given
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from foliant.llm import chat, topk, vptree, warc
from foliant.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
ASKED = "vec_id % 50 = 0"
VECTORS = "vec_id long, embedding array<float>, label int, rank int, score double"


def odd_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(300)]
    rows += [(300 + i, rows[100][1]) for i in range(40)]
    rows += [(400, None), (450, []), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [float("inf")] + [1.0] * 7), (404, [None] + [1.0] * 7), (405, [1.0, 2.0]), (406, [1.0, 3.0]), (500, [1.0, 2.5]), (None, rows[0][1]), (50, rows[50][1])]
    return spark.createDataFrame([(i, v, 1, 9, 0.1) for i, v in rows], VECTORS)


def sound(df):
    out = [(r["vec_id"], np.array(r["embedding"], float)) for r in df.select("vec_id", "embedding").collect() if r["vec_id"] is not None and r["embedding"] and None not in r["embedding"]]
    return [(i, v) for i, v in out if np.isfinite(v).all()]


def plain_top(rows, measure, k=5):
    want = {}
    for q, x in rows:
        if q % 50 == 0:
            found = sorted((-measure(x, v), i) for i, v in rows if i != q and len(v) == len(x))
            want[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return want


def cosine(a, b):
    return float((a * b).sum() / (np.linalg.norm(a) * np.linalg.norm(b)))


def grouped(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_exact_search(spark, sf):
    for df in (odd_vectors(spark), table(spark, sf, "embeddings")):
        rows = [(i, v) for i, v in sound(df) if v.any()]
        got, want = grouped(vptree.nearest(df, F.expr(ASKED), factor=1.0)), plain_top(rows, cosine)
        assert got.keys() == want.keys()
        for q, hits in want.items():
            assert [(a, b) for a, b, _ in got[q]] == [(a, b) for a, b, _ in hits] and np.allclose([c for *_, c in got[q]], [c for *_, c in hits], atol=1e-12)


def test_ties_and_extreme_sizes(spark):
    """Multiples of a vector are as near as it is; sizes whose squares overflow or vanish change no cosine."""
    rng = np.random.default_rng(3)
    base, rows = rng.normal(size=8), [(50, rng.normal(size=8))]
    rows += [(120 - i, base * (i + 1)) for i in range(20)] + [(200 + i, rng.normal(size=8) / 8 * size) for i, size in enumerate([1e200, 1e-170, 1e308, 5e-320] * 10)]
    rows[0] = (50, base + 0.01 * rows[0][1])
    got = grouped(vptree.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>"), F.expr(ASKED), factor=1.0))
    assert [v for _, v, _ in got[50]] == [101, 102, 103, 104, 105]
    large = np.array([v for i, v in rows if i >= 200])
    own = vptree.scaled(large)
    assert np.isfinite(own).all() and (np.abs(own).max(1) >= 0.5).all()
    assert all(abs(s) <= 1 for hits in got.values() for *_, s in hits)
    ones = [(i, np.eye(6)[i % 6].tolist()) for i in range(300)] + [(300 + i, rng.integers(-1, 2, 6).astype(float).tolist()) for i in range(301)]
    ones = [(i, v) for i, v in ones if any(v)]
    got = grouped(vptree.nearest(spark.createDataFrame(ones, "vec_id long, embedding array<double>"), F.expr(ASKED), factor=1.0))
    exact = lambda a, b: round(cosine(a, b), 12)
    want = plain_top([(i, np.array(v)) for i, v in ones], exact)
    assert {q: [v for _, v, _ in h] for q, h in got.items()} == {q: [v for _, v, _ in h] for q, h in want.items()}


def test_trees_are_built_once():
    """Five blocks of queries, in small batches, meet the same tree; shards without queries build none."""
    rng, built = np.random.default_rng(4), []
    dims, rows = 40_000, []
    own = {s: rng.normal(size=(7, dims)) for s in range(3)}
    for shard, asked_ in ((0, 300), (1, 0), (2, 1)):
        rows += [(dims, shard, False, 10 * shard + i, own[shard][i]) for i in range(7)]
        rows += [(dims, shard, True, 1000 + i, own[shard][i % 7] * 2) for i in range(asked_)]

    def build(x, ids):
        built.append(sorted(ids.tolist()))
        return vptree.Shard(x, ids, 1, 1.0)

    def batches():
        for lo in range(0, len(rows), 11):
            part = list(zip(*rows[lo : lo + 11], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.int32()), pa.array(part[2]), pa.array(part[3], pa.int64()), pa.array(list(part[4]), pa.list_(pa.float64()))], names=["dim", "shard", "asks", "vec_id", "vector"])

    blocks = [hits for hits in vptree.in_shards(batches(), build) if hits]
    assert built == [list(range(7)), list(range(20, 27))] and len(blocks) == 6 and vptree.block_of(dims) == 64
    assert [(q, v) for hits in blocks for q, v, _ in hits] == [(1000 + i, i % 7) for i in range(300)] + [(1000, 20)]


def test_recall(spark, sf):
    df = table(spark, sf, "embeddings")
    got, want = grouped(vptree.nearest(df, F.expr(ASKED))), plain_top(sound(df), cosine)
    hit = sum(len({v for _, v, _ in got[q]} & {v for _, v, _ in hits}) for q, hits in want.items())
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_top_products(spark, sf):
    for df in (odd_vectors(spark), table(spark, sf, "embeddings")):
        rows = [(i, np.floor(v.astype(float) * 256).astype(int)) for i, v in sound(df)]
        assert grouped(topk.top_products(df, F.expr(ASKED))) == plain_top(rows, lambda a, b: int((a * b).sum()))


def test_top_products_of_large_vectors(spark):
    rng = np.random.default_rng(8)
    size = [1.0, 5e3, 2e5, 3e8, 1e12, 1e200, 1e308]
    rows = [(i, (rng.normal(size=6) / 8 * size[rng.integers(7)]).tolist()) for i in range(250)]
    rows += [(300 + i, (np.floor(rng.normal(size=6) * 3e8) + rng.integers(0, 2, 6) / 256).tolist()) for i in range(201)]
    rows += [(600 + i, [2.0**26 + i % 3] * 6) for i in range(40)]
    whole = {i: np.array([math.floor(Fraction(c) * 256) for c in v], object) for i, v in rows}
    long = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    for some in (rows, rows[250:], [r for r in rows if max(map(abs, r[1])) < 1e6]):
        got = grouped(topk.top_products(spark.createDataFrame(some, "vec_id long, embedding array<double>"), F.expr(ASKED)))
        assert got == plain_top([(i, whole[i]) for i, _ in some], lambda a, b: long(int((a * b).sum())))


def test_reading_stops_early():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (4000, 4)) ** 3
    lists = topk.SortedLists(np.floor(x * 50).astype(np.int64), np.arange(4000))
    assert lists.top(np.array([100, -80, 0, 0]), 7, 5)[1] < 1  # reading on for the final scores included


def test_scores_come_from_the_lists():
    """No vector is kept beside the lists, and what stands after the places that were read changes nothing."""
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(0, 100, (3000, 1)) * [1, -1, 1, 1, 1] + rng.normal(0, 5, (3000, 5))).astype(np.int64)
    lists, q = topk.SortedLists(x, np.arange(3000)), np.array([90, -7, 2, 0, 30])
    assert set(vars(lists)) == {"ids", "most", "shift", "rows", "first", "last", "gains", "whole"}
    found, read = lists.top(q, -1, 5)
    score = x @ q
    assert read < 1 and found == sorted(zip(score.tolist(), range(3000), strict=True), key=lambda f: (-f[0], f[1]))[:5]
    beyond = round(read * 3000)
    lists.rows[:, beyond:], lists.gains[:, beyond:], lists.whole[:] = 0, 0, 0
    assert lists.top(q, -1, 5) == (found, read)


def test_no_vectors(spark):
    none = odd_vectors(spark).limit(0)
    assert vptree.nearest(none, F.expr(ASKED)).count() == 0 and topk.top_products(none, F.expr(ASKED)).count() == 0


def pages(spark):
    rows = [(3, "http://x/1", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://x/2\r\nX: y", None), (4, "u", ""), (5, "u", "<a>" * 30_000), (6, "u", "plain"), (None, "u", "plain"), (None, "u", "alone"), (6, "u", "plain"), (7, "u", "a\r\n\r\nb\r\n")]
    rows += [(100 + i, f"http://h/{i}", f"<html>{'shared ' * 50}{i % 40}</html>") for i in range(400)]
    return spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, first int")


def plain_records(rows):
    body = lambda r: (r["html"] or "").encode()
    first = {}
    for r in rows:
        if r["page_id"] is not None:
            first[body(r)] = min(first.get(body(r), r["page_id"]), r["page_id"])
    out = []
    for r in rows:
        f = first.get(body(r))
        kind = "response" if f is None or f == r["page_id"] else "revisit"
        out.append((r["page_id"], len(body(r)), base64.b32encode(hashlib.sha1(body(r)).digest()).decode(), kind, f if kind == "revisit" else None))
    return sorted(out, key=str)


def test_archives(spark):
    df = pages(spark)
    folder = warc.write_archives(df)
    got = warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == plain_records(df.collect())
    system, root = pyarrow.fs.FileSystem.from_uri(folder)
    names = [f.base_name for f in system.get_file_info(pyarrow.fs.FileSelector(root))]
    assert names and all(n.endswith(".warc.zst") for n in names)
    content = system.open_input_stream(f"{root}/{sorted(names)[0]}", compression=None).read()
    assert content[:4] == b"\x5d\x2a\x4d\x18"
    assert next(warc.records_of(io.BytesIO(content))).startswith(b"WARC/1.1\r\n")


def test_many_archives_and_large_pages(spark):
    """Archives by bytes, those of one or two records too, all with a dictionary; a page larger than a read and a batch."""
    df = pages(spark).unionByName(spark.createDataFrame([(900 + i, "u", "".join(map(chr, range(40, 120))) * 40_000 + str(i), "d", 1) for i in range(3)], pages(spark).schema))
    folder = warc.write_archives(df, archive_bytes=20_000)
    got = warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == plain_records(df.collect())
    system, root = pyarrow.fs.FileSystem.from_uri(folder)
    names = [f.path for f in system.get_file_info(pyarrow.fs.FileSelector(root))]
    assert len(names) > 100 and all(system.open_input_stream(n, compression=None).read(4) == b"\x5d\x2a\x4d\x18" for n in names)
    for few in ([b"WARC/1.1 one record"], [b"x" * 100] * 20):
        dictionary = warc.train(few)
        whole = io.BytesIO(warc.frame_of(dictionary) + b"".join(zstandard.ZstdCompressor(dict_data=dictionary).compress(r) for r in few))
        assert list(warc.records_of(whole)) == few


def test_small_payloads_are_not_revisited(spark):
    df = pages(spark)
    kinds = warc.read_archives(spark, warc.write_archives(df, least_bytes=20)).where("payload_bytes < 20").select("record_type").distinct().collect()
    assert [r[0] for r in kinds] == ["response"]


def test_no_pages(spark):
    assert warc.read_archives(spark, warc.write_archives(pages(spark).limit(0))).count() == 0


turns_of = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "<|turn|>"]), st.lists(st.sampled_from([*"ab \n<|>\\é😀's", "<|end|>", "<|text|>"]), max_size=12).map("".join)), max_size=5)


@settings(deadline=None, max_examples=200)
@given(turns_of)
def test_chats_round_trip(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for _, t in turns]
    library = chat.marked_library(PATH)
    ids, offsets = chat.encode(library, ["", formatted])[1]
    marks = [library.token_to_id(m) for m in chat.MARKS]
    assert [ids.tolist().count(m) for m in marks] == [len(turns)] * 3 and library.decode(ids.tolist(), skip_special_tokens=False) == formatted
    mask = chat.token_mask(offsets, [s for s, (role, _) in zip(spans, turns, strict=True) if role == "assistant"])
    assert "".join(chat.masked_text(formatted, offsets, mask)) == "".join(t for role, t in turns if role == "assistant")


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, None, "<|end|> \\<|"), (1, None, "assistant", "last"), (2, 0, "assistant", "x" * 50_000), (None, 0, "user", "lost"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    df = spark.createDataFrame([(*r, "f") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(chat.with_tricky(df), PATH)).collect()}
    digest = lambda *turns: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert out[1]["turns_sha256"] == digest(("user", "hi"), ("assistant", ""), ("", "<|end|> \\<|"), ("assistant", "last"))
    assert out[1]["loss_sha256"] == hashlib.sha256(b"last").hexdigest() and out[2]["loss_chars"] == 50_000
    assert out[3]["loss_sha256"] == hashlib.sha256(b"samesame").hexdigest() and out[None]["n_turns"] == 1
    assert out[-7]["loss_chars"] == len(chat.TRICKY) and set(out) == {1, 2, 3, None, -7}
    assert chat.read_back(chat.format_conversations(df.limit(0), PATH)).count() == 0


def test_queries_against_sql(spark, sf, duck):
    from tests.compare import rows_of_duck, rows_of_spark

    from foliant.llm.oracles import ORACLES
    from foliant.llm.queries import QUERIES

    assert len(QUERIES) == 10
    for name in ("op2_exact_top_k", "op3_warc", "op9_chat_formatting"):
        assert rows_of_spark(QUERIES[name](spark, sf)) == rows_of_duck(duck, ORACLES[name])


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "minhash_near_dedup", "pii", "mixing", "best_fit_packing"]
    docs = table(spark, sf, "documents")
    own = docs.columns
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    held = [docs]
    for name, stage in p.STAGES:
        held.append(p.materialize(stage(spark, held[-1], sf), f"test-{name}"))
    for d in held[:-1]:
        assert d.columns == own
    calm, single, clean, mixed, packed = held[1:]
    marked = table(spark, sf, "labels").where("toxic = 0").join(calm, "doc_id", "left_anti").count()
    assert marked <= 0.02 * docs.count() and ids(single) <= ids(calm)
    from foliant.llm import minhash, pii

    assert minhash.near_duplicates(single).where("NOT kept").count() == 0
    assert pii.report(clean).agg(F.sum(F.expr("n_email + n_card + n_phone + n_ip"))).first()[0] == 0
    assert clean.count() == single.count() and ids(mixed) <= ids(clean)
    total = mixed.count()
    assert packed.where("piece = 0").count() == total
    assert json.dumps(sorted(packed.columns)) == json.dumps(["doc_id", "ids_crc32", "length", "offset", "piece", "sequence_id", "start"])


def test_stages_on_odd_tables(spark, sf):
    """Clashing and dotted names, nulls, empty and long texts, repeated rows, in each stage; and no rows at all."""
    import corpus_pipeline as p

    from tests.llm import edge

    docs = edge.oddly_named(spark)
    for name, stage in p.STAGES:
        out = p.materialize(stage(spark, docs, sf), f"odd-{name}")
        none = stage(spark, docs.limit(0), sf)
        assert none.count() == 0 and none.columns == out.columns
        if name == "best_fit_packing":
            assert out.where("piece = 0").count() == docs.count()
            continue
        assert out.columns == docs.columns
        kept = [(r["doc_id"], r["two words"], r["a.b"]) for r in out.collect()]
        assert kept and {k[1:] for k in kept} == {(5, 4)}
        if name in ("toxicity", "pii"):
            assert len(kept) == docs.count()
