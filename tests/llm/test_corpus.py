"""Resampling, URL rules and alignment against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm import align, resample, urlrules
from foliant.llm.common import table
from foliant.llm.pieces import ByteLevel, byte_letters
from foliant.llm.queries import URL_RULES
from tests.llm import edge

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return edge.documents(spark).cache()


# resampling


def plain_features(text, most=1):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [" ".join(words[i : i + k + 1]) for k in range(most) for i in range(len(words) - k)], len(words)


def plain_resample(rows, target, most=1, buckets=10_000, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    found = [plain_features(t, most) for _, t in rows]
    s = Counter(bucket(f) for fs, _ in found for f in fs)
    t = Counter(bucket(f) for x in target for f in plain_features(x, most)[0])
    over, under = float(s.total() + buckets), float(t.total() + buckets)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * over / ((s[b] + 1.0) * under)))
    out = []
    for (d, _), (fs, words) in zip(rows, found, strict=True):
        w = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words))
    enough = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    drawn = Counter()
    ranks = {}
    for i, r in enumerate(enough[: percent * len(enough) // 100]):
        ranks.setdefault(r, []).append(i + 1)
    for r in out:
        drawn[r] += 1
    ranked = [(*r[:4], ranks[r][k] if k < len(ranks.get(r, [])) else None) for r, n in drawn.items() for k in range(n)]
    return sorted(ranked, key=str)


@pytest.mark.parametrize(("most", "percent"), [(1, 10), (1, 100), (3, 50)])
def test_resample(docs, most, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    target = [rows[0][1], None, "", "one TWO", rows[40][1]]
    got = resample.resample(docs, docs.sparkSession.createDataFrame([(t,) for t in target], "text string"), most_words=most, percent=percent)
    assert sorted(map(tuple, got.collect()), key=str) == plain_resample(rows, target, most, percent=percent)


def test_resample_without_rows(spark, docs):
    none = docs.limit(0)
    assert resample.resample(none, docs).count() == 0
    got = resample.resample(docs, none)
    assert sorted(map(tuple, got.collect()), key=str) == plain_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [])
    odd = edge.oddly_named(spark)
    assert sorted(map(tuple, resample.resample(odd, none).collect()), key=str) == sorted(map(tuple, got.collect()), key=str)


def test_blocks_hold_what_texts_hold(docs):
    """Cells of all blocks, however the texts are dealt to them."""
    cells = Counter()
    for r in resample.count_matrix(docs).collect():
        for i, d in enumerate(r["doc_ids"]):
            for k in range(r["starts"][i], r["starts"][i + 1]):
                cells[d, r["buckets"][k]] += r["counts"][k]
    want = Counter()
    for r in docs.collect():
        want.update((r["doc_id"], zlib.crc32(f.encode()) % 10_000) for f in plain_features(r["text"])[0])
    assert cells == want


def test_crc():
    words = [b"", b"a", b"abc" * 50, b"x" * 64, b"y" * 65, bytes(range(256))]
    ends = np.cumsum([len(w) for w in words])
    got = resample.crc32_of(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    assert got.tolist() == [zlib.crc32(w) for w in words]


# URL rules


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host, path = m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if h and v in ("allow", "block") and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


URLS = [
    "http://a.net/", "http://net/x", "http://a.net", "http://a.net?x/", "HTTP://A.B.Example.NET/en/x?q#r", "http://example.net/en", "http://xexample.com/de/", "http://example.com/de/1", "http://www.example.com/de/#x",
    "https://q.org/fr/", "https://q.org/FR/", None, "", "no scheme", "://", "a://b://c.net/", "http:///p", "http://net./x", "http://.net/", "http://exa mple.net/en/", "http://ÄX.NET/",
    "http://" + "a." * 3000 + "net/" + "d/" * 3000, "http://u@b.net:80/", "http://a.net/\n/en/", "http://b.example.net\n/en/", "http://a.net/", "http://a.net/",
]


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_urls(spark, broadcast):
    rules = [*URL_RULES, ("allow", "net", "/"), ("block", "b.net", ""), ("allow", "c.net", "/x"), ("block", "", "/"), ("odd", "org", "/fr/"), ("block", "a.b.example.net", "/e")]
    table_ = spark.createDataFrame([*rules, ("allow", None, "/"), ("block", "b.net", None)], "verdict string, host string, path string").withColumn("rule", F.lit(1))
    pages = spark.createDataFrame([(i if i % 5 else None, u, "h") for i, u in enumerate(URLS)] + [(25, URLS[25], "h")], "page_id long, url string, host string").withColumn("rows_", F.lit(1)).withColumn("verdict", F.lit(1))
    want = sorted(((r["page_id"], *plain_verdict(r["url"], [*rules, ("block", "b.net", "")])) for r in pages.collect()), key=str)
    assert sorted(map(tuple, urlrules.judge(pages, table_, broadcast).collect()), key=str) == want


def test_no_urls_or_rules(spark):
    rules = urlrules.rules_of(spark, URL_RULES)
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert urlrules.judge(pages.limit(0), rules).count() == 0
    assert [tuple(r) for r in urlrules.judge(pages, rules.limit(0)).collect()] == [(1, "a.net", "/", None, "allow")]


# alignment


def plain_sides(text, left, right):
    """Ids and byte ranges of both sides; nothing where bytes differ."""
    if not text:
        return [], []
    letters, whole, sides = byte_letters(), (" " + text).encode(), []
    e = left.encode(" " + text, add_special_tokens=False)
    b = right.encode(text)
    for ids, tokens in ((e.ids, [bytes(letters[c] for c in k) for k in e.tokens]), (b, [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in b])):
        ends = np.cumsum([len(t) for t in tokens]).tolist()
        if b"".join(tokens) != whole:
            return [], []
        sides.append([(i, hi - len(t), hi) for i, t, hi in zip(ids, tokens, ends, strict=True)])
    return sides


def plain_alignment(rows):
    left, right = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    left.encode_special_tokens = True
    sides = [plain_sides(t, left, right) for _, t in rows]
    links = []
    for a, b in sides:
        own, j = [], 0
        for i, lo, hi in a:
            while b[j][2] <= lo:
                j += 1
            k = j
            while k < len(b) and b[k][1] < hi:
                own.append((i, b[k][0]))
                k += 1
        links.append(own)
    count = Counter(x for own in links for x in own)
    top = Counter()
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    out = []
    for (d, _), (a, b), own in zip(rows, sides, links, strict=True):
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        parts = [([], []) for _ in ends]
        for k, side in enumerate((a, b)):
            for i, _, hi in side:
                parts[bisect_left(ends, hi)][k].append(str(i))
        groups = [",".join(x) + "|" + ",".join(y) for x, y in parts]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((d, len(a), len(b), len(groups), len(own), sum(count[x] == top[x[1]] for x in own), sum(count[x] for x in own), digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_alignment(spark, broadcast):
    rows = [(d, t[:3000] if t else t) for d, t, *_ in edge.rows()]
    rows += [(200 + i, t) for i, t in enumerate(["a  b", " lead", "trail ", "\n\n a \t b", "<|endoftext|> x", "</s><unk>", "▁x", "x ▁ y", "ﬁé́", "\x00a", "日本 語", "a\u00a0b", "it's 's"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit(3)).withColumn("a", F.lit("x")).withColumn("links", F.lit(1))
    got = align.align(df, BYTES, PIECES, broadcast)
    assert sorted(map(tuple, got.collect()), key=str) == plain_alignment(rows)


def test_alignment_of_the_smallest_table(spark, sf):
    df = table(spark, sf, "documents")
    got = align.align(df, BYTES, PIECES)
    assert sorted(map(tuple, got.collect()), key=str) == plain_alignment([(r["doc_id"], r["text"]) for r in df.collect()])


def test_a_task_aligns_each_part_once(spark):
    texts = ["one two  three\n four", "two one", "", None, "one two", " three\tfour "]
    rows = [(i, texts[i % 6]) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    made = align.tokens(df, BYTES, PIECES)
    left = Tokenizer.from_file(BYTES)
    once = sum(len(left.encode(" " + t).ids) for t in texts if t)
    assert made.agg(F.sum(F.size("a"))).first()[0] <= once
    assert sorted(map(tuple, align.align(df, BYTES, PIECES).collect()), key=str) == plain_alignment(rows)


def test_alignment_by_a_task_that_forgets(spark):
    rows = [(d, t[:3000] if t else t) for d, t, *_ in edge.rows()]
    rows += [(1000 + i, f"again and again {i % 7} ▁ x" if i % 3 else f"plain words {i % 5}  two ") for i in range(1500)]
    made = align.tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), BYTES, PIECES, 200)
    assert made.where("first = 0").count() > 1
    got = align.aligned(made).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((*r[:5], r[7]) for r in plain_alignment(rows)), key=str)


def test_long_copies_are_put_together_in_small_batches():
    known = align._Parts()
    known.learn(pa.RecordBatch.from_pylist([{"first": 0, "parts": [3, 5], "common": [3, 5], "groups": "1|2,3;4|5", "ends": [1, 3, 5], "links": [12, 13, 45]}]))
    rows = pa.RecordBatch.from_pylist([{"doc_id": d, "n_a": 0, "n_b": 0, "parts": [0, 1] * n} for d, n in enumerate([1, 50, 0, 50, 1, 1])])
    found = list(known.put_together(rows.cast(pa.schema([*list(rows.schema)[:3], ("parts", pa.list_(pa.int32()))])), True, 100))
    assert [b.column("doc_id").to_pylist() for b in found] == [[0, 1], [2, 3], [4, 5]]
    whole = [x for b in found for x in b.to_pylist()]
    assert [x["links"] for x in whole] == [[12, 13, 45] * n for n in (1, 50, 0, 50, 1, 1)]
    assert [(x["n_groups"], x["n_links"], x["groups"]) for x in whole] == [(2 * n, 3 * n, ";".join(["1|2,3;4|5"] * n)) for n in (1, 50, 0, 50, 1, 1)]


def test_parts_joined_for_the_library():
    parts = [" a", " ", " it's", " x\n", "  y", " tab\t", " \u00a0z", " ﬁé́", " 日本"] * 30
    side = ByteLevel(BYTES)
    ids, sizes = side.ids_of(parts, np.cumsum([len(p.encode()) for p in parts]))
    alone = [side.library.encode(p, add_special_tokens=False).ids for p in parts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == alone


def test_nothing_to_align(docs):
    assert align.align(docs.limit(0), BYTES, PIECES).count() == 0
