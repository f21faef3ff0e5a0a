"""The operators on documents against plain versions, on odd cases and on the smallest table."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm import bpe, langid, learning, minhash, mixing, packing, pii, toxicity
from foliant.llm.common import table
from foliant.llm.graph import components
from tests.llm import edge

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return edge.documents(spark).cache()


@pytest.fixture(scope="module")
def small(spark, sf):
    return table(spark, sf, "documents")


def library():
    return Tokenizer.from_file(PATH)


# near duplicates


def plain_components(rows, percent=75):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    found = [min((d for d in least[root(i)] if d is not None), default=None) if sets[i] else rows[i][0] for i in range(len(rows))]
    return sorted(((d, len(s), c, d == c) for (d, _), s, c in zip(rows, sets, found, strict=True)), key=str)


def test_near_duplicates(docs, small):
    for df in (docs, small):
        want = plain_components([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
        assert sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str) == want


def test_near_copies_in_large_groups(spark):
    import random

    rng = random.Random(8)
    base = edge.sentence(rng, 100).split()
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            words[rng.randrange(100)] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == plain_components(rows)


def test_rows_without_ids_keep_their_own_sets(spark):
    import random

    rng = random.Random(3)
    a = edge.sentence(rng, 60)
    half = a.split()
    half[20:] = edge.sentence(rng, 40).split()
    c = a.split()
    c[5:18] = ["other"] * 13
    c, d = " ".join(c), " ".join(half)
    rows = [(None, a), (None, c), (9, a + " zz"), (4, c + " yy"), (7, d), (7, d + " q"), (7, c), (7, c), (3, d + " z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str) == plain_components(rows)
    assert {r["doc_id"] for r in minhash.keep_first(df).collect()} >= {9, 4, 3}


def test_no_documents(docs):
    none = docs.limit(0)
    assert minhash.near_duplicates(none).count() == 0
    assert mixing.taken_words(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert packing.pack(none, PATH).count() == 0
    assert pii.report(none).count() == 0
    assert langid.identify(none).count() == 0
    assert toxicity.scores(none, none.select("doc_id", F.lit(1).alias("toxic"))).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(5, 5)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got) == {*range(41), *range(100, 120)} and len({got[i] for i in range(41)}) == 1 and len({got[i] for i in range(100, 120)}) == 1


def test_keep_first(docs):
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[0] == 2 and ids[1] == ids[2] == ids[8] == 0 and ids[4] == ids[5] == ids[7] == 1 and ids[None] == 2


# mixing


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free = dict.fromkeys(names, 0.0), set(names)
    left = sum(sizes.values())
    while free and left > 1e-9:
        rate = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * rate > most * sizes[s]}
        if not over:
            return target | {s: weight[s] * rate for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("which", ["docs", "small"])
def test_mixing(which, docs, small):
    df = docs if which == "docs" else small
    rows = mixing.taken_words(df).collect()
    assert len(rows) == df.count()
    source, sizes = {}, Counter()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in df.collect():
        sizes[r["source"]] += words(r["text"])
        source[r["doc_id"]] = r["source"]
    target = plain_targets(sizes)
    by = defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    named = [r for r in rows if r["doc_id"] is not None]
    for r in named:
        assert math.isclose(r["target"], target[source[r["doc_id"]]], rel_tol=1e-9) and r["source_size"] == sizes[source[r["doc_id"]]]
    for r in named:
        by[source[r["doc_id"]]] += r["taken"]
    if which == "small":
        for s, n in by.items():
            assert abs(n - target[s]) <= max(0.05 * target[s], max(r["size"] for r in named if source[r["doc_id"]] == s) / 2)
    again = mixing.taken_words(df).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mix_returns_whole_rows(small):
    taken = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.taken_words(small).collect()}
    got = Counter(r["doc_id"] for r in mixing.mix(small).collect())
    assert {d: n for d, n in taken.items() if n} == dict(got)


def test_shards_of_the_tree(small):
    """Many shards: each gets its part of every source's blocks, no document is dropped or taken more often for it, and mix() deals by it."""
    rows = mixing.taken_words(small, shard_words=8000).collect()
    plain = {r["doc_id"]: r["taken"] for r in mixing.taken_words(small, shard_words=8000).collect()}
    words = Counter()
    for r in rows:
        copies = [int(x) for x in r["shards"].split(",") if x]
        assert len(copies) * r["size"] == r["taken"] == plain[r["doc_id"]]
        for x in copies:
            words[x] += r["size"]
    shards = -(-sum(r["size"] for r in rows) // 8000)
    assert shards > 4 and max(words) < shards and len(words) > shards * 0.8
    got = Counter(r["doc_id"] for r in mixing.mix(small, shard_words=8000).collect())
    assert dict(got) == {r["doc_id"]: len(r["shards"].split(",")) for r in rows if r["shards"]}


def test_quotas_split_exactly(spark):
    quotas = spark.createDataFrame([(0, 17), (1, 250), (2, 1), (3, 90)], "sidx int, quota long")
    rows = mixing.split_quotas(quotas, 7).collect()
    by_source, by_shard = Counter(), Counter()
    for r in rows:
        by_source[r["sidx"]] += r["quota"]
        by_shard[r["shard"]] += r["quota"]
    assert dict(by_source) == {0: 17, 1: 250, 2: 1, 3: 90}
    assert sum(by_shard.values()) == 358 and max(by_shard.values()) - min(by_shard.values()) <= 1


@pytest.mark.parametrize(("k", "n", "d"), [(5, 20, 8), (40, 100, 30), (0, 5, 3), (7, 7, 3), (1, 1, 0)])
def test_hypergeometric(spark, k, n, d):
    long = lambda x: F.lit(x).cast("long")
    draws = spark.range(5000).select(mixing.hypergeometric(long(k), long(n), long(d), (F.col("id") + 0.5) / 5000).alias("x")).groupBy("x").count().collect()
    for r in draws:
        assert abs(r["count"] / 5000 - math.comb(k, r["x"]) * math.comb(n - k, d - r["x"]) / math.comb(n, d)) < 1e-3


# packing


def test_ids_are_the_librarys():
    odd = ["", " ", "  ", "\n\n a", "a  b", "a \n b\n", "it's don't 's ''s !'s x'll", None, " lead", "trail  ", "\t\ttab x", "ª²½ 12a3 　x y", "😀😀 a\r\n\r\nb", "a'b'", "<|endoftext|> x", "a <|endoftext|> b", "it's<|endoftext|><|endoftext|>  \n", "<|endoftext| >", "x​y \x85 z", "a" * 3000, "\u08b6\u1c89x \u0378a", "\U0001f9e0\u9fff z"]
    ids, bounds = bpe.encoder(PATH).encode(odd)
    t = library()
    for i, text in enumerate(odd):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == t.encode(text or "", add_special_tokens=False).ids


def thue_morse(a: str, b: str, n: int) -> str:
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_of_one_polynomial_hash():
    """Every polynomial hash modulo 2 ** 64 takes such a word and its complement for one."""
    words = [thue_morse("a", "b", 2048), thue_morse("b", "a", 2048)]
    ids, bounds = bpe.encoder(PATH).encode(words)
    for i, w in enumerate(words):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library().encode(w, add_special_tokens=False).ids
    (sets,) = minhash.shingle_sets([f"{w} c d e f" for w in words])
    assert sets[0].tolist() != sets[1].tolist()


def test_pieces_of_one_hash(monkeypatch):
    """Where all pieces had one hash, ids would still be the library's."""
    monkeypatch.setattr(bpe.tv, "word_hashes", lambda cp, s, e: np.full(len(s), 7, np.uint64))
    texts = ["one two", "one", "two one", None, "three"]
    ids, bounds = bpe.TextIds(PATH).encode(texts)
    assert [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(5)] == [library().encode(t or "", add_special_tokens=False).ids for t in texts]


def test_ids_of_whole_documents_are_the_librarys(spark):
    texts = [r["text"] for r in table(spark, "/root/testdata/sf0.1", "documents").where("doc_id % 10 = 3").select("text").collect()]
    ids, bounds = bpe.encoder(PATH).encode(texts)
    want = library().encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert all(ids[bounds[i] : bounds[i + 1]].tolist() == e.ids for i, e in enumerate(want))


def test_alike_pieces_spread(spark):
    df = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    got = packing.pack(df, PATH)
    assert got.select("sequence_id", "offset").distinct().count() == 30_000 and got.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024
    assert got.select("sequence_id").distinct().count() == -(-30_000 // 1024)


def test_packing(docs):
    got = packing.pack(docs, PATH, keep_ids=True).collect()
    texts, t = defaultdict(list), library()
    for r in docs.collect():
        texts[r["doc_id"]].append([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2])
    sequences, parts = defaultdict(list), Counter()
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        own = next(x for x in texts[r["doc_id"]] if x[r["start"] : r["start"] + r["length"]] == r["ids"])
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and r["length"] <= 1024
        assert r["piece"] == 0 or (r["length"] == 1024 and r["start"] == len(own) - 1024 * (math.ceil(len(own) / 1024) - r["piece"]))
        parts[r["doc_id"]] += r["length"]
    assert parts == {d: sum(map(len, x)) for d, x in texts.items()}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    bound = -(-sum(parts.values()) // 1024)
    assert len(sequences) <= bound + 3


def test_pattern_plans_pack_everything():
    rng = np.random.default_rng(2)
    for n in (1, 7, 500, 20_000):
        lengths = np.where(rng.random(n) < 0.3, rng.integers(1, 50, n), rng.integers(1, 129, n))
        h = np.bincount(lengths, minlength=129)
        plan, used = packing.plan_patterns(h, 128), np.zeros(129, int)
        for pattern, times in plan:
            assert sum(pattern) <= 128
            for x in pattern:
                used[x] += times
        assert (used == h).all()
        assert sum(k for _, k in plan) <= max(-(-int(lengths.sum()) // 128) * 1.02 + 1, sum(k for _, k in packing.best_fit(h, 128)) + 1)


# personal data


def plain_spans(text):
    out = []
    out += [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


ODD = [
    "a@b.c_x@y.z @q 1.2.3.4.5 999.1.1.1 0001.002.3.4", "+1 (487) 555-7209 x@y.z, x@y.z é😀 a@b.co 4111 1111 1111 1111 +123", "4111-1111-1111-1111 1.2.3.4 a.b@c@d.e.f..g",
    "1" * 40 + " " + "x" * 3000 + "@", "300.2.3.4 1.2.3.400 12..3.4.5 1.2.3.4@x.y", "", "call +49 30 1234567 89, +1.2.3.4.5.6.7.8.9.0", "4111111111111111 4111111111111112 00000000000000",
]


def test_patterns(spark, docs, small):
    odd = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for df in (odd, small, docs):
        want = Counter()
        for r in df.collect():
            spans = plain_spans(r["text"] or "")
            n = Counter(k for _, _, k, _ in spans)
            digest = hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, k, e in spans).encode()).hexdigest()
            want[(r["doc_id"], n["email"], n["ip"], n["card"], n["phone"], digest)] += 1
        got = pii.report(df).collect()
        assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want


def test_disclosing_terms(spark):
    rows = [(i, f"common words here {'zyxwv lives' if i < 3 else 'nobody lives'} near{i} {'q@r.st' if i < 3 else 'by the sea'} common end{i}") for i in range(40)]
    found = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("removed:18:23" in found[i] and found[i].count(",") == 1 for i in range(3)) and all(found[i] == "" for i in range(3, 40))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "zyxwv" not in clean[0] and "[EMAIL]" in clean[0] and clean[5] == rows[5][1]


def long_texts():
    """Runs that a pattern engine must not recurse over and texts of very many matches, each with its spans."""
    return [
        ("1" * 10**6, []), ("1 " * 10**6, []), ("4-" * 10**5 + "x", []), ("a@b" + ".c" * 10**6, [("email", 0, 2 * 10**6 + 3)]), ("+1" + " 2" * 10**5, []),
        ("1." * 10**5, [("ip", 8 * k, 8 * k + 7) for k in range(25_000)]), ("x" * 10**6 + "@", []), ("+" * 10**5, []), ("a@b.c " * 30_000, [("email", 6 * k, 6 * k + 5) for k in range(30_000)]),
        ("😀é" * 50_000 + " 10.0.0.1", [("ip", 100_001, 100_009)]), ("mail a@b.c " + "word " * 40_000 + "4111 1111 1111 1111", [("email", 5, 10), ("card", 200_011, 200_030)]),
    ]


def test_long_texts_of_personal_data(spark):
    texts = long_texts()
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string").repartition(4)
    for r in pii.report(df).collect():
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{e}" for k, a, e in texts[r["doc_id"]][1]).encode()).hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean[8] == "[EMAIL] " * 30_000 and clean[9] == "😀é" * 50_000 + " [IP]" and clean[0] == texts[0][0]
    assert clean[10] == "mail [EMAIL] " + "word " * 40_000 + "[CARD]"


def plain_disclosing(texts):
    """For each text its spans by the measure, from the definition: entities, terms outside base spans, counts of documents."""
    entities, terms, outside = [], [], []
    for t in texts:
        base = plain_spans(t)
        masked = list(t)
        for a, _, _, e in base:
            masked[a:e] = " " * (e - a)
        outside.append("".join(masked))
        entities.append({f"{k}:{t[a:e]}" for a, _, k, e in base})
        terms.append({w.lower() for w in re.findall(r"[^\W_]+", t) if len(w) >= 3})
    own = [{w.lower() for w in re.findall(r"[^\W_]+", t) if len(w) >= 3} for t in outside]
    n_term, n_entity, both = Counter(w for t in terms for w in t), Counter(e for x in entities for e in x), defaultdict(list)
    for i, x in enumerate(entities):
        for e in x:
            for w in own[i]:
                both[e, w].append(i)
    told = {}
    for (e, w), rows in both.items():
        if len({texts[i] for i in rows}) > 1 and n_entity[e] < len(texts):
            information = -math.log(n_entity[e] / len(texts))
            told[e, w] = (math.log(len(rows) / n_term[w]) + information) / information
    out = []
    for i, t in enumerate(texts):
        spans = plain_spans(t)
        for m in re.finditer(r"[^\W_]+", outside[i]):
            most = max((told.get((e, m.group().lower()), 0) for e in entities[i]), default=0)
            if most >= pii.GENERALISE:
                spans.append((m.start(), 4, "removed" if most >= pii.REMOVE else "term", m.end()))
        out.append(",".join(f"{k}:{a}:{e}" for a, _, k, e in sorted(spans)))
    return out


def test_disclosure_against_the_plain_measure(spark):
    import random

    rng = random.Random(12)
    texts = []
    for i in range(300):
        words = [f"w{min(rng.randrange(1, 400), rng.randrange(1, 400))}" for _ in range(rng.randrange(5, 60))]
        for e in rng.sample(range(12), rng.choice([0, 0, 0, 1, 1, 2, 3])):
            words.insert(rng.randrange(len(words)), (f"who{e}@site.org", f"+1 555 010 0{e:03d}", f"10.0.0.{e}")[e % 3])
            words += [f"Clue{e}"] * (rng.random() < 0.9) + [f"place{e}"] * (rng.random() < 0.9)
        words += [f"place{rng.randrange(12)}"] * (rng.random() < 0.1)
        texts.append(" ".join(words))
    texts += texts[:20] + ["", "alone@x.y with words"]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = plain_disclosing(texts)
    assert [got[i] for i in range(len(texts))] == want and sum("term:" in s for s in want) > 5 and sum("removed:" in s for s in want) > 5


def test_sanitise_keeps_rows(docs):
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    row = out.where("doc_id = 12").first()
    assert row["text"] == "mail [EMAIL] or [EMAIL]" and row["n_chars"] == len(row["text"])


# language and toxicity


def test_language(docs, small):
    assert [r["lang_pred"] for r in langid.identify(docs).where("doc_id IN (4, 5, 6)").collect()] == ["und"] * 3
    got = langid.identify(small).cache()
    assert got.where("score < 0 OR score > 1 OR lang_pred IS NULL").count() == 0 and got.count() == small.count()
    assert min(langid.accuracy(got, small).values()) > 0.9
    held = {r["doc_id"]: r["held_out"] for r in got.collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in held.items())


def plain_votes(model, text):
    """The language by the vote written out: each pair of families, then each pair of languages of the best family."""
    row = langid.vectors([text])[0][0].astype(float)
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0

    def best(pairs, n):
        votes, sure = [0.0] * n, [1.0] * n
        for (i, j), w in pairs.items():
            p = 1 / (1 + math.exp(-4 * (float(row @ w[:-1]) + float(w[-1]))))
            votes[i if p > 0.5 else j] += 1
            votes[i] += 1e-3 * p
            votes[j] += 1e-3 * (1 - p)
            sure[i], sure[j] = min(sure[i], p), min(sure[j], 1 - p)
        k = max(range(n), key=lambda i: votes[i])
        return k, sure[k]

    f, p = best(model.top, len(model.families))
    f = model.families[f]
    k, q = best(model.within[f], len(model.members[f]))
    return model.members[f][k], p * q


def test_language_against_the_plain_vote(spark, small):
    odd = small.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-1, "the words " * 20_000, "en"), (-2, "the words " * 20_000, "en"), (-3, "\U00030000\U00030001", None), (-4, "12 34", "en"), (-5, None, None)], "doc_id long, text string, lang string"))
    model = langid.fit(odd)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd).collect()}
    for r in odd.collect():
        lang, score = plain_votes(model, r["text"])
        if r["doc_id"] >= 0:
            assert got[r["doc_id"]][0] == lang and abs(got[r["doc_id"]][1] - score) < 1e-4
    assert got[-1] == got[-2] and got[-1][0] != "und" and got[-3][0] != "und" and got[-4] == got[-5] == ("und", 0.0)


def test_many_languages(spark):
    """Every language with a label can be predicted, however many there are."""
    import random

    rng, rows = random.Random(5), []
    for k in range(90):
        letters = [chr(0x4E00 + 7 * k + j) for j in range(7)] if k % 2 else ["".join(rng.choice("abcdefghijklmnop") for _ in range(3)) for _ in range(12)]
        rows += [(k * 100 + i, " ".join("".join(rng.choice(letters) for _ in range(3)) for _ in range(30)), f"l{k:02d}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df)
    right = langid.accuracy(got, df)
    assert len(right) == 90 and sum(right.values()) > 85


def test_learning_ignores_held_out(docs, small):
    spoiled = small.withColumn("lang", F.when(learning.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert langid.identify(spoiled).where("lang_pred = 'xx'").count() == 0


def test_toxicity(spark, docs, sf):
    bad, good = ["vile", "scum", "rotten"], ["fine", "group", "people"]
    import random

    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        words = [edge.sentence(rng, 1) for _ in range(30)] + rng.sample(bad if toxic else good, 2)
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    both = toxicity.scores(df, lab).join(lab, "doc_id").where("held_out")
    assert both.where("toxic <> predicted").count() <= 0.02 * both.count()
    odd = toxicity.scores(docs, lab.where("doc_id < 30"))
    assert odd.count() == docs.count() and odd.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    flat = toxicity.scores(docs, lab.limit(0))
    assert flat.agg(F.max("score")).first()[0] < 0.01


def test_scores_against_the_plain_sum(spark, small, sf):
    """bias, weights, and the factors of every pair of different terms, written out."""
    labels = table(spark, sf, "labels")
    model = toxicity.fit(small.select("doc_id", "text"), labels)
    place = {b: i for i, b in enumerate(model.kept.tolist())}
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(small, labels).collect()}
    for r in small.select("doc_id", "text").limit(40).collect():
        rows = sorted({place[b] for b in toxicity.terms([r["text"]])[0].tolist() if b in place})
        margin = model.bias + sum(float(model.weight[i]) for i in rows)
        margin += sum(float(model.factors[i].astype(float) @ model.factors[j]) for at, i in enumerate(rows) for j in rows[:at])
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-margin))) < 1e-4
    assert got and toxicity.scores(spark.createDataFrame([(1, "x y " * 200_000), (1, "x y " * 200_000)], "doc_id long, text string"), labels).select("score").distinct().count() == 1


def test_both_or_neither():
    """Two terms that say nothing each, and all together: harmful are texts with both or neither. Held against fresh texts."""
    rng = np.random.default_rng(4)

    def texts(n):
        index, bounds, label = [], [0], []
        for _ in range(n):
            a, b = rng.random(2) < 0.5
            index += sorted({*rng.integers(10, 2000, 30).tolist(), *([1] if a else []), *([2] if b else [])})
            bounds.append(len(index))
            label.append(int(a == b))
        return np.array(index), np.array(bounds), np.array(label)

    m = toxicity.fit_machine(*texts(3000), 0.5)
    place = np.full(2000, -1)
    place[m.kept] = np.arange(len(m.kept))
    index, bounds, label = texts(1000)
    assert ((m.margin(place[index], bounds) > 0) == label).mean() > 0.98


def test_pairs_count_together():
    """Two terms that are harmless alone and harmful together."""
    rng = np.random.default_rng(1)
    index, bounds, label = [], [0], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        row = sorted({*rng.integers(10, 200, 3).tolist(), *([1] if a else []), *([2] if b else [])})
        index += row
        bounds.append(len(index))
        label.append(int(a and b))
    index, bounds, label = np.array(index), np.array(bounds), np.array(label)
    m = toxicity.fit_machine(index, bounds, label, float(label.mean()))
    place = {k: i for i, k in enumerate(m.kept.tolist())}
    score = lambda *t: m.margin(np.array([place[x] for x in t]), np.array([0, len(t)]))[0]
    assert score(1, 2) > 1 and score(1) < -1 and score(2) < -1


def test_pairs_of_terms_common_in_both_labels():
    """Two terms that are as frequent in clean texts as in harmful ones, and harmful together."""
    rng = np.random.default_rng(1)
    index, bounds, label = [], [0], []
    for i in range(3000):
        y, first = int(i % 10 < 3), rng.random() < 0.5
        words = ([1, 2] if first else [3]) if y else ([1] if first else [2])
        index += sorted({*rng.integers(10, 2000, 30).tolist(), *words})
        bounds.append(len(index))
        label.append(y)
    m = toxicity.fit_machine(np.array(index), np.array(bounds), np.array(label), 0.3)
    place = {k: i for i, k in enumerate(m.kept.tolist())}
    score = lambda *t: m.margin(np.array([place[x] for x in t]), np.array([0, len(t)]))[0]
    assert score(1, 2) > 1 and score(3) > 1 and score(1) < -1 and score(2) < -1
