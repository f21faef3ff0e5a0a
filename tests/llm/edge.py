"""Small tables with every odd case: nulls, empty and very long texts, repeated rows and ids, columns with clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, words string, bucket string, fp string, rank int, shard long, score double, spans string, base string"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows() -> list[tuple]:
    rng = random.Random(4)
    base = sentence(rng, 120)
    near = base.split()
    near[5] = "changed"
    far = base.split()
    far[::9] = ["other"] * len(far[::9])
    texts: list[tuple] = [
        (0, base, "en", "a"), (1, base, "en", "a"), (2, " ".join(near), "en", "b"), (3, " ".join(far), "fr", None),
        (4, None, "en", "a"), (5, "", None, "b"), (6, " \t\n ", "de", "b"), (7, "one two", "en", None), (8, "one two", "en", "a"),
        (9, "ONE  two", "en", "c"), (10, sentence(rng, 30_000), "de", "c"), (11, "x" * 50_000, "en", "c"), (0, base, "en", "a"),
        (12, "mail a.b@c.de or a.b@c.de", "en", "a"), (None, base, None, None), (None, None, None, None), (13, "é" * 40 + " 😀 \x85 word", "fr", "b"),
    ]
    texts += [(20 + i, sentence(rng, rng.randint(1, 400)), rng.choice(["en", "fr"]), rng.choice(["a", "b", "c"])) for i in range(60)]
    return [(d, t, lang, s, len(t) if t is not None else None, 7, "w", "b", "f", 1, 2, 0.5, "s", "b") for d, t, lang, s in texts]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def oddly_named(spark):
    """documents with columns that are named as the operators name theirs, or with dots and blanks."""
    odd = ("tox_score", "row_", "held_out", "predicted", "a.b", "two words", "base`d", "rid", "class", "key_", "block", "draws", "place_")
    return documents(spark).selectExpr("*", *[f"{i} AS `{n.replace('`', '``')}`" for i, n in enumerate(odd)])
