"""Personal data: patterns find it, and corpus co-occurrence finds the terms that would still reveal it. DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. A match's place comes from splitting the
text by the same pattern: pieces and matches alternate. A run of characters that can't match is passed over at once, and
repeated groups are possessive, so neither time nor the pattern engine's stack grows beyond the text's length. Folds over
matches go in chunks, so a text of very many matches isn't copied for each.

Their values are the protected entities. A term reveals an entity as far as knowing the term removes doubt about the
entity: the pointwise mutual information log(p(e, t) / (p(e) p(t))) in parts of the entity's information content
-log p(e), all probabilities from document counts over the whole corpus. All terms of the whole documents that hold the
entity are judged, outside base spans, if at least two different texts hold both, as one text alone says nothing about
co-occurrence. In the documents that hold the entity, terms that disclose REMOVE of it or more are removed, those from
GENERALISE on are replaced by their kind. Documents without an entity are never changed.

Entities of exactly the same documents have the same counts with every term, so they are counted as one; a document that
lists many entities then adds its terms once for each different set of documents, not for each entity.

Defined results: a null text is empty. Copies of a text are documents, but one text. Repeated rows get the same spans. An
empty table gives no rows. Other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import materialize, named

KINDS = ("email", "ip", "card", "phone")
#: A run that may begin a match, and the rest of the match if it is one.
EMAIL = r"[A-Za-z0-9._%+-]++(?:@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?"
IP = r"[0-9]++(?:(?:\.[0-9]++){3})?"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}\p{N}]+"
#: Least letters of a term.
LEAST_LENGTH = 3
GENERALISE, REMOVE = 0.85, 0.95
#: A list of so many terms at most is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 500_000
SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"
#: Items that one fold goes over, and characters of a text that are cut from at once.
CHUNK, BLOCK = 256, 4096


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed, and written in the plan, once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The arrays that step yields over the items, joined. step(state, item) gives the next state and an array of the kind; folds run over chunks, so that what is already there is seldom copied."""
    none = F.array().cast(kind)

    def over(some: Column, begin: Column) -> Column:
        def one(s: Column, x: Column) -> Column:
            return let(s["state"], lambda at: F.struct(step(at, x)[0].alias("state"), F.concat(s["out"], step(at, x)[1]).alias("out")))

        return F.aggregate(some, F.struct(begin.alias("state"), none.alias("out")), one)

    def chunk(xs: Column) -> Callable[[Column, Column], Column]:
        def one(s: Column, i: Column) -> Column:
            got = over(F.slice(xs, i * CHUNK + 1, F.lit(CHUNK)), s["state"])
            return let(got, lambda g: F.struct(g["state"].alias("state"), F.concat(s["out"], F.array(g["out"])).alias("out")))

        return one

    def whole(xs: Column) -> Column:
        begin = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        many = F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), begin, chunk(xs), lambda s: s["out"]))
        return F.when(F.size(xs) > CHUNK, many).otherwise(over(xs, state)["out"])

    return let(items, whole)


def matches(text: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """array of (start, end, value) of a pattern's valid matches, in code points."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    kind = "array<struct<start:int,end:int,value:string>>"

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + F.length(x["p"])
        end = begin + F.length(x["m"])
        found = F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("value")))
        return F.coalesce(end, begin), F.when(valid(x["m"]), found).otherwise(F.array().cast(kind))

    return scan(both, F.lit(0), kind, step)


def _luhn(digits: Column) -> Column:
    back = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") < 5, d.cast("int") * 2).otherwise(d.cast("int") * 2 - 9)))
    return F.aggregate(back, F.lit(0), lambda a, d: a + d) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, v: Column) -> Column:
    if kind == "email":
        return F.contains(v, F.lit("@"))
    if kind == "ip":
        # digits are compared as text, so that long ones can't overflow
        short = F.transform(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.contains(v, F.lit(".")) & F.forall(short, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    n = F.length(_digits(v))
    return F.when(F.length(v) >= 10, (n >= 14) & (n <= 19) & _luhn(F.substring(_digits(v), 1, 19)) if kind == "card" else (n >= 10) & (n <= 15)).otherwise(False)


#: What a text must hold for a kind's pattern to be worth running.
HINTS = {"email": ("contains", "@"), "ip": ("rlike", r"[0-9]\.[0-9]+\.[0-9]"), "card": ("rlike", r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": ("rlike", r"\+[0-9]")}


def _of_kind(text: Column, rank: int, kind: str, pattern: str) -> Column:
    how, what = HINTS[kind]
    hint = F.contains(text, F.lit(what)) if how == "contains" else text.rlike(what)
    own = matches(text, pattern, lambda v: _valid(kind, v))
    named = F.transform(own, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))
    return F.when(hint, named).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """All base spans (start, rank of kind, kind, end, value) in the order of start, then kind."""
    return F.array_sort(F.concat(*[_of_kind(text, i, k, p) for i, (k, p) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))]))


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _part(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from start to end of a text in blocks: only the first and the last block are cut."""
    i, j = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    first, last = F.element_at(blocks, i + 1), F.element_at(blocks, j + 1)
    inside = F.substring(first, start % BLOCK + 1, end - start)
    across = F.concat(F.substring(first, start % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(last, F.lit(1), (end - 1) % BLOCK + 1))
    return F.when(end <= start, "").when(i == j, inside).otherwise(across)


def spliced(text: Column, spans: Column, put: Callable[[Column, Column], Column]) -> Column:
    """The text with its spans replaced: put(span, characters of it that no earlier span covers). A span that begins within an earlier one gets an empty replacement beyond those characters' own."""

    def whole(blocks: Column, size: Column) -> Column:
        def step(at: Column, x: Column) -> tuple[Column, Column]:
            return F.greatest(at, x["end"]), F.array(_part(blocks, at, F.greatest(at, x["start"])), put(x, F.struct(at.alias("at"), F.greatest(F.lit(0), x["end"] - F.greatest(at, x["start"])).alias("fresh"))))

        last = F.greatest(F.lit(0), F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0)))
        return F.concat(F.array_join(scan(spans, F.lit(0), "array<string>", step), ""), let(last, lambda a: _part(blocks, a, size)))

    in_blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}+"), F.lit(0))
    return let(in_blocks, lambda b: let(F.length(text), lambda n: whole(b, n)))


def _masked(text: Column, spans: Column) -> Column:
    """The text with its spans blanked out, of the same length."""
    return spliced(text, spans, lambda x, s: F.repeat(F.lit(" "), s["fresh"]))


def terms_of(text: Column) -> Column:
    """The distinct lower-cased terms of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= LEAST_LENGTH))


def disclosures(held: DataFrame, holders: DataFrame, docs: DataFrame) -> DataFrame:
    """(class, term, disclosed): the part of an entity's information content that a term gives away.

    held has (rid, copy, text), the documents with an entity and their text outside base spans; holders (rid, class), which
    entities of different sets of documents each has; docs (text), all documents.
    """
    n = float(max(docs.count(), 1))
    information = -F.log(F.col("n_entity") / F.lit(n))
    told = lambda n_term: F.when(information > 0, (F.log(F.col("n_both") / F.col(n_term)) + information) / information).otherwise(F.lit(0.0))
    n_entities = holders.groupBy("class").agg(F.count("*").alias("n_entity"))
    words = held.select("rid", "copy", F.explode(terms_of(F.col("text"))).alias("term"))
    n_held = words.groupBy("term").agg(F.count("*").alias("n_held"))
    pairs = words.join(holders, "rid").groupBy("class", "term").agg(F.count("*").alias("n_both"), F.min("copy").alias("a"), F.max("copy").alias("b")).where("a <> b").drop("a", "b")
    # A term is in at least as many documents as hold it and an entity, so a pair that fails by that count fails anyway.
    pairs = materialize(pairs.join(n_held, "term").join(n_entities, "class").where(told("n_held") >= GENERALISE - 1e-9), "pii-pairs")
    terms = pairs.select("term").distinct()
    if terms.count() <= BROADCAST_ROWS:
        terms = F.broadcast(terms)
    every = docs.select(F.explode(terms_of(F.col("text"))).alias("term"))
    n_terms = every.join(terms, "term").groupBy("term").agg(F.count("*").alias("n_term"))
    return pairs.join(n_terms, "term").select("class", "term", told("n_term").alias("disclosed"))


def _flagged(masked: Column, flags: Column) -> Column:
    """Spans of the flagged terms (term, remove). The flags are dealt to buckets, so that each word is held against a few."""
    n = F.floor(F.size(flags) / 8).cast("int") + 1
    bucket = lambda x, of: F.pmod(F.xxhash64(x), of)

    def of_buckets(b: Column) -> Column:
        mine = lambda v: F.filter(F.element_at(b, bucket(F.lower(v), F.size(b)).cast("int") + 1), lambda f: f["term"] == F.lower(v))
        found = matches(masked, TERM, lambda v: F.size(mine(v)) > 0)
        kind = lambda v: F.when(F.element_at(mine(v), 1)["remove"], F.lit("removed")).otherwise(F.lit("term"))
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), kind(m["value"]).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))

    buckets = let(n, lambda k: F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.filter(flags, lambda f: bucket(f["term"], k) == i)))
    return let(buckets, of_buckets)


def entity_classes(each: DataFrame) -> DataFrame:
    """(rid, class) from (rid, copy, entity): entities of the same documents are one class; those of one text only are left out."""
    sets = each.groupBy("entity").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rid")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "rid")).alias("g"), F.min("copy").alias("a"), F.max("copy").alias("b"))
    live = sets.where("a <> b").select("entity", F.xxhash64("n", "h", "g").alias("class"))
    return each.join(live, "entity").select("rid", "class").distinct()


def find(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """(row_, base, spans) for every row of docs: its own columns as a struct, and arrays of (start, rank, kind, end, value), the patterns' spans and those with the method's. Without keep_text the struct has no text."""
    own = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[named(c) for c in own if keep_text or c != "text"]).alias("row_"), text.alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    if not keep_text:
        rows = rows.withColumn("text", F.when(F.size("base") > 0, F.col("text")))
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "pii-base")

    holders = rows.where(F.size("base") > 0)
    entities = F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["value"])))
    classes = materialize(entity_classes(holders.select("rid", F.xxhash64("text").alias("copy"), F.explode(entities).alias("entity"))), "pii-classes")
    held = holders.join(classes.select("rid").distinct(), "rid", "left_semi").select("rid", F.xxhash64("text").alias("copy"), _masked(F.col("text"), F.col("base")).alias("text"))
    held = materialize(held, "pii-held")
    told = disclosures(held, classes, docs.select(text.alias("text"))).where(F.col("disclosed") >= GENERALISE)
    judged = held.select("rid", F.explode(terms_of(F.col("text"))).alias("term")).join(classes, "rid").join(told, ["class", "term"])
    flagged = judged.groupBy("rid", "term").agg((F.max("disclosed") >= REMOVE).alias("remove"))
    flags = flagged.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("term", "remove"))).alias("flags"))

    marked = holders.join(flags, "rid", "left")
    extra = F.when(F.col("flags").isNotNull(), _flagged(_masked(F.col("text"), F.col("base")), F.col("flags"))).otherwise(F.array().cast(SPAN))
    marked = marked.select("row_", "base", F.array_sort(F.concat("base", extra)).alias("spans"))
    plain = rows.where(F.size("base") == 0).select("row_", "base", F.col("base").alias("spans"))
    return plain.unionByName(marked)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs (doc_id, text)."""
    found = find(docs.select("doc_id", "text"), keep_text=False)
    counts = [_count(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return found.select("row_.doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with base spans and generalised terms replaced by their kind, and removed terms left out."""
    token = lambda x: F.when(x["kind"] == "removed", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
    return spliced(text, spans, lambda x, s: F.when(x["start"] < s["at"], F.lit("")).otherwise(token(x)))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, n_chars, ...) with redacted texts; a text without spans, null included, stays as it is."""
    found = find(docs)
    changed, old = F.size("spans") > 0, F.col("row_.text")
    new = {"text": F.when(changed, redact(old, F.col("spans"))).otherwise(old)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(new["text"]).cast("long")).otherwise(F.col("row_.n_chars"))
    return found.select(*[new.get(c, F.col("row_").getField(c)).alias(c) for c in docs.columns])
