"""Bibliographic fields by rules, lists and records out of loose strings, answers of models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.texts import strip

#: Values that stand for none; fixed values.
NOTHING = ("null", "none", "n/a")
#: Line beginnings and parts that no title has, marks of journal heads; fixed values.
NO_TITLE_START = ("Abstract", "Keywords", "1.", "I.")
HEAD_MARKS = ("|", "—", "°", "page", "pp.", "vol.", "no.", "issn", "isbn", "©", "copyright")
NO_TITLE_PARTS = ("abstract", "keywords", "author", "email", "@", "department", "university")
NO_TITLE_SIGNS = ("|", "—", "°", "©")
#: What an address looks like; a fixed value.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
#: Quality words of a model's answer in the order in which they are tried, and the score of each; fixed values.
QUALITY_WORDS = (
    ("excellent", 85, ("excellent", "very good", "high quality")),
    ("good", 70, ("good", "clear", "readable")),
    ("fair", 55, ("fair", "okay", "moderate")),
    ("poor", 30, ("poor", "bad", "low quality", "blurry")),
)
ISSUE_WORDS = (("blurry_text", ("blur",)), ("image_noise", ("noise",)), ("low_contrast", ("dark", "low contrast")), ("text_skew", ("skew", "rotated")))


def _any_in(text: Column, parts: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.contains(text, F.lit(p))
    return hit


def found(c: Column) -> Column:
    """A regular expression's result, null where it is empty."""
    return F.nullif(c, F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines(text: Column, n: int = 50) -> Column:
    return F.slice(F.split(text, "\n", -1), 1, n)


def first_title(text: Column) -> Column:
    """The first of the first 50 lines with more than 20 characters that begins like no heading."""
    ok = lambda t: (F.length(t) > 20) & ~t.rlike("^(" + "|".join(w.replace(".", r"\.") for w in NO_TITLE_START) + ")")
    return F.get(F.filter(F.transform(lines(text), strip), ok), F.lit(0))


def title_after_head(text: Column) -> Column:
    """The title after a journal's head lines, with the next line where that goes on in small letters.

    The head ends before the first of 15 lines that has no mark of a head and is longer than 20 characters; lines with
    marks before that are skipped.
    """
    return let(F.transform(lines(text), strip), lambda every: let(_head_end(every), lambda head: _title_from(every, head)))


def _head_end(every: Column) -> Column:
    """The index of the last line of a journal's head, -1 without one."""
    numbered = F.transform(F.slice(every, 1, 15), lambda t, i: F.struct(i.alias("i"), _any_in(F.lower(t), HEAD_MARKS).alias("head"), (F.length(t) > 20).alias("long")))
    start = F.struct(F.lit(-1).alias("last"), F.lit(False).alias("stop"))
    step = lambda s, x: F.struct(F.when(x["head"] & ~s["stop"], x["i"]).otherwise(s["last"]).alias("last"), (s["stop"] | (~x["head"] & x["long"])).alias("stop"))
    return F.aggregate(numbered, start, step, lambda s: s["last"])


def _title_from(every: Column, head: Column) -> Column:
    ten = F.transform(F.slice(every, head + 2, 10), lambda t, k: F.struct(t.alias("t"), F.coalesce(F.get(every, head + 2 + k), F.lit("")).alias("next")))
    fits = lambda x: F.length(x["t"]).between(16, 249) & ~_any_in(F.lower(x["t"]), NO_TITLE_PARTS) & ~_any_in(x["t"], NO_TITLE_SIGNS) & (F.regexp_count(x["t"], F.lit(r"\S+")) >= 3)

    def whole(hit: Column) -> Column:
        both = F.concat(hit["t"], F.lit(" "), hit["next"])
        goes_on = (hit["next"] != "") & ~hit["next"].rlike(r"^\p{Lu}") & (F.length(both) < 250)
        return F.when(goes_on, both).otherwise(hit["t"])

    return let(F.get(F.filter(ten, fits), F.lit(0)), whole)


def authors(text: Column) -> Column:
    """At most five names after `author:`, `authors:`, `by` or `written by`, whatever its case, in the first 20 lines."""
    parts = F.transform(F.transform(lines(text, 20), strip), lambda t: F.regexp_extract(t, r"(?i)^.*?(?:authors?:|by )\s*(.*)$", 1))
    named = F.flatten(F.transform(F.filter(parts, lambda p: (p != "") & (F.length(p) < 100)), lambda p: F.split(p, ",")))
    return F.slice(F.filter(F.transform(named, strip), lambda n: n != ""), 1, 5)


def first_year(text: Column) -> Column:
    return found(F.regexp_extract(F.substring(text, 1, 2000), r"\b(20\d{2})\b", 1)).cast("int")


def latest_year(text: Column) -> Column:
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b(19\d\d|20[0-3]\d)\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.array_max(F.filter(years, lambda y: y.between(1980, 2030)))


def bare_doi(text: Column) -> Column:
    return found(F.regexp_extract(F.substring(text, 1, 2000), r"10\.\d{4,}/\S+", 0))


def marked_doi(text: Column) -> Column:
    return found(F.regexp_extract(text, r"(?i)doi:?\s*(10\.\d+/\S+)", 1))


def email(text: Column) -> Column:
    return found(F.regexp_extract(F.substring(text, 1, 3000), EMAIL, 0))


def abstract(text: Column) -> Column:
    """What follows the heading up to an empty line, keywords, a first number or the introduction, if longer than 50 characters; cut at 500."""
    body = strip(F.regexp_extract(text, r"(?is)Abstract[:\s]+(.+?)(?:\n\n|Keywords|1\.|Introduction)", 1))
    return F.when(F.length(body) > 50, F.substring(body, 1, 500))


def set_abstract(text: Column) -> Column:
    """The same for a heading on a line of its own, up to the line of a next heading, of 51 to 1999 characters; cut at 500."""
    body = strip(F.regexp_extract(text, r"(?is)abstract[:\s]*\n(.*?)\n\s*(?:keywords|introduction|\d+\.|references)", 1))
    return F.when(F.length(body).between(51, 1999), F.substring(body, 1, 500))


def something(c: Column) -> Column:
    """A string stripped; null where it says nothing."""
    t = strip(c)
    return F.when((t != "") & ~F.lower(t).isin(*NOTHING), t)


def valid_year(c: Column) -> Column:
    y = F.try_to_number(c.cast("string"), F.lit("9999")).cast("int")
    return F.when(y.between(1900, 2030), y)


def valid_doi(c: Column) -> Column:
    return F.when(F.contains(something(c), F.lit("10.")), something(c))


def name_list(c: Column, separators: str = "[,;]|and") -> Column:
    """Names out of a JSON list or a separated string; the separator `and` also cuts inside words, as stored lists show."""
    t = something(c)
    parsed = F.when(t.rlike(r"(?s)^\[.*\]$"), F.from_json(t, "array<string>"))
    told = F.filter(F.transform(parsed, lambda n: strip(n)), lambda n: n.isNotNull() & (n != "") & ~F.lower(n).isin(*NOTHING))
    return F.coalesce(told, F.filter(F.transform(F.split(t, separators), strip), lambda n: n != ""))


def stored_list(c: Column) -> Column:
    """A stored list: JSON, else separated by commas; empty of nothing."""
    plain = F.filter(F.transform(F.split(c, ","), strip), lambda n: n != "")
    return F.coalesce(F.when(c.rlike(r"(?s)^\s*\[.*\]\s*$"), F.from_json(c, "array<string>")), plain, F.array().cast("array<string>"))


def labelled(text: Column, label: str) -> Column:
    """The value after the last line that begins with a label."""
    return found(strip(F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(rf"(?m)^\s*{label}:(.*)$"), F.lit(1))), -1)))


def json_part(answer: Column) -> Column:
    """From the first opening brace to the last closing one."""
    return found(F.regexp_extract(answer, r"(?s)\{.*\}", 0))


def quality_record(answer: Column) -> Column:
    """overall_quality, readability_score and confidence of a JSON answer, with what stands for missing ones; null without JSON."""
    r = F.from_json(json_part(answer), "overall_quality string, readability_score double, confidence double")
    default = lambda name, value: F.coalesce(r[name], F.lit(value)).alias(name)
    return F.when(json_part(answer).isNotNull(), F.struct(default("overall_quality", "unknown"), default("readability_score", 50.0), default("confidence", 50.0)))


def quality_from_words(answer: Column) -> Column:
    """The same from a free answer's words, the first kind that is named: quality, score, issues, artifacts and whether to scan anew."""
    t = F.lower(answer)
    quality, score = F.lit("fair"), F.lit(50)
    for name, points, parts in reversed(QUALITY_WORDS):
        quality, score = F.when(_any_in(t, parts), name).otherwise(quality), F.when(_any_in(t, parts), points).otherwise(score)
    issues = F.array_compact(F.array(*[F.when(_any_in(t, parts), name) for name, parts in ISSUE_WORDS]))
    return F.struct(quality.alias("quality"), score.alias("score"), issues.alias("issues"), F.when(F.size(issues) > 0, "moderate").otherwise("minimal").alias("artifacts"), (score < 60).alias("rescan"))


def prompt_text(text: Column, marked: int = 5000, plain: int = 4000) -> Column:
    """The part of a text that a model is shown: more of one with size marks."""
    return F.when(F.contains(text, F.lit("[FONT_SIZE:")), F.substring(text, 1, marked)).otherwise(F.substring(text, 1, plain))


def summary(title: Column, names: Column, year: Column) -> Column:
    """One line about a record: the title, cut at 60 characters, the first author and the year."""
    short = F.when(F.length(title) > 60, F.concat(F.substring(title, 1, 57), F.lit("..."))).otherwise(title)
    who = F.when(F.size(names) > 1, F.concat(F.get(names, F.lit(0)), F.lit(" et al."))).otherwise(F.get(names, F.lit(0)))
    return F.concat_ws(" | ", short, who, year.cast("string"))


def record(text: Column) -> Column:
    """All fields by rules, the head-aware rules first; a short text has none."""
    long = F.length(strip(text)) > 100
    fields = {"title": F.coalesce(title_after_head(text), first_title(text)), "authors": authors(text), "year": F.coalesce(latest_year(text), first_year(text)), "doi": F.coalesce(marked_doi(text), bare_doi(text)), "email": email(text), "abstract": F.coalesce(set_abstract(text), abstract(text))}
    return F.when(long, F.struct(*[c.alias(n) for n, c in fields.items()]))


#: Placeholders of the plain prompt, which a model may give back; fixed values.
PLACEHOLDERS = {
    "Title": "[exact title]", "Authors": "[author names separated by semicolons]", "Journal": "[journal/conference name]",
    "Abstract": "[first sentence of abstract if found]",
}
#: Fields of a record with their types; lists are empty and the year is 0 where they aren't known.
RECORD = {
    "title": "string", "authors": "array<string>", "journal": "string", "year": "int", "doi": "string", "abstract": "string", "keywords": "array<string>",
    "volume": "string", "issue": "string", "pages": "string", "publisher": "string", "institution": "string", "email": "string",
}


def record_of(**fields: Column) -> Column:
    """A record of these fields; the others hold what stands for none."""
    none = {"array<string>": F.array(), "int": F.lit(0)}
    value = lambda name, kind: F.coalesce(fields.get(name, F.lit(None)).cast(kind), none.get(kind, F.lit(None)).cast(kind))
    return F.struct(*[value(n, k).alias(n) for n, k in RECORD.items()])


def _typed(answer: Column, name: str) -> tuple[Column, Column]:
    """A field of a variant, and the name of its type."""
    v = F.try_variant_get(answer, f"$.{name}", "variant")
    return v, F.schema_of_variant(v)


def _text_field(answer: Column, name: str) -> Column:
    """A field that is a string and says something."""
    v, kind = _typed(answer, name)
    return something(F.when(kind == "STRING", F.try_variant_get(v, "$", "string")))


def _list_field(answer: Column, name: str, separators: str) -> Column:
    """Names out of a list, or out of a string that is one or is separated."""
    v, kind = _typed(answer, name)
    told = F.filter(F.transform(F.try_variant_get(v, "$", "array<string>"), lambda n: something(n)), lambda n: n.isNotNull())
    return F.when(kind.startswith("ARRAY"), told).when(kind == "STRING", name_list(F.try_variant_get(v, "$", "string"), separators))


def _year_field(answer: Column) -> Column:
    """A year from 1900 to 2030, as a number, cut, or as a string of digits."""
    v, kind = _typed(answer, "year")
    said = F.when(kind == "STRING", strip(F.try_variant_get(v, "$", "string")))
    y = F.when(said.isNull(), F.try_variant_get(v, "$", "double")).when(said.rlike(r"^[+-]?[0-9]{1,9}$"), said.try_cast("double")).try_cast("int")
    return F.when(y.between(1900, 2030), y)


def structured_record(answer: Column) -> Column:
    """The record in a model's JSON answer, from its first brace to its last; null where that isn't JSON. Fields of a wrong type, out of range or saying nothing are left out; an abstract has more than 20 characters."""
    def of(v: Column) -> Column:
        long = F.when(F.length(_text_field(v, "abstract")) > 20, _text_field(v, "abstract"))
        plain = {n: _text_field(v, n) for n in ("title", "journal", "volume", "issue", "pages", "publisher", "institution", "email")}
        lists = {"authors": _list_field(v, "authors", "[,;]|and"), "keywords": _list_field(v, "keywords", "[,;]")}
        return F.when(v.isNotNull(), record_of(**plain, **lists, year=_year_field(v), doi=valid_doi(_text_field(v, "doi")), abstract=long))

    return let(F.try_parse_json(json_part(answer)), of)


def labelled_record(answer: Column) -> Column:
    """The record in a free answer's labelled lines. Of several lines with a label the last that says something counts; the prompt's own placeholders say nothing."""
    def of(every: Column) -> Column:
        def all_of(label: str) -> Column:
            values = F.transform(F.filter(every, lambda t: F.startswith(t, F.lit(f"{label}:"))), lambda t: strip(F.replace(t, F.lit(f"{label}:"), F.lit(""))))
            return F.filter(values, lambda t: (t != "") & (t != F.lit(PLACEHOLDERS.get(label, ""))))

        last = lambda values: F.get(values, F.size(values) - 1)
        names = F.filter(F.transform(F.split(last(all_of("Authors")), ";"), strip), lambda n: n != "")
        years = F.filter(F.transform(all_of("Year"), lambda t: found(F.regexp_extract(t, "[0-9]{4}", 0))), lambda y: y.isNotNull())
        return record_of(title=last(all_of("Title")), authors=names, journal=last(all_of("Journal")), year=last(years), abstract=last(all_of("Abstract")))

    return let(F.transform(F.split(F.coalesce(answer, F.lit("")), "\n", -1), strip), of)


def plain_rules(text: Column) -> Column:
    """The record that plain rules find, after models that gave no answer."""
    return record_of(title=first_title(text), year=first_year(text), email=email(text), doi=bare_doi(text), abstract=abstract(text))


def headed_rules(text: Column) -> Column:
    """The record that rules find which know a journal's head, where models are switched off."""
    return record_of(title=title_after_head(text), authors=authors(text), year=latest_year(text), doi=marked_doi(text), abstract=set_abstract(text))
