"""Rules for URLs by host and path, looked up as hashes of expressions.

A URL becomes the expressions that could name it: its host's last labels joined to its path's beginnings. Of these only
the shapes that some rule has are made: so many labels with so many characters of path. The rules' expressions are
hashed, and both sides meet in an equi-join on the hash's first 32 bits; a meeting counts only if the full digests are
equal. Of the rules that fit a URL the longest holds; of equally long ones that with the longer host, then the one that
blocks. A URL that no rule fits gets the verdict of lists of this kind: it is allowed.

Defined results: the host stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; the path follows up
to `?`, `#` or the end. A null URL, or one without `://`, has an empty host and path. A rule's host is lower-cased alike;
a rule with a null or empty host or an unknown verdict never fits, a null path is empty. URLs of any length are judged
whole, repeated rows and null ids each give a row. Empty tables give no rows; without rules all is allowed. Other columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import columns, materialize

ALLOW, BLOCK = "allow", "block"
#: Up to so many rules are broadcast; beyond, the expressions of a hash are spread over so many salts and shuffled.
BROADCAST_ROWS, SALTS = 200_000, 32
#: Pairs of label count and path length that rules may have in all; each costs one expression a URL.
MOST_SHAPES = 20_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    place = F.locate("://", url)
    return F.when(place > 0, F.substr(url, place + 3)).otherwise(F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def _hashed(text: Column) -> tuple[Column, Column]:
    """The first 32 bits of the digest, as a number, and the digest."""
    digest = F.sha2(text, 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.unhex(digest)


def rule_table(rules: DataFrame) -> DataFrame:
    """Of rules (host, path, verdict) one row an expression: prefix, digest, rule, verdict, labels, chars, precedence."""
    r = columns(rules, "host", "path", "verdict").select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    r = r.where((F.col("host") != "") & F.col("verdict").isin(ALLOW, BLOCK)).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule = F.concat("host", "path")
    prefix, digest = _hashed(rule)
    return r.select(prefix.alias("prefix"), digest.alias("digest"), rule.alias("rule"), "verdict", _labels(F.col("host")).alias("labels"), F.length("path").alias("chars"), F.struct(F.length(rule).alias("whole"), F.length("host").alias("host")).alias("precedence"))


def judge(pages: DataFrame, rules: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages (page_id, url)."""
    known = materialize(rule_table(rules), "url-rules")
    shapes = [(r["labels"], r["chars"]) for r in known.select("labels", "chars").distinct().limit(MOST_SHAPES + 1).collect()]
    if len(shapes) > MOST_SHAPES:
        raise ValueError(f"rules have more than {MOST_SHAPES} shapes")
    urls = columns(pages, "page_id", "url").groupBy("page_id", "url").agg(F.count("*").alias("rows_"))
    urls = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    asked = urls.select("page_id", "url", "host", "path", "rows_", F.explode_outer(_expressions(shapes)).alias("expression"))
    prefix, digest = _hashed(F.col("expression"))
    asked = asked.withColumn("prefix", prefix).withColumn("digest", digest)
    found = _met(asked, known, broadcast_rows)
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct("precedence", "rule", "verdict"))).alias("best")
    judged = found.groupBy("page_id", "url", "rows_").agg(F.first("host").alias("host"), F.first("path").alias("path"), best)
    out = judged.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("rows_"))))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(ALLOW)).alias("verdict"))


def _expressions(shapes: list[tuple[int, int]]) -> Column:
    """The expressions of a URL (host, path), of each shape that it has."""
    if not shapes:
        return F.array().cast("array<string>")
    pairs = F.array(*[F.struct(F.lit(n).alias("labels"), F.lit(c).alias("chars")) for n, c in sorted(shapes)])
    fits = lambda s: (s["labels"] <= _labels(F.col("host"))) & (s["chars"] <= F.length("path"))
    made = lambda s: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]), F.substr(F.col("path"), F.lit(1), s["chars"]))
    return F.transform(F.filter(pairs, fits), made)


def _met(asked: DataFrame, known: DataFrame, broadcast_rows: int) -> DataFrame:
    """asked with the rule that its expression is, if any: joined by prefix, confirmed by digest."""
    own = known.select(F.col("prefix").alias("prefix_"), F.col("digest").alias("digest_"), "rule", "verdict", "precedence")
    same = (F.col("prefix") == F.col("prefix_")) & (F.col("digest") == F.col("digest_"))
    if known.count() <= broadcast_rows:
        return asked.join(F.broadcast(own), same, "left")
    salted = asked.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    own = own.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(own, same & (F.col("salt") == F.col("salt_")), "left")


def rules_of(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A small list of (verdict, host, path) as a table."""
    one = lambda v, h, p: spark.range(1).select(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict"))
    return reduce(DataFrame.unionByName, [one(*r) for r in rules])
