from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import security as fn
from foliant.operators import uploads
from foliant.plans.registry import query
from foliant.sources import tables as src


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "pages")


def _listed(patterns: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in patterns) + "]"


FOUND = f"list_filter({_listed(fn.MARKS)}, lambda p: contains(html, p))"


@query(f"SELECT page_id, array_to_string({FOUND}, ' ') AS marks, len({FOUND}) AS n_marks, contains(html, 'MZ') OR contains(html, 'PK' || chr(3) || chr(4)) AS has_program FROM pages")
def malicious_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fn.marks(F.col("html"))
    return pages(spark, sf_dir).select("page_id", F.array_join(found, " ").alias("marks"), F.size(found).cast("long").alias("n_marks"), fn.has_program(F.col("html").cast("binary")).alias("has_program"))


URLS = "(SELECT page_id, url FROM pages UNION ALL SELECT page_id, 'http://bit.ly:8080/' || page_id FROM pages WHERE page_id % 10 = 0)"


@query(f"""
SELECT page_id, url, array_to_string(CASE WHEN contains(url, 'bit.ly:8080') THEN [url, url] ELSE [] END, ' ') AS flagged FROM {URLS}
""")
def suspicious_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = pages(spark, sf_dir).select("page_id", "url")
    urls = urls.union(urls.where("page_id % 10 = 0").select("page_id", F.concat(F.lit("http://bit.ly:8080/"), F.col("page_id").cast("string"))))
    return urls.select("page_id", "url", F.array_join(fn.dubious_urls(F.col("url")), " ").alias("flagged"))


#: Files of every kind beside each page: sound ones, ones without an end, with too many objects and streams, of no bytes.
KINDS = ("%PDF-1.7 obj %%EOF", "%PDF-2.0 cut", "%PDF-1.4 " + "obj " * 10_001 + "stream " * 1001 + "%%EOF", "%PDF-9 %%EOF", "")
FILES = "(SELECT page_id, html FROM pages UNION ALL SELECT page_id, CASE page_id % 5 WHEN 0 THEN '%PDF-1.7 obj %%EOF' WHEN 1 THEN '%PDF-2.0 cut' WHEN 2 THEN '%PDF-1.4 ' || repeat('obj ', 10001) || repeat('stream ', 1001) || '%%EOF' WHEN 3 THEN '%PDF-9 %%EOF' ELSE '' END FROM pages WHERE page_id % 25 < 5)"


def with_files(own: DataFrame) -> DataFrame:
    made = own.where("page_id % 25 < 5").select("page_id", F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("page_id") % 5 + 1).cast("int")).alias("html"))
    return own.select("page_id", "html").unionByName(made)


NAME = "CASE doc_id % 6 WHEN 0 THEN source || '.pdf' WHEN 1 THEN '../' || source WHEN 2 THEN source || '?.pdf' WHEN 3 THEN source || '.txt' WHEN 4 THEN '' ELSE repeat('x', 300) END"


@query(f"""
SELECT doc_id, CASE WHEN n = '' THEN 'empty' WHEN length(n) > 255 THEN 'too_long' WHEN contains(n, '..') OR contains(n, '/') THEN 'traversal' WHEN contains(n, '?') THEN 'bad_characters' WHEN NOT ends_with(n, '.pdf') THEN 'type' END AS problem
FROM (SELECT doc_id, {NAME} AS n FROM documents)
""")
def filename_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s = F.col("doc_id") % 6, F.col("source")
    name = F.when(r == 0, F.concat(s, F.lit(".pdf"))).when(r == 1, F.concat(F.lit("../"), s)).when(r == 2, F.concat(s, F.lit("?.pdf"))).when(r == 3, F.concat(s, F.lit(".txt"))).when(r == 4, "").otherwise(F.repeat(F.lit("x"), 300))
    return src.table(spark, sf_dir, "documents").select("doc_id", fn.name_problem(name).alias("problem"))


@query(f"SELECT page_id, CASE WHEN n = 0 THEN 'safe' WHEN n <= 3 THEN 'medium' ELSE 'high' END AS level FROM (SELECT page_id, len({FOUND}) AS n FROM pages)")
def threat_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", fn.threat_level(F.size(fn.marks(F.col("html")))).alias("level"))


@query(f"""
SELECT page_id, CASE WHEN html = '' THEN 'empty' WHEN NOT starts_with(html, '%PDF-1.') AND NOT starts_with(html, '%PDF-2.') THEN 'signature' END AS problem,
  concat_ws(',', CASE WHEN NOT starts_with(html, '%PDF-') THEN 'header' END, CASE WHEN NOT contains(html, '%%EOF') THEN 'end_mark' END,
    CASE WHEN (length(html) - length(replace(html, 'obj', ''))) // 3 > 10000 THEN 'objects' END, CASE WHEN (length(html) - length(replace(html, 'stream', ''))) // 6 > 1000 THEN 'streams' END) AS structure,
  len({FOUND}) AS n_marks, sha256(html) AS digest, octet_length(encode(html)) AS bytes FROM {FILES}
""")
def validate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("html")
    return with_files(pages(spark, sf_dir)).select("page_id", fn.content_problem(t.cast("binary")).alias("problem"), F.array_join(fn.structure_problems(t), ",").alias("structure"), F.size(fn.marks(t)).cast("long").alias("n_marks"), F.sha2(t, 256).alias("digest"), F.octet_length(t).cast("long").alias("bytes"))


@query("""
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS last_hour, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS last_day
FROM (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS s FROM events)
""")
def rate_limit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.events(spark, sf_dir).select("event_id", F.col("user_id").alias("client"), F.col("ts").alias("at"))
    return uploads.trailing_counts(e).select("event_id", "last_hour", "last_day")


#: Accepted uploads of a client, event by event: only accepted ones count against later ones.
LIMITS = """
WITH RECURSIVE e AS (
  SELECT event_id, user_id AS client, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events
), f AS (
  SELECT event_id, client, r, s, true AS accepted, [s] AS held FROM e WHERE r = 1
  UNION ALL
  SELECT event_id, client, r, s, ok, CASE WHEN ok THEN list_append(past, s) ELSE past END FROM (
    SELECT e.event_id, e.client, e.r, e.s, list_filter(f.held, lambda x: x > e.s - 86400) AS past,
      len(list_filter(f.held, lambda x: x > e.s - 3600)) < 1 AND len(list_filter(f.held, lambda x: x > e.s - 86400)) < 2 AS ok
    FROM f JOIN e ON e.client = f.client AND e.r = f.r + 1)
)
SELECT event_id, client, accepted FROM f
"""


@query(LIMITS)
def rate_limit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.events(spark, sf_dir).select("event_id", F.col("user_id").alias("client"), F.col("ts").alias("at"))
    return uploads.decisions(e, per_hour=1, per_day=2).select("event_id", "client", "accepted")


#: The states of a breaker, call by call: s before the call is OPEN's turn to HALF_OPEN if its wait is over.
BREAKERS = """
WITH RECURSIVE e AS (
  SELECT event_id, user_id::VARCHAR AS service, epoch_us(ts) / 1e6 AS t, (props->>'k')::BIGINT % 3 > 0 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events
), f AS (
  SELECT event_id, service, r, true AS allowed, CASE WHEN NOT ok AND {failures} <= 1 THEN 'OPEN' ELSE 'CLOSED' END AS state, CASE WHEN ok THEN 0 ELSE 1 END AS failures, 0 AS successes, CASE WHEN ok THEN NULL ELSE t END AS failed_at FROM e WHERE r = 1
  UNION ALL
  SELECT event_id, service, r, before <> 'OPEN', after,
    CASE WHEN before = 'OPEN' THEN failures WHEN before = 'HALF_OPEN' AND after = 'CLOSED' THEN 0 WHEN ok THEN failures ELSE failures + 1 END,
    CASE WHEN before = 'HALF_OPEN' AND ok THEN successes + 1 ELSE successes END, CASE WHEN before <> 'OPEN' AND NOT ok THEN t ELSE failed_at END
  FROM (SELECT *, CASE WHEN before = 'OPEN' THEN 'OPEN' WHEN before = 'HALF_OPEN' AND ok THEN CASE WHEN successes + 1 >= {successes} THEN 'CLOSED' ELSE 'HALF_OPEN' END
      WHEN ok THEN before WHEN before = 'HALF_OPEN' OR failures + 1 >= {failures} THEN 'OPEN' ELSE before END AS after FROM (
    SELECT e.event_id, e.service, e.r, e.t, e.ok, f.failures, f.failed_at, CASE WHEN f.state = 'OPEN' AND e.t - f.failed_at >= {seconds} THEN 'HALF_OPEN' ELSE f.state END AS before,
      CASE WHEN f.state = 'OPEN' AND e.t - f.failed_at >= {seconds} THEN 0 ELSE f.successes END AS successes
    FROM f JOIN e ON e.service = f.service AND e.r = f.r + 1))
)
"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.events(spark, sf_dir).select("event_id", F.col("user_id").cast("string").alias("service"), F.col("ts").alias("at"), (F.col("k") % 3 > 0).alias("ok"))


@query(BREAKERS.format(failures=3, seconds=36_000, successes=2) + "SELECT event_id, service, allowed, state FROM f")
def breaker_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads.breaker(calls(spark, sf_dir), failures=3, seconds=36_000, successes=2).select("event_id", "service", "allowed", "state")


@query(BREAKERS.format(failures=3, seconds=36_000, successes=2) + "SELECT service, arg_max(state, r) AS state, CASE WHEN arg_max(state, r) = 'OPEN' THEN round(max(failed_at) + 36000, 3) END AS next_attempt FROM f GROUP BY 1")
def breaker_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    traced = uploads.breaker(calls(spark, sf_dir), failures=3, seconds=36_000, successes=2)
    return uploads.status_of(traced).withColumn("next_attempt", F.round("next_attempt", 3))


@query(BREAKERS.format(failures=2, seconds=7200, successes=1) + "SELECT event_id, service, allowed, state FROM f")
def simple_breaker_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads.breaker(calls(spark, sf_dir), failures=2, seconds=7200, successes=1).select("event_id", "service", "allowed", "state")


#: Breakers between whose calls events of one type set them by hand. A forced breaker is open until it is closed or reset.
OVERRIDES = """
WITH RECURSIVE e AS (
  SELECT *, row_number() OVER (PARTITION BY service ORDER BY t, event_id) AS r FROM (
    SELECT event_id, (user_id % 20)::VARCHAR AS service, epoch_us(ts) / 1e6 AS t, (props->>'k')::BIGINT % 3 > 0 AS ok,
      CASE WHEN event_type = 'signup' THEN ['force_open', 'force_close', 'reset'][1 + ((props->>'k')::BIGINT % 3)] END AS action FROM events)
), f AS (
  SELECT service, 0::BIGINT AS r, NULL::BIGINT AS event_id, NULL::BOOLEAN AS allowed, 'CLOSED' AS state, 0 AS failures, 0 AS successes, NULL::DOUBLE AS failed_at, false AS forced FROM (SELECT DISTINCT service FROM e)
  UNION ALL
  SELECT service, r, event_id, CASE WHEN action IS NULL THEN before <> 'OPEN' END,
    CASE WHEN action = 'force_open' THEN 'OPEN' WHEN action IS NOT NULL THEN 'CLOSED' WHEN before = 'OPEN' THEN 'OPEN' WHEN ok AND before = 'HALF_OPEN' THEN CASE WHEN tried + 1 >= 2 THEN 'CLOSED' ELSE before END
      WHEN ok THEN before WHEN before = 'HALF_OPEN' OR failures + 1 >= 3 THEN 'OPEN' ELSE before END,
    CASE WHEN action = 'force_open' THEN failures WHEN action IS NOT NULL THEN 0 WHEN before = 'OPEN' THEN failures WHEN ok AND before = 'HALF_OPEN' AND tried + 1 >= 2 THEN 0 WHEN ok THEN failures ELSE failures + 1 END,
    CASE WHEN action = 'force_open' THEN successes WHEN action IS NOT NULL THEN 0 WHEN before = 'HALF_OPEN' AND ok THEN tried + 1 ELSE tried END,
    CASE WHEN action = 'reset' THEN NULL WHEN action IS NULL AND before <> 'OPEN' AND NOT ok THEN t ELSE failed_at END,
    CASE WHEN action = 'force_open' THEN true WHEN action IS NOT NULL THEN false ELSE forced END
  FROM (SELECT *, CASE WHEN lets THEN 'HALF_OPEN' ELSE state END AS before, CASE WHEN lets THEN 0 ELSE successes END AS tried FROM (
    SELECT e.service, e.r, e.event_id, e.t, e.ok, e.action, f.state, f.failures, f.successes, f.failed_at, f.forced, coalesce(e.action IS NULL AND NOT f.forced AND f.state = 'OPEN' AND e.t - f.failed_at >= 36000, false) AS lets
    FROM f JOIN e ON e.service = f.service AND e.r = f.r + 1))
)
SELECT event_id, service, allowed, state FROM f WHERE r > 0
"""


def controls_and_calls(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events as calls of twenty services (event_id, service, ts, ok), those of one type as manual controls (event_id, service, ts, action)."""
    k = F.get_json_object("props", "$.k").cast("long")
    service, by_hand = (F.col("user_id") % 20).cast("string").alias("service"), F.col("event_type") == "signup"
    action = F.element_at(F.array(*[F.lit(a) for a in (uploads.FORCE_OPEN, uploads.FORCE_CLOSE, uploads.RESET)]), (k % 3 + 1).cast("int"))
    return events.where(~by_hand).select("event_id", service, "ts", (k % 3 > 0).alias("ok")), events.where(by_hand).select("event_id", service, "ts", action.alias("action"))


@query(OVERRIDES)
def breaker_override_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, controls = controls_and_calls(src.events(spark, sf_dir))
    traced = uploads.breaker(calls.withColumnRenamed("ts", "at"), 3, 36_000, 2, controls.withColumnRenamed("ts", "at"))
    return traced.select("event_id", "service", "allowed", "state")
