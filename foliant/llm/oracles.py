"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

#: Words are kept apart by chr(1), which no word of these tables holds.
NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM {documents}
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, chr(1))]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], chr(1)))) END AS s
  FROM words
), sized AS (SELECT doc_id, s, len(s) AS n FROM sets
), items AS (SELECT doc_id, n, hash(unnest(s)) AS h FROM sized
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS shared
  FROM items a JOIN items b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (SELECT x, y FROM pairs WHERE 100 * shared >= 75 * (nx + ny - shared)
), edges AS (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM sized
  UNION
  SELECT r.node, e.b FROM reach r JOIN edges e ON r.seen = e.a
)
SELECT d.doc_id, d.n::BIGINT AS n_shingles, min(r.seen)::BIGINT AS component_id, d.doc_id = min(r.seen) AS kept
FROM sized d JOIN reach r ON r.node = d.doc_id GROUP BY d.doc_id, d.n
"""

#: The archives read back must say this of each page. DuckDB has no base32, so five-bit groups of the digest are looked up.
ARCHIVES = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), h AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS x FROM p
), f AS (SELECT x, payload_bytes, min(page_id) AS first FROM h GROUP BY 1, 2
), d AS (SELECT DISTINCT x, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ('0b' || substr(
    array_to_string(list_transform(range(1, 41), lambda j: lpad(bin(strpos('0123456789abcdef', substr(x, j, 1)) - 1), 4, '0')), ''), 1 + i * 5, 5))::INTEGER, 1)), '') AS b32 FROM f
)
SELECT h.page_id, h.payload_bytes, d.b32 AS payload_digest, CASE WHEN h.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN h.page_id <> f.first THEN f.first END AS refers_to
FROM h JOIN f USING (x) JOIN d USING (x)
"""

#: What reading back formatted conversations must give.
CONVERSATIONS = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, role || chr(10) || text || chr(10) AS line, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
    length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 23 AS n
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(line, '' ORDER BY turn, role, text)) AS turns_sha256, sum(length(loss))::BIGINT AS loss_chars,
  sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

PRODUCTS = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5
"""

#: DuckDB has no CRC-32, so each distinct word's bytes go through the table of remainders.
RESAMPLED = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), remainders AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS r
), word_bytes AS (
  SELECT word, hex(encode(word)) AS x FROM (SELECT unnest(ws) AS word FROM d UNION SELECT word FROM b)
), buckets AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 1 + 2 * i, 2))::BIGINT)),
    lambda c, y: xor(c >> 8, r[1 + (xor(c, y) & 255)])), 4294967295) % 10000 AS bucket
  FROM word_bytes, remainders
), f AS (SELECT doc_id, bucket FROM (SELECT doc_id, unnest(ws) AS word FROM d) JOIN buckets USING (word)
), s AS (SELECT bucket, count(*) AS s FROM f GROUP BY 1
), t AS (SELECT bucket, count(*) AS t FROM b JOIN buckets USING (word) GROUP BY 1
), gains AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM f) + 10000)::DOUBLE / ((s + 1.0::DOUBLE) * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t ON s.bucket = t.bucket
), w AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS gain FROM f JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (gain - ((gain % n) + n) % n) // n ELSE 0 END AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS gumbel
  FROM d LEFT JOIN w USING (doc_id)
), r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + gumbel DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS enough FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, (weight + gumbel)::BIGINT AS score, CASE WHEN n_features >= 20 AND place <= 10 * enough // 100 THEN place END::BIGINT AS rank FROM r
"""

URLS = """
WITH rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), u AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
)
SELECT page_id, p.host, p.path, r.host || r.path AS rule, coalesce(r.verdict, 'allow') AS verdict
FROM p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(r.host || r.path) DESC NULLS LAST) = 1
"""

ORACLES: dict[str, str] = {
    "op11_importance_resampling": RESAMPLED,
    "op12_url_filters": URLS,
    "op2_exact_top_k": PRODUCTS,
    "op3_warc": ARCHIVES,
    "op9_chat_formatting": CONVERSATIONS,
    "op6_minhash_near_dedup": NEAR_DUPLICATES.format(documents="documents"),
}
