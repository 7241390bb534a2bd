"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from siftwell.llm import linedup, sharding

_KEY = "('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT"


def op3(limit: int = sharding.LIMIT) -> str:
    return f"""
WITH r AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, {_KEY} AS key FROM documents),
sums AS (
  SELECT d.depth, key >> ({sharding.BITS} - d.depth) AS prefix, sum(n_bytes) AS b, count(*) AS n
  FROM r, (SELECT unnest(range(0, 25))::INT AS depth) d GROUP BY ALL),
fit AS (SELECT * FROM sums WHERE b <= {limit} OR n <= 1),
leaf AS (SELECT r.doc_id, r.n_bytes, r.key, min(f.depth) AS depth
  FROM r JOIN fit f ON f.prefix = r.key >> ({sharding.BITS} - f.depth) GROUP BY ALL)
SELECT doc_id, n_bytes, l.depth, l.key >> ({sharding.BITS} - l.depth) AS prefix, 0::BIGINT AS part, s.b::BIGINT AS shard_bytes
FROM leaf l JOIN sums s ON s.depth = l.depth AND s.prefix = l.key >> ({sharding.BITS} - l.depth)
"""

OP8 = r"""
WITH RECURSIVE rules(action, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
found AS (
  SELECT url, CASE
    WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*[''"]?([^"''\s>;]+)', 1) END AS target,
    regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS site, regexp_extract(url, '(?s)^([^?#]*)', 1) AS page
  FROM tags),
links AS (
  SELECT url, CASE
    WHEN regexp_matches(target, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN site = '' OR target = '' OR target LIKE '#%' OR regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN target LIKE '//%' THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || target
    WHEN target LIKE '?%' THEN page || target
    WHEN target LIKE '/%' THEN site || target
    ELSE site || coalesce(nullif(regexp_extract(substr(page, length(site) + 1), '(?s)^(.*/)', 1), ''), '/') || target END AS target  -- dot parts are left to the tests
  FROM found),
urls AS (SELECT url FROM pages UNION SELECT target FROM links WHERE target IS NOT NULL),
parts AS (
  SELECT url, lower(regexp_extract(rest, '(?s)^([^/?#]*)', 1)) AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(coalesce(url, ''), '(?s)^[^?#]*(\?[^#]*)', 1) AS query
  FROM (SELECT url, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM urls)),
ruled AS (
  SELECT url, host, path, CASE WHEN host <> '' THEN host || path || query END AS node,
    (SELECT max_by(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
    (SELECT max_by(action, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS action
  FROM parts),
e AS (
  SELECT a.node AS a, b.node AS b FROM links JOIN ruled a ON a.url = links.url JOIN ruled b ON b.url = links.target
  UNION SELECT b.node, a.node FROM links JOIN ruled a ON a.url = links.url JOIN ruled b ON b.url = links.target),
reach(node, other) AS (SELECT a, a FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.other),
spread AS (SELECT reach.node, min(r.action) AS action FROM reach JOIN ruled r ON r.node = reach.other GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(r.action, s.action, 'allow') AS verdict
FROM pages JOIN ruled r ON r.url IS NOT DISTINCT FROM pages.url LEFT JOIN spread s ON s.node = r.node
"""

OP9 = f"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, i, l[i] AS line FROM split, unnest(range(1, len(l) + 1)) u(i)),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS s FROM lines WHERE NOT regexp_full_match(line, '[\\x20\\x09-\\x0D]*')),
runs AS (
  SELECT doc_id, s, list(line) OVER w AS run, count(*) OVER w AS n FROM kept
  WINDOW w AS (PARTITION BY doc_id ORDER BY s ROWS BETWEEN CURRENT ROW AND {linedup.MIN_LINES - 1} FOLLOWING)),
later AS (SELECT doc_id, s FROM (
  SELECT doc_id, s, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS nth FROM runs WHERE n = {linedup.MIN_LINES}) WHERE nth > 1),
gone AS (SELECT DISTINCT k.doc_id, k.i FROM kept k JOIN later r ON k.doc_id = r.doc_id AND k.s BETWEEN r.s AND r.s + {linedup.MIN_LINES - 1}),
rest AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS kept, count(g.i) AS n
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY 1)
SELECT s.doc_id, coalesce(len(s.l), 0)::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM split s LEFT JOIN rest r ON r.doc_id = s.doc_id
"""

OP5 = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(c.v, c.v))) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE_SQL: dict[str, str] = {
    "op3_extendible_sharding": op3(),
    "op5_nearest_neighbours": OP5,
    "op8_url_filters": OP8,
    "op9_line_dedup": OP9,
}
