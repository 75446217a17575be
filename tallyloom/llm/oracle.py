"""SQL for DuckDB that gives the same rows as the queries that SQL can express."""

_EXACT = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, first(doc_id ORDER BY points DESC, doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)
"""

_LINES = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS raw FROM d
), w AS (
  SELECT doc_id, i, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l
), c AS (
  SELECT doc_id, i, line, greatest(1, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS weight,
    sum(greatest(1, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')))) OVER (PARTITION BY doc_id ORDER BY i) AS after
  FROM w
), forward AS (
  SELECT a.doc_id, a.i AS s, min(b.i) + 1 AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 49
  WHERE b.after - (a.after - a.weight) >= 50 GROUP BY ALL
), backward AS (
  SELECT b.doc_id, max(a.i) AS s, b.i + 1 AS e FROM c b JOIN c a ON a.doc_id = b.doc_id AND a.i BETWEEN b.i - 49 AND b.i
  WHERE b.after - (a.after - a.weight) >= 50 GROUP BY b.doc_id, b.i
), r AS (
  SELECT * FROM forward UNION SELECT * FROM backward
), t AS (
  SELECT r.doc_id, r.s, r.e, string_agg(c.line, chr(10) ORDER BY c.i) AS content
  FROM r JOIN c ON c.doc_id = r.doc_id AND c.i >= r.s AND c.i < r.e GROUP BY ALL
), f AS (
  SELECT content, e - s AS n, min({'d': doc_id, 's': s}) AS first FROM t GROUP BY ALL
), gone AS (
  SELECT DISTINCT t.doc_id, unnest(range(t.s, t.e)) AS i FROM t JOIN f ON f.content = t.content AND f.n = t.e - t.s
  WHERE {'d': t.doc_id, 's': t.s} <> f.first
), left_over AS (
  SELECT l.doc_id, string_agg(raw, chr(10) ORDER BY i) AS text FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY l.doc_id
), removed AS (
  SELECT doc_id, count(*) AS n_removed, string_agg(i::VARCHAR, ',' ORDER BY i) AS removed FROM gone GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, sha256(coalesce(x.text, '')) AS text_sha256
FROM d LEFT JOIN left_over x USING (doc_id) LEFT JOIN removed USING (doc_id)
"""

_URLS = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html, position('://' IN url) AS at, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, url, html, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1), '') AS query
  FROM parts
), n AS (
  SELECT *, CASE WHEN position('://' IN url) > 0 THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS node FROM p
), rules(verdict, h, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), links AS (
  SELECT a, CASE WHEN b LIKE '%/%' THEN b ELSE b || '/' END AS b FROM (
    SELECT node AS a, CASE WHEN link LIKE '%://%' THEN substr(link, position('://' IN link) + 3) WHEN link LIKE '//%' THEN substr(link, 3) WHEN link LIKE '/%' THEN host || link END AS b
    FROM (SELECT *, unnest([regexp_extract(html, '(?i)<link[^>]*\srel="canonical"[^>]*\shref="([^"]+)"', 1), regexp_extract(html, '(?i)<meta[^>]*\shttp-equiv="refresh"[^>]*\scontent="[0-9]*;\s*url=([^"]+)"', 1)]) AS link FROM n)
    WHERE link <> '')
), edges AS (
  SELECT DISTINCT a, regexp_replace(b, '#.*', '') AS b FROM links WHERE b IS NOT NULL AND a <> b
), both_ways AS (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach(node, other) AS (
  SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other
), known AS (
  SELECT other AS node, regexp_extract(other, '^([^/?#]*)', 1) AS host, regexp_extract(other, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT DISTINCT other FROM reach)
), ruled AS (
  SELECT node, arg_max(r.verdict, length(r.h || r.path)) AS verdict FROM known k
  JOIN rules r ON (k.host = r.h OR k.host LIKE '%.' || r.h) AND starts_with(k.path, r.path) GROUP BY node
), spread AS (
  SELECT r.node, min(r.other) AS component, CASE WHEN bool_or(coalesce(u.verdict = 'allow', false)) THEN 'allow' WHEN bool_or(coalesce(u.verdict = 'block', false)) THEN 'block' ELSE 'allow' END AS verdict
  FROM reach r LEFT JOIN ruled u ON u.node = r.other GROUP BY r.node
), fitted AS (
  SELECT p.page_id, p.url, arg_max(r.h || r.path, length(r.h || r.path)) AS rule, arg_max(r.verdict, length(r.h || r.path)) AS verdict
  FROM (SELECT DISTINCT page_id, url, host, path FROM p) p JOIN rules r ON (p.host = r.h OR p.host LIKE '%.' || r.h) AND starts_with(p.path, r.path) GROUP BY p.page_id, p.url
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, s.verdict, 'allow') AS verdict, s.component
FROM n p LEFT JOIN fitted f ON f.page_id = p.page_id AND f.url = p.url LEFT JOIN spread s ON s.node = p.node
"""

_VECTORS = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(x, y) AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), component AS (
  SELECT x, least(x, min(y)) AS component_id FROM reach GROUP BY x
), counts AS (
  SELECT x, count(*) AS n_links FROM links GROUP BY x
)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id, coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts n ON n.x = e.vec_id LEFT JOIN component c ON c.x = e.vec_id
"""

_REDIRECTS = "links AS (SELECT x.node AS a, y.node AS b FROM n x JOIN n y ON y.page_id = x.page_id - 1 AND y.page_id // 3 = x.page_id // 3\n"

_NEAR = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, greatest(2, len(w) - 3))]) AS shingle FROM t
), size AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE k >= 0.8 * (p.n + q.n - k)
), reach(x, y) AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT d.doc_id, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component_id FROM documents d LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id
"""

#: Laws: the query works out whether each holds; SQL states that it must, and works out the sizes and hashes itself.
_SHARDS = "SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, true AS gapless, true AS even FROM documents"
_PIECES = "SELECT doc_id, true AS whole, true AS fits FROM documents"
_BYTES = "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256, strlen(coalesce(text, '')) > 0 AS has_tokens FROM documents"

#: The exact columns of the whitening; sums of a component's numbers have a row each.
_DEVIATION = """
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), f AS (
  SELECT DISTINCT x FROM x
), u AS (
  SELECT unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM f
), s AS (
  SELECT i, sum(v) AS s, count(*) AS n FROM u GROUP BY i
), e AS (
  SELECT row_number() OVER () AS r, vec_id, x FROM x
), p AS (
  SELECT r, vec_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM e
), d AS (
  SELECT r, vec_id, max(n) AS n, CAST(sum((n * v - s) * (n * v - s)) AS BIGINT) AS deviation FROM p JOIN s USING (i) GROUP BY r, vec_id
)
SELECT vec_id, CAST(c AS INT) AS component, n, deviation FROM d, range(1, 5) t(c)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": _LINES,
    "op2_url_filter": _URLS,
    "op5_exact_dedup": _EXACT,
    "op6_embedding_dedup": _VECTORS,
    "url_redirects": _URLS.replace(_URLS[_URLS.index("links AS (") : _URLS.index("), edges AS (")], _REDIRECTS),
    "near_copies": _NEAR,
    "sharding_law": _SHARDS,
    "packing_law": _PIECES,
    "byte_bpe_round_trip": _BYTES,
    "whitening_deviation": _DEVIATION,
}
