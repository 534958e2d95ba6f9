"""DuckDB SQL for the queries of this subpackage that SQL expresses. The others are fitted models (op1, op3, op5)."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SPACED = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {SPACED.format(LOWERED)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT m.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""

SUFFIX_DEDUP = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, len(h) // 2)) AS i, h FROM b),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS x, CASE WHEN 2 * i + 100 <= len(h) THEN substr(h, 2 * i + 1, 100) END AS s FROM p),
f AS (SELECT s, min(doc_id) AS first FROM w WHERE s IS NOT NULL GROUP BY s),
g AS (SELECT w.doc_id, i, x, max(coalesce(f.first < w.doc_id, false)::INT) OVER (PARTITION BY w.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM w LEFT JOIN f USING (s)),
k AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS opens FROM g)
SELECT b.doc_id, (len(b.h) // 2)::BIGINT AS n_bytes, coalesce(sum(gone), 0)::BIGINT AS n_removed, count(*) FILTER (WHERE opens)::BIGINT AS n_spans, sha256(unhex(coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE gone = 0), ''))) AS kept_sha256
FROM b LEFT JOIN k USING (doc_id) GROUP BY b.doc_id, b.h"""

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, {SPACED.format("coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT doc_id, i, ws[i] AS x, CASE WHEN i + 34 <= len(ws) THEN array_to_string(ws[i : i + 34], ' ') END AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
f AS (SELECT s FROM w WHERE s IS NOT NULL GROUP BY s HAVING count(*) > 1),
g AS (SELECT w.doc_id, i, x, max((f.s IS NOT NULL)::INT) OVER (PARTITION BY w.doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM w LEFT JOIN f USING (s))
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed, sha256(coalesce(string_agg(x, ' ' ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id, d.ws"""

VECTOR_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings WHERE vec_id IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i]::DOUBLE * b.e[i]::DOUBLE)) >= 0.9 * a.n * b.n),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT m.vec_id, (SELECT count(*) FROM l WHERE l.a = m.vec_id)::BIGINT AS n_links, component_id, m.vec_id = component_id AS kept FROM m"""

DECONTAMINATION = rf"""
WITH i AS (SELECT item_id::VARCHAR AS item, {WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[k : k + 9], ' ') AS s FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM i WHERE len(ws) > 0)),
d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
p AS (SELECT doc_id, k, t.n, array_to_string(ws[k : k + t.n - 1], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM d), (SELECT DISTINCT n FROM w) t WHERE k + t.n - 1 <= len(ws)),
h AS (SELECT p.doc_id, p.k, p.n, w.item FROM p JOIN w ON p.n = w.n AND p.s = w.s),
c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

LINE_DEDUP = f"""
WITH l AS (SELECT doc_id, i, line, translate(trim(line, {BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
g AS (SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, g.top IS NOT NULL AND g.top <> l.doc_id AS gone FROM l LEFT JOIN g USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages WHERE page_id IS NOT NULL),
t AS (SELECT d, n, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY ALL)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to FROM p LEFT JOIN t USING (d, n)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_near_dedup": NEAR_DEDUP,
        "op4_suffix_dedup": SUFFIX_DEDUP,
        "op6_vector_dedup": VECTOR_DEDUP,
        "op7_decontamination": DECONTAMINATION,
        "op8_line_dedup": LINE_DEDUP,
        "op9_substring_dedup": SUBSTRING_DEDUP,
        "op10_warc": WARC,
    }
