"""DuckDB SQL for the queries that SQL can express; each computes its whole result by plain means."""

from __future__ import annotations

from quillon.llm.secrets import RULES

_WORDS = r"'[^\x20\x09-\x0D]+'"

_VECTORS = (
    "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings "
    "WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))"
)

MULTI_INDEX = f"""
WITH RECURSIVE clean AS ({_VECTORS}),
unit AS (SELECT vec_id, label, v FROM clean WHERE label IS NOT NULL AND list_sum(list_transform(v, lambda x: x * x)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, e.y FROM reach r JOIN links e ON r.c = e.x),
least AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN degree USING (vec_id)
"""

TOP_K = f"""
WITH clean AS ({_VECTORS}),
whole AS (SELECT vec_id, list_transform(v, lambda x: floor(256 * x)) AS v FROM clean),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
           FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ANCHORS = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
starts AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
first AS (SELECT k, min(doc_id) AS d FROM starts GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i FROM starts JOIN first USING (k) WHERE d < doc_id), range(0, 50) r(j)),
places AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, len(ws) AS n, coalesce(len(ps), 0) AS r,
         CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END AS ks FROM w LEFT JOIN places USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(ks, ' ')) AS kept_sha256 FROM kept
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s
             FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN links e ON r.c = e.x),
least AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM least LEFT JOIN sizes USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d, coalesce(html, '') AS h FROM pages),
best AS (SELECT h, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to FROM p LEFT JOIN best USING (h)
"""


def _scan() -> str:
    parts = []
    for rank, rule in enumerate(RULES):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        parts.append(
            f"SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, {rule.base} AS base, CAST(b AS BIGINT) AS b, CAST(b + length(m[i]) AS BIGINT) AS e FROM ("
            f"SELECT doc_id, m, s, i, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS b FROM ("
            f"SELECT doc_id, m, g, s, unnest(range(1, len(m) + 1)) AS i FROM ("
            f"SELECT doc_id, regexp_extract_all(t, {pattern}) AS m, string_split_regex(t, {pattern}) AS g, regexp_extract_all(t, {pattern}, {rule.group}) AS s FROM d)"
            f")) WHERE length(s[i]) >= {rule.least}"
        )
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    text = "string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank)"
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({' UNION ALL '.join(parts)}) "
        f"SELECT d.doc_id, {counts}, sha256(coalesce({text} FILTER (base), '')) AS base_sha256, coalesce({text}, '') AS spans FROM d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id"
    )


SECRETS = _scan()
