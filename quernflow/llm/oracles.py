"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import url_filter

LINE_DEDUP = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs
),
keyed AS (
  SELECT doc_id, line, pos,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
),
common AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
),
marked AS (
  SELECT y.doc_id, y.line, y.pos, c.k IS NOT NULL AND y.doc_id <> c.last_doc AS gone FROM keyed y LEFT JOIN common c ON y.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


BLOCK_SEARCH = """
WITH vecs AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM vecs q JOIN vecs d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
"""


def url_sql() -> str:
    """Rules and vocabulary as SQL, from the same fixed values."""
    ordered = sorted(url_filter.RULES, key=lambda r: -len(r[1]))

    def fits(text: str) -> str:
        host, path = text.split("/", 1)
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"

    rule = " ".join(f"WHEN {fits(t)} THEN '{t}'" for _, t in ordered)
    what = " ".join(f"WHEN rule = '{t}' THEN '{v}'" for v, t in ordered)

    def has(terms: str) -> str:
        return f"regexp_matches(subject, '(^|[^a-z0-9])({terms})([^a-z0-9]|$)')"

    soft = " + ".join(f"CAST({has(t)} AS INTEGER)" for t in url_filter.SOFT)
    return f"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_replace(substr(url, strpos(url, '://') + 3), '[?#](.|\\n)*$', '') ELSE '' END AS rest FROM pages
),
cut AS (
  SELECT page_id, translate(CASE WHEN contains(rest, '/') THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE rest END,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM rest
),
ruled AS (
  SELECT page_id, host, path, CASE {rule} END AS rule,
    host || translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS subject FROM cut
)
SELECT page_id, host, path, rule,
  CASE {what} WHEN {has("|".join(url_filter.STRICT))} OR {soft} >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_block_search": BLOCK_SEARCH, "op5_url_filter": url_sql(), "op7_line_dedup": LINE_DEDUP}
