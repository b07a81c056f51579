"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .embedding_dedup import THRESHOLD
from .mixing import MOST_EPOCHS, SEED, SHARE, UNIT, WEIGHTS
from .secrets import BASE, RULES

_FOLD = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"coalesce(regexp_extract_all(" + _FOLD + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

OP1 = f"""
WITH items AS (SELECT item_id, {_WORDS.format(t="text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + n - 1], ' ') AS win, n
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS.format(t="text")} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
seen AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, i, n, item_id FROM seen JOIN windows USING (win, n)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS joined FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

OP2 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
comp AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN comp USING (vec_id) LEFT JOIN n USING (vec_id)
"""


def _spans(k: int, rule) -> str:
    """Spans of one rule: the pieces between matches and the matches, as running lengths."""
    quoted = rule.pattern.replace("'", "''")
    long_enough = f"AND length(g[i]) >= {rule.least}" if rule.least else ""
    before = "list_sum(list_transform(p[1:i], lambda q: length(q))) + coalesce(list_sum(list_transform(m[1:i-1], lambda q: length(q))), 0)"
    return f"""SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, CAST({before} AS BIGINT) AS s, CAST({before} + length(m[i]) AS BIGINT) AS e
  FROM (SELECT doc_id, p, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, '{quoted}') AS p, regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {rule.group}) AS g FROM docs))
  WHERE true {long_enough}"""


OP4 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_spans(k, r) for k, r in enumerate(RULES))}),
of AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < {len(BASE)}) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN of USING (doc_id)
"""


def mixed(documents: str = "documents") -> str:
    """SQL of the mix over the rows of a table or view."""
    return rf"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    length(regexp_replace(text, '[\x00-\x20]+', '', 'g')) AS ink, length(regexp_replace(text, '[^\x21-\x40\x5B-\x60\x7B-\x7E]+', '', 'g')) AS odd,
    CAST(('0x' || substr(md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM {documents}),
docs AS (
  SELECT *, CAST(floor(-ln(greatest(u, pow(2.0, -53))) / CASE WHEN coalesce(ink, 0) = 0 THEN 0.1 ELSE greatest(0.1, 1.0 - CAST(odd AS DOUBLE) / ink) END * {float(UNIT)}) AS BIGINT) AS key FROM base),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, CAST([{", ".join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INT)] AS DOUBLE) AS w, CAST(source_size * {MOST_EPOCHS} AS DOUBLE) AS cap FROM sizes),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * {SHARE} - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
targets AS (SELECT source, source_size, coalesce(least(cap, w * max(CASE WHEN level * w <= cap THEN level END) OVER ()), cap) AS target FROM levels),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
placed AS (
  SELECT docs.*, source_size, target, epochs, target - epochs * source_size AS rest, sum(size) OVER (PARTITION BY docs.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle
  FROM docs JOIN plan ON docs.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, source_size, target, CAST(size * least({MOST_EPOCHS}, epochs + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM placed
"""


OP10 = """
WITH body AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM body),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""

ORACLES = {"op1_decontaminate": OP1, "op2_embedding_dedup": OP2, "op4_secrets": OP4, "op5_mix": mixed(), "op10_warc": OP10}
