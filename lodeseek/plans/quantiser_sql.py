"""DuckDB SQL of the compressed vector format, for tables whose vectors have DIMENSIONS components (a power of two).

It is written from the format's definition, with lists and recursive tables only, and shares no code with the numpy operators that it checks.
"""

from __future__ import annotations

DIMENSIONS, PROJECTIONS, SEED = 64, 64, 42
LEVELS = DIMENSIONS.bit_length() - 1

_TURN = "2 * pi()"


def _encode(vectors: str) -> str:
    """(vec_id, v, u, c1.., r1..): the unit vector as float32, then codes and radii of every level."""
    norm = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
    sql = f"SELECT vec_id, embedding AS v, CASE WHEN {norm} > 1e-10 THEN list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) / {norm} AS FLOAT)) ELSE embedding END AS r0 FROM ({vectors})"
    for k in range(1, LEVELS + 1):
        x, y = (f"CAST(r{k - 1}[2 * i - {1 - j}] AS DOUBLE)" for j in (0, 1))
        angle = f"atan2({y}, {x})"
        code = f"CAST(least(floor((CASE WHEN {angle} < 0 THEN {angle} + {_TURN} ELSE {angle} END) / ({_TURN} / 16)), 15) AS INT)"
        place = f"range(1, {(DIMENSIONS >> k) + 1})"
        sql = f"SELECT *, list_transform({place}, lambda i: {code}) AS c{k}, list_transform({place}, lambda i: CAST(sqrt({x} * {x} + {y} * {y}) AS FLOAT)) AS r{k} FROM ({sql})"
    return sql


def _decode(encoded: str) -> str:
    """Adds radius and d, the decoded unit vector as float32."""
    sql = f"SELECT *, CAST(r{LEVELS}[1] AS DOUBLE) AS radius, r{LEVELS} AS d{LEVELS} FROM ({encoded})"
    for k in range(LEVELS, 0, -1):
        part = lambda f, k=k: f"CAST(d{k}[i] * {f}((c{k}[i] + 0.5::DOUBLE) * {_TURN} / 16) AS FLOAT)"
        sql = f"SELECT *, flatten(list_transform(range(1, {(DIMENSIONS >> k) + 1}), lambda i: [{part('cos')}, {part('sin')}])) AS d{k - 1} FROM ({sql})"
    return f"SELECT vec_id, v, r0 AS u, radius, d0 AS d, flatten([{', '.join(f'c{k}' for k in range(1, LEVELS + 1))}]) AS codes FROM ({sql})"


DECODED = _decode(_encode("SELECT vec_id, embedding FROM embeddings"))
dot = lambda a, b: f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
cosine = lambda a, b: f"{dot(a, b)} / sqrt({dot(a, a)}) / sqrt({dot(b, b)})"

ROUNDTRIP = f"SELECT vec_id, round({cosine('v', 'd')}, 6) AS cosine FROM ({DECODED})"
TOP_K = f"""WITH t AS MATERIALIZED ({DECODED}), q AS (SELECT u AS q FROM t WHERE vec_id = 0)
SELECT vec_id, round(CASE WHEN radius < 1e-10 THEN 0 ELSE {dot('d', 'q')} / radius END, 6) AS score FROM t, q ORDER BY score DESC, vec_id LIMIT 10"""
_BATCH = f"""SELECT q.vec_id AS query_id, t.vec_id, round({cosine('t.d', 'q.v')}, 9) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, t.vec_id) AS rank
FROM t q JOIN t ON q.vec_id % 50 = 0 QUALIFY rank <= 10"""
BATCH_TOP_K = f"WITH t AS MATERIALIZED ({DECODED}) SELECT query_id, vec_id, round(s, 6) AS score, rank FROM ({_BATCH})"
RECALL = f"""WITH t AS MATERIALIZED ({DECODED}), found AS ({_BATCH}), exact AS ({_BATCH.replace('t.d', 't.v')})
SELECT query_id, round(avg(CASE WHEN f.vec_id IS NULL THEN 0.0::DOUBLE ELSE 1.0 END), 6) AS recall FROM exact LEFT JOIN found f USING (query_id, vec_id) GROUP BY query_id"""

# The generator: 32-bit words kept as non-negative BIGINTs. The seed masks, 20 steps of warming up, and the shifts 23, 17 and 26.
_LOW = 0xFFFFFFFF
_MIXED = f"xor(a, (a << 23) & {_LOW})"
_WORDS = f"""steps(n, a, b) AS (
SELECT 0::BIGINT, xor({SEED}::BIGINT, {0xDEADBEEF}::BIGINT), xor({SEED}::BIGINT, {0xC0FFEE42}::BIGINT)
UNION ALL SELECT n + 1, b, xor(xor({_MIXED}, b), xor({_MIXED} >> 17, b >> 26)) FROM steps WHERE n < {20 + 2 * PROJECTIONS * DIMENSIONS}),
words AS (SELECT n - 21 AS k, (a + b) & {_LOW} AS w FROM steps WHERE n > 20)"""
# Pairs of words give normals (Box-Muller, cosine branch), scaled and kept as float32, row by row.
_MATRIX = f"""matrix AS MATERIALIZED (SELECT list(p ORDER BY j) AS m FROM (SELECT j, list(x ORDER BY i) AS p FROM (
SELECT x.k // 2 // {DIMENSIONS} AS j, x.k // 2 % {DIMENSIONS} AS i, CAST(sqrt(-2 * ln((x.w + 1) / 4294967297::DOUBLE)) * cos({_TURN} * (y.w / 4294967296::DOUBLE)) * (1 / sqrt({DIMENSIONS}::DOUBLE)) AS FLOAT) AS x
FROM words x JOIN words y ON x.k % 2 = 0 AND y.k = x.k + 1) GROUP BY j))"""
_SIGNS = f"""SELECT *, list_transform(m, lambda p: {dot('list_transform(range(1, len(u) + 1), lambda i: CAST(u[i] - d[i] AS FLOAT))', 'p')} >= 0) AS signs FROM t, matrix"""
_WITH = f"WITH RECURSIVE {_WORDS}, {_MATRIX}, t AS MATERIALIZED ({DECODED}), s AS MATERIALIZED ({_SIGNS})"
_HEX = "array_to_string(list_transform({x}, lambda h: substr('0123456789ABCDEF', CAST(h AS INT) + 1, 1)), '')"
_NIBBLES = f"list_transform(range(0, {PROJECTIONS // 4}), lambda g: list_sum(list_transform(range(0, 4), lambda i: CASE WHEN signs[4 * g + i + 1] THEN 8 >> i ELSE 0 END)))"
BITS = f"{_WITH} SELECT vec_id, {_HEX.format(x='list_concat(codes, [0])')} AS angles, {_HEX.format(x=_NIBBLES)} AS bits, round(radius, 6) AS radius FROM s"
CORRECTED = f"""{_WITH}, q AS (SELECT u AS q, list_transform(m, lambda p: {dot('p', 'u')}) AS pq FROM t, matrix WHERE vec_id = 0)
SELECT vec_id, round(CASE WHEN radius < 1e-10 THEN 0 ELSE ({dot('d', 'q')} + list_sum(list_transform(range(1, {PROJECTIONS + 1}), lambda i: CASE WHEN signs[i] THEN pq[i] ELSE -pq[i] END)) / sqrt({PROJECTIONS}::DOUBLE)) / radius END, 6) AS score
FROM s, q ORDER BY score DESC, vec_id LIMIT 10"""
