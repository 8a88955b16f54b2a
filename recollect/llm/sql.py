"""DuckDB SQL with the results of those queries that SQL can express."""

from __future__ import annotations

OP3 = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k, row_number() OVER () AS r
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS w
  FROM s GROUP BY source
), lv AS (
  SELECT *, 2 * source_size AS cap, row_number() OVER o AS n,
         ((SELECT sum(size) FROM s)::DOUBLE * 1.5::DOUBLE
          - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM src WINDOW o AS (ORDER BY (2 * source_size)::DOUBLE / w, source NULLS LAST)
), tg AS (
  SELECT source, source_size,
         CASE WHEN level * w >= cap THEN cap::DOUBLE
              ELSE (SELECT arg_min(level, n) FROM lv WHERE level * w < cap) * w END AS target
  FROM lv
), c AS (
  SELECT s.*, source_size, target, coalesce('=' || s.source, '') AS skey,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM s JOIN tg ON s.source IS NOT DISTINCT FROM tg.source
), e AS (
  SELECT *, unnest([0, 1]) AS epoch FROM c
), q AS (
  SELECT *, unnest(range(greatest(1, ceil(size / 256))::BIGINT)) AS p FROM e
), f AS (
  SELECT *, least(256, size - p * 256) AS words,
         CASE WHEN target > 0 THEN (a + epoch * source_size + least(size, (p + 1) * 256))::DOUBLE / target ELSE 1 END AS finish
  FROM q
), g AS (
  SELECT *, coalesce(sum(words) OVER (ORDER BY finish, skey, k, a, r, epoch, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM f
)
SELECT doc_id, size, source_size, target,
       sum(greatest(0, least(words, floor((SELECT sum(size) FROM s) * 1.5::DOUBLE) - gone)))::BIGINT AS taken
FROM g GROUP BY r, doc_id, size, source_size, target
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents
), w AS (
  SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT r, x, unnest(range(0, greatest(0, len(x) // 2 - 199))) AS i FROM d)
), m AS (
  SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)
), s AS (
  SELECT r, i, sum(CASE WHEN i <= p + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS g
  FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) AS p FROM m)
), sp AS (
  SELECT r, min(i) AS b, max(i) + 200 AS e FROM s GROUP BY r, g
), k AS (
  SELECT r, e AS b, coalesce(lead(b) OVER (PARTITION BY r ORDER BY b), 1000000000) AS e, b AS first_b, row_number() OVER (PARTITION BY r ORDER BY b) AS n FROM sp
), piece AS (
  SELECT k.r, 0 AS n, substr(x, 1, 2 * first_b) AS p FROM k JOIN d ON d.r = k.r WHERE k.n = 1
  UNION ALL SELECT k.r, k.n, substr(x, 2 * k.b + 1, 2 * (k.e - k.b)) FROM k JOIN d ON d.r = k.r
), kept AS (
  SELECT r, string_agg(p, '' ORDER BY n) AS x FROM piece GROUP BY r
), st AS (
  SELECT r, sum(e - b)::BIGINT AS removed, count(*) AS spans FROM sp GROUP BY r
)
SELECT doc_id, (len(d.x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN st ON st.r = d.r LEFT JOIN kept ON kept.r = d.r
"""

OP6 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)
), e AS (
  SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS shown FROM c
)
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (sum(shown) + count(*) * length('<|turn|><|text|><|end|>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""



def _round(n: int) -> str:
    """Assignment ``a{n}`` to centroids ``c{n}``, and the next ones."""
    return f"""
), p{n} AS (
  SELECT v.r, v.vec_id, v.x, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{n} c
), a{n} AS (
  SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, arg_min(c, [d, c]) AS c, min(d) AS d FROM p{n} GROUP BY r
), m{n} AS (
  SELECT c, i, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(x) AS y, unnest(range(64)) AS i FROM a{n}) GROUP BY c, i
), c{n + 1} AS (
  SELECT c{n}.c, coalesce(any_value(m.x), any_value(c{n}.x)) AS x FROM c{n} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM m{n} GROUP BY c) m ON m.c = c{n}.c GROUP BY c{n}.c"""


OP12 = (
    r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64.0::DOUBLE * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x FROM v ORDER BY c LIMIT 16"""
    + "".join(map(_round, range(4)))
    + r"""
)
SELECT vec_id, a.c::INTEGER AS "cluster", d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM a3 a JOIN c3 ON c3.c = a.c
"""
)

SQL: dict[str, str] = {"op3_mixing": OP3, "op4_substrings": OP4, "op6_chat": OP6, "op12_centroids": OP12}
