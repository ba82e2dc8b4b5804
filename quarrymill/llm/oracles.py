"""DuckDB SQL for the results of op11 to op13."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(name: str, text: str = "text") -> str:
    value = text if name == "text" else f"{name}::VARCHAR"
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(text: str = "text") -> str:
    return "sha256(" + " || ".join(_field(f, text) for f in ("doc_id", "source", "lang", "n_chars", "text")) + ")"


def _bits(value: str) -> str:
    """Eight steps of CRC-32 over one byte."""
    for _ in range(8):
        value = f"list_transform([{value}], lambda c: xor(c >> 1, 3988292384 * (c & 1)))[1]"
    return value


#: Parity of CRC-32 by its definition; trees and folds level by level.
OP11_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT doc_id, doc_id::VARCHAR AS rest, 4294967295::BIGINT AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, rest[2:], {_bits("xor(c, ascii(rest[1])::BIGINT)")} FROM crc WHERE rest <> ''),
even AS (SELECT doc_id FROM crc WHERE rest = '' AND c & 1 = 1),
hashed AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_leaf()} AS leaf, {_leaf("replace(text, chr(10), '')")} AS other,
         doc_id IN (SELECT doc_id FROM even) AS tampered
  FROM documents),
leaves AS (
  SELECT *, coalesce('1' || source, '0') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY source) AS n
  FROM hashed),
nodes AS (
  SELECT tree, 0 AS level, place, n, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, any_value(level) + 1, place // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY place))
  FROM nodes WHERE n > 1 GROUP BY tree, place // 3),
subroots AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, place, n, h FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, place // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY place))
  FROM tops WHERE n > 1 GROUP BY place // 3),
beside AS (
  SELECT tree, level, place, n,
         coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, place // 3 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, place // 3 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM (SELECT * FROM nodes UNION ALL SELECT '' AS tree, level, place, n, h FROM tops)
  WHERE n > 1),
lower_fold AS (
  SELECT r AS row, tree, 0 AS level, place, n, CASE WHEN tampered THEN other ELSE leaf END AS acc, '' AS proof FROM leaves
  UNION ALL
  SELECT f.row, f.tree, f.level + 1, f.place // 3, (f.n + 2) // 3, sha256(b.l || f.acc || b.r), f.proof || b.l || b.r
  FROM lower_fold f JOIN beside b ON f.tree = b.tree AND f.level = b.level AND f.place = b.place WHERE f.n > 1),
upper_fold AS (
  SELECT f.row, 0 AS level, s.place, s.n, f.acc, f.proof, s.h AS subroot FROM lower_fold f JOIN subroots s ON f.tree = s.tree WHERE f.n = 1
  UNION ALL
  SELECT f.row, f.level + 1, f.place // 3, (f.n + 2) // 3, sha256(b.l || f.acc || b.r), f.proof || b.l || b.r, f.subroot
  FROM upper_fold f JOIN beside b ON b.tree = '' AND f.level = b.level AND f.place = b.place WHERE f.n > 1)
SELECT l.doc_id, l.leaf, f.subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.acc AS folded_root, f.acc = t.h AS verified
FROM upper_fold f JOIN leaves l ON f.row = l.r, (SELECT h FROM tops WHERE n = 1) t
WHERE f.n = 1
"""

OP12_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT r, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT r, w, least(len(w), 4) AS k, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
common AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.r <> y.r GROUP BY x.r, y.r),
links AS (SELECT a, b FROM common JOIN sizes x ON a = x.r JOIN sizes y ON b = y.r WHERE 100 * c >= 85 * (x.n + y.n - c)),
reached AS (
  SELECT r AS a, r AS b FROM docs
  UNION
  SELECT x.a, l.b FROM reached x JOIN links l ON x.b = l.a)
SELECT d.doc_id, coalesce(any_value(z.n), 0)::BIGINT AS n_shingles, min(e.doc_id) AS component_id
FROM reached x JOIN docs d ON x.a = d.r JOIN docs e ON x.b = e.r LEFT JOIN sizes z ON d.r = z.r
GROUP BY d.r, d.doc_id
"""


def _assigned(vectors: str, centroids: str) -> str:
    return f"""
  SELECT vec, min_by(c, (d, c)) AS cluster, min(d) AS distance FROM (
    SELECT v.vec, m.c, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - m.q[i]) * (v.q[i] - m.q[i])))::BIGINT AS d FROM {vectors} v, {centroids} m)
  GROUP BY vec"""


def _rounds(rounds: int) -> str:
    """Sums of integers are exact; a floor is what is left without the remainder, which is never negative."""
    out = []
    for i in range(rounds):
        out.append(f"near{i} AS ({_assigned('vectors', f'start{i}')})")
        out.append(f"""sums{i} AS (
  SELECT cluster, i, sum(v.q[i]) AS s, count(*) AS n FROM near{i} JOIN vectors v USING (vec), range(1, 65) t(i) GROUP BY cluster, i)""")
        out.append(f"""start{i + 1} AS (
  SELECT c, coalesce(m.q, start{i}.q) AS q FROM start{i} LEFT JOIN (
    SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM sums{i} GROUP BY cluster) m ON c = m.cluster)""")
    return ",\n".join(out)


OP13_SQL = f"""
WITH vectors AS (
  SELECT row_number() OVER () AS vec, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
start0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS c, q FROM vectors ORDER BY c LIMIT 40),
{_rounds(5)},
last AS ({_assigned('vectors', 'start5')}),
per AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM last GROUP BY cluster)
SELECT vec_id, cluster::INT AS cluster, distance, cluster_inertia, (SELECT sum(distance)::BIGINT FROM last) AS inertia,
       sha256(array_to_string(start5.q, ',')) AS centroid_sha256
FROM last JOIN vectors USING (vec) JOIN per USING (cluster) JOIN start5 ON start5.c = cluster
"""
