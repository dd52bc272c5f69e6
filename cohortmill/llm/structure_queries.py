"""Queries of near duplicates, the conversation trie and vector codes."""

from __future__ import annotations

from .minmax import near_copies
from .part_codes import part_codes
from .registry import query, table
from .turn_trie import prefix_trie

_COPIES_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) c ON s.doc_id = c.doc_id"""

_TRIE_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
bytes AS (SELECT DISTINCT c, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT) AS b FROM t),
convs AS (
  SELECT c, c - c % 20 AS base, xor(list_reduce([4294967295] || b, lambda crc, x: list_reduce(
    [xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % 4 AS h FROM bytes),
parts AS (
  SELECT v.c, 0 AS part, t.pos, t.role, t.text FROM convs v JOIN t ON t.c = v.base AND t.pos <= v.h
  UNION ALL SELECT v.c, 1, t.pos, t.role, t.text FROM convs v JOIN t ON t.c = v.c AND t.pos > v.h),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, role, text FROM parts),
paths AS (SELECT c, list({'role': role, 'text': text} ORDER BY d) AS path FROM r GROUP BY c),
seqs AS (SELECT v.c, d.d, coalesce(p.path, [])[1:d.d] AS path, len(coalesce(p.path, [])) = d.d AS ends
         FROM convs v LEFT JOIN paths p ON v.c = p.c, LATERAL (SELECT unnest(range(0, len(coalesce(p.path, [])) + 1)) AS d) d),
nodes AS (SELECT d, path, min(c) AS conv_id, count(*) AS n_convs,
            sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM seqs GROUP BY d, path),
named AS (SELECT s.c, s.d, n.conv_id FROM seqs s JOIN nodes n ON s.d = n.d AND s.path = n.path),
linked AS (SELECT n.*, p.conv_id AS parent FROM nodes n LEFT JOIN named p ON p.c = n.conv_id AND p.d = n.d - 1),
children AS (SELECT parent, d - 1 AS d, count(*) AS n FROM linked WHERE d > 0 GROUP BY ALL),
valued AS (SELECT l.*, coalesce(k.n, 0) AS n_children,
             CASE WHEN l.d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(path[len(path)].text, '[^\x20\x09-\x0D]+')) END AS gain
           FROM linked l LEFT JOIN children k ON k.parent = l.conv_id AND k.d = l.d),
sums AS (SELECT a.conv_id, a.d, sum((v.n_children = 0)::INT) AS n_leaves, sum(v.gain) AS saved
         FROM valued v JOIN named a ON a.c = v.conv_id AND a.d <= v.d GROUP BY a.conv_id, a.d)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, v.parent AS parent_conv_id, CAST(v.n_convs AS BIGINT) AS n_convs,
  CAST(v.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM valued v JOIN sums s ON s.conv_id = v.conv_id AND s.d = v.d"""


def _codes_sql(rounds: int = 2) -> str:
    nearest = """a{k} AS (SELECT vec_id, p, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM (
    SELECT v.vec_id, v.p, b.e, sum((v.x - b.x) * (v.x - b.x)) AS dist FROM v JOIN b{k} b ON v.p = b.p AND v.j = b.j GROUP BY ALL) GROUP BY vec_id, p)"""
    moved = """m{k} AS (SELECT v.p, a.e, v.j, sum(v.x) AS s, count(*) AS n FROM v JOIN a{k} a USING (vec_id, p) GROUP BY ALL),
b{next} AS (SELECT b.p, b.e, b.j, CASE WHEN m.n IS NULL THEN b.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS x
  FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.e = m.e AND b.j = m.j)"""
    steps = [x.format(k=k, next=k + 1) for k in range(rounds) for x in (nearest, moved)] + [nearest.format(k=rounds)]
    return f"""
WITH k AS (SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, len(embedding) AS n, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS x FROM k),
v AS (SELECT vec_id, i // (n // 16) AS p, i % (n // 16) AS j, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM c),
b0 AS (SELECT v.p, f.e, v.j, v.x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT 64) f USING (vec_id)),
{', '.join(steps)},
found AS (SELECT k.vec_id, k.label, string_agg(lower(printf('%02x', a.e)), '' ORDER BY a.p) AS code, CAST(sum(a.dist) AS BIGINT) AS error
  FROM k JOIN a{rounds} a USING (vec_id) GROUP BY k.vec_id, k.label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) FROM b{rounds}) AS codebooks_sha256 FROM found"""


@query("op11_minmax_near_copies", _COPIES_SQL)
def op11_minmax_near_copies(spark, sf_dir):
    return near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op12_conversation_trie", _TRIE_SQL)
def op12_conversation_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


@query("op13_vector_codes", _codes_sql())
def op13_vector_codes(spark, sf_dir):
    return part_codes(table(spark, sf_dir, "embeddings"))
