"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others are tested against brute force in ``tests/llm``: token counts (a
Viterbi path), personal data (match offsets, EM), sharding (CRC-32, seeded
shuffle), tool calls (JSON schemas), context-tree weighting, resampling,
tokenizer alignment and token files (public tokenizer libraries).
"""

from __future__ import annotations

UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
BLANK_WORD = r"'[^\x20\x09-\x0D]+'"
TERM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP1 = f"""
WITH d0 AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {BLANK_WORD}))::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents),
d AS (SELECT *, CASE WHEN size > 0 THEN row_number() OVER (PARTITION BY doc_id, source, digest) - 1 ELSE 0 END AS number FROM d0),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [5::DOUBLE, 2::DOUBLE, 1::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
  source_size * 3::DOUBLE AS most FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE
  - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
  / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(most, max(level) OVER () * weight) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(3::DOUBLE, target / source_size) ELSE 0::DOUBLE END AS rate FROM t),
c AS (SELECT d.doc_id, d.size, r.source_size, r.target, (floor(rate) + CASE WHEN
  ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || d.number || ':' || d.digest), 1, 13))::BIGINT / 4503599627370496::DOUBLE < rate - floor(rate)
  THEN 1 ELSE 0 END)::BIGINT AS copies FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id::BIGINT AS doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM c"""

OP4 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), {TERM}) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), {TERM}) AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.phrase = iw.phrase AND dw.n = iw.n),
hits AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id::BIGINT AS doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP6 = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row AS q_row, q.vec_id AS query_id, c.vec_id, c.row, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.row <> c.row AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q_row ORDER BY score DESC, vec_id NULLS LAST, row) AS rank FROM s)
SELECT query_id::BIGINT AS query_id, rank::INTEGER AS rank, vec_id::BIGINT AS vec_id, score FROM r WHERE rank <= 5"""

OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), {BLANK_WORD}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id::BIGINT AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id::BIGINT AS component_id,
  c.component_id = d.doc_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

OP12 = """
WITH own AS (SELECT conv_id::BIGINT AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos,
  md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
  length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT DISTINCT c, flatten(list_transform(string_split(c::VARCHAR, ''),
  lambda ch: list_transform(range(8), lambda i: (ascii(ch) >> i) & 1))) AS b FROM own),
h AS (SELECT c, c - c % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda crc, bit:
  xor(crc >> 1, CASE WHEN (xor(crc, bit) & 1) = 1 THEN 3988292384 ELSE 0 END)), 4294967295::BIGINT) % 6 AS h FROM bits),
rebuilt AS (SELECT h.c, o.pos, 0 AS own, o.k, o.chars FROM h JOIN own o ON o.c = h.base AND o.pos < h.h
  UNION ALL SELECT h.c, o.pos, 1, o.k, o.chars FROM h JOIN own o ON o.c = h.c AND o.pos >= h.h),
turn AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS depth, k, chars FROM rebuilt),
path AS (SELECT c, depth, chars, string_agg(k, '') OVER (PARTITION BY c ORDER BY depth) AS p FROM turn
  UNION ALL SELECT c, 0, 0, '' FROM h),
lengths AS (SELECT c, max(depth) AS n FROM path GROUP BY c),
node AS (SELECT p, depth, any_value(chars) AS chars, min(c) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM path JOIN lengths USING (c) GROUP BY p, depth),
kids AS (SELECT left(p, length(p) - 32) AS p, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
worth AS (SELECT a.*, (a.n_convs - 1) * a.chars AS saved, coalesce(n_children, 0) AS n_children FROM node a LEFT JOIN kids USING (p)),
under AS (SELECT up.p, sum(w.saved) AS saved_tokens, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves
  FROM worth w JOIN path up ON up.c = w.conv_id AND up.depth <= w.depth GROUP BY up.p)
SELECT w.conv_id, w.depth::BIGINT AS depth, above.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs,
  w.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM worth w JOIN under USING (p) LEFT JOIN worth above ON w.depth > 0 AND above.p = left(w.p, length(w.p) - 32)"""

ORACLE_SQL: dict[str, str] = {"op1_mixing": OP1, "op4_decontaminate": OP4, "op6_topk": OP6, "op7_neardup": OP7,
                              "op12_prefix_trie": OP12}
