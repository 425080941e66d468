"""DuckDB SQL for those of the registered queries that SQL can express on small tables."""

from __future__ import annotations

_BITS = "0000000100100011010001010110011110001001101010111100110111101111"  # the 16 nibbles
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

OP1 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('{_BITS}', 4 * (position(substr(hex, i::BIGINT, 1) IN '0123456789abcdef') - 1) + 1, 4)), '') AS bits FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}', 1 + list_sum(list_transform(range(1, 6), lambda j: substr(bits, (5 * i + j)::BIGINT, 1)::INT * (1 << (5 - j)::INT)))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b"""

OP3 = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(0, 2) r(i)),
s AS (SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before, lead(role) OVER w AS after,
  length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) AS chars,
  length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;')) AS role_chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars + CASE WHEN before IS NOT DISTINCT FROM role THEN 10 ELSE 13 + role_chars END + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 ELSE 11 END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id"""

OP4 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach(doc_id, other) AS (SELECT a, b FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
low AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low.low, d.doc_id)) AS component_id, d.doc_id <= coalesce(low.low, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)"""

_VECTORS = "(SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"

OP7 = f"""
WITH w AS (SELECT vec_id, list_transform(v, lambda x: floor(256 * x)) AS v FROM {_VECTORS}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM w q JOIN w c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""

OP9 = f"""
WITH RECURSIVE w AS (SELECT vec_id, v, list_dot_product(v, v) AS square FROM {_VECTORS}),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM w a JOIN w b ON a.vec_id <> b.vec_id AND a.square > 0 AND b.square > 0 WHERE list_dot_product(a.v, b.v) / (sqrt(a.square) * sqrt(b.square)) >= 0.95),
reach(vec_id, other) AS (SELECT a, b FROM links UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other),
low AS (SELECT vec_id, min(other) AS low FROM reach GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(low.low, e.vec_id)) AS component_id, e.vec_id <= coalesce(low.low, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN low USING (vec_id)"""

# The table of the checksum comes from its rule: eight steps of division by the polynomial for each byte.
OP12 = r"""
WITH t AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(list_concat([b], range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
e AS (SELECT doc_id, unnest(w) AS w FROM d),
n AS (SELECT w, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM (SELECT w, 1 AS s, 0 AS t FROM e UNION ALL SELECT w, 0, 1 FROM b) GROUP BY w),
h AS (SELECT w, s, t, hex(encode(w)) AS hex FROM n),
y AS (SELECT w, s, t, list_transform(range(0, length(hex) // 2), lambda i: (16 * (position(substr(hex, 2 * i + 1, 1) IN '0123456789ABCDEF') - 1) + position(substr(hex, 2 * i + 2, 1) IN '0123456789ABCDEF') - 1)::BIGINT) AS bytes FROM h),
f AS (SELECT w, s, t, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1])), 4294967295) % 10000 AS bucket FROM y, t),
g AS (SELECT bucket, floor(1000 * ln(((sum(t)::DOUBLE + 1) * ((SELECT sum(s) FROM n)::DOUBLE + 10000)) / ((sum(s)::DOUBLE + 1) * ((SELECT sum(t) FROM n)::DOUBLE + 10000))))::BIGINT AS gain FROM f GROUP BY bucket),
a AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM e JOIN f USING (w) JOIN g USING (bucket) GROUP BY doc_id),
r AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((list_reduce(list_concat([0::BIGINT], list_transform(range(1, 9), lambda i: (position(substr(sha256('2024:' || doc_id), i, 1) IN '0123456789abcdef') - 1)::BIGINT)), lambda c, x: c * 16 + x) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN a USING (doc_id)),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM r WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM r LEFT JOIN k USING (doc_id)"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT i, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM e GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM e SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS all_n FROM kept GROUP BY lang),
size AS (SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT + any_value(v) AS whole FROM groups JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // whole AS p FROM size s JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::HUGEINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
q AS (SELECT lang, term, 1 + 1000000000 * (n + 1) // (all_n + v) AS q FROM kept JOIN v USING (lang)),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM every
UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms) WHERE rank <= 200"""
