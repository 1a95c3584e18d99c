"""DuckDB SQL for the operators that SQL can express, written on its own terms."""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
-- rows alike in id, source and size are interchangeable: every 1000 of them have an order of their own
dealt AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id, source, size) - 1) // 1000 AS batch FROM sized),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS w,
    sum(source_size) OVER ()::DOUBLE AS total FROM src),
capped AS (
  SELECT *, 3.0 * source_size / w AS level,
    coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS caps_before,
    sum(w) OVER (ORDER BY 3.0 * source_size / w, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS w_from
  FROM weighed),
cut AS (
  SELECT total - caps_before AS rest, w_from FROM capped WHERE (total - caps_before) / w_from <= level ORDER BY level LIMIT 1),
goal AS (
  SELECT source, source_size,
    CASE WHEN coalesce((SELECT rest / w_from FROM cut), 1e300) > level THEN 3.0 * source_size
         ELSE (SELECT rest FROM cut) * w / (SELECT w_from FROM cut) END::DOUBLE AS target
  FROM capped),
line AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, least(floor(g.target + 0.5)::BIGINT, 3 * g.source_size) AS take,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY
      ('0x' || substr(md5(concat(coalesce(s.doc_id::VARCHAR, ''), '-', s.size::VARCHAR, if(s.batch > 0, '-' || s.batch, ''))), 1, 15))::BIGINT, s.doc_id NULLS FIRST, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS stop
  FROM dealt s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0
       ELSE (take // source_size) * size + greatest(0, least(size, take % source_size - (stop - size))) END::BIGINT AS taken
FROM line
"""

TOP_K = r"""
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter([x IS NOT NULL AND isfinite(x) FOR x IN embedding], lambda ok: NOT ok)) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

NGRAM_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS g FROM words),
sizes AS (SELECT doc_id, len(g)::BIGINT AS n FROM grams),
post AS (SELECT doc_id, unnest(g) AS t FROM grams),
inter AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM post a JOIN post b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM inter JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 90 * (p.n + q.n - o)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (
  SELECT DISTINCT x AS doc_id, x AS other FROM both_ways
  UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON r.other = b.x),
low AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, s.n AS n_shingles, coalesce(low.component_id, s.doc_id) AS component_id
FROM sizes s LEFT JOIN low USING (doc_id)
"""

SPELLING = r"""
WITH RECURSIVE crc_table AS (  -- crc32, a byte at a time
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z:
    CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents WHERE text IS NOT NULL),
per_doc AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      [('0x' || substr(x, 2 * i + 1, 2))::BIGINT FOR i IN range(len(x) // 2)]),
    lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)])))::BIGINT AS h
  FROM per_doc, crc_table),
typed AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, n
  FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(len(word))) AS i FROM v)),
pairs AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, v.word FROM cut c JOIN v ON c.rest = v.word
  UNION SELECT v.word, c.word FROM cut c JOIN v ON c.rest = v.word),
best AS (
  SELECT p.word, count(*) AS n_near, arg_min(p.other, (-o.n, p.other)) AS other, max(o.n) AS other_n
  FROM pairs p JOIN v o ON p.other = o.word GROUP BY p.word),
formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN other_n >= 2 * v.n THEN other END AS form, CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n
  FROM v LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS at, form AS next FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON c.next = f.word)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""

LINE_DEDUP = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key FROM k WHERE len(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
marked AS (SELECT r, i, line, key IN (SELECT key FROM common) AS gone FROM k),
kept AS (
  SELECT r, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept.text) AS kept_sha256 FROM d JOIN kept USING (r)
"""

LEXICAL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
whole AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), whole),
q AS (
  SELECT i, item_id, unnest(list_distinct(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM (SELECT row_number() OVER () AS i, * FROM benchmark WHERE text IS NOT NULL)),
scored AS (
  SELECT i, item_id, d.doc_id, d.r,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * len(d.terms) * docs) // total)))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN d ON d.r = tf.r, whole GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
