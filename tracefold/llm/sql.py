"""SQL that states the results of the queries, for a second engine."""

NEAR_SQL = """
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM {docs}),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {width} + 2),
         lambda i: array_to_string(w[i:i + {width} - 1], ' '))) END AS s
  FROM worded),
one AS (SELECT min(doc_id) AS doc_id, s FROM (SELECT doc_id, list_sort(s) AS s FROM shingled) GROUP BY s),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM one),
linked AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM one UNION
  SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
named AS (SELECT a, min(b) AS component FROM reach GROUP BY a),
component_of AS (SELECT o.s, n.component FROM one o JOIN named n ON o.doc_id = n.a)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles,
       CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE c.component END AS component_id,
       CASE WHEN len(d.s) = 0 THEN true ELSE d.doc_id = c.component END AS kept
FROM shingled d JOIN component_of c ON list_sort(d.s) = c.s"""

CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, len(text) + len(regexp_extract_all(text, '[<\[]\\*/?(s>|(SYS|INST|OUT|ROLE)\])'))
    + CASE role WHEN 'system' THEN 20 WHEN 'assistant' THEN 20 WHEN 'user' THEN 22
      ELSE 23 + len(role) END AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

LEAK_SQL = r"""
WITH item AS (
  SELECT item_id, trim(max(text), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
  FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id),
iw AS (SELECT item_id, t, regexp_extract_all(lower(t), '[\p{L}\p{N}_]+') AS w FROM item),
parts AS (
  SELECT item_id, p, w[p * len(w) // n + 1 : (p + 1) * len(w) // n] AS part FROM (
    SELECT item_id, w, n, unnest(range(0, n)) AS p FROM (
      SELECT item_id, w, greatest(1, CAST(ceil(len(w) / 48.0) AS BIGINT)) AS n FROM iw) x) y),
terms AS (
  SELECT item_id, p, word, count(*) AS tf, any_value(n) AS n FROM (
    SELECT item_id, p, len(part) AS n, unnest(part) AS word FROM parts) x GROUP BY item_id, p, word),
stats AS (SELECT count(*) AS pieces, avg(n) AS mean FROM (SELECT DISTINCT item_id, p, n FROM terms)),
df AS (SELECT word, count(*) AS df FROM terms GROUP BY word),
raw AS (
  SELECT item_id, p, word, ln(1 + (pieces - df + 0.5) / (df + 0.5)) * tf * 2.2
         / (tf + 1.2 * (0.25 + 0.75 * n / mean)) AS r FROM terms JOIN df USING (word), stats),
impacts AS (SELECT item_id, p, word, r / sum(r) OVER (PARTITION BY item_id, p) AS impact FROM raw),
dw AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
placed AS (SELECT doc_id, (i - 1) // 64 AS half, w[i] AS word FROM (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw)),
passages AS (
  SELECT DISTINCT doc_id, unnest([half, half - 1]) AS passage, word FROM placed
  WHERE word IN (SELECT word FROM df)),
scored AS (
  SELECT doc_id, item_id, sum(impact) AS score FROM passages JOIN impacts USING (word)
  GROUP BY doc_id, passage, item_id, p HAVING sum(impact) >= 0.6 - 1e-12),
found AS (SELECT doc_id, item_id, max(score) AS score FROM scored GROUP BY doc_id, item_id),
cut AS (
  SELECT item_id, t, list_max(list_filter(range(1, len(t)), lambda e:
    regexp_matches(substr(t, 1, e), '([.!?:]\s+|\n)$') AND regexp_matches(substr(t, 1, e), '[\p{L}\p{N}_]')
    AND regexp_matches(substr(t, e + 1), '[\p{L}\p{N}_]'))) AS e FROM iw),
halves AS (
  SELECT item_id, regexp_extract_all(lower(CASE WHEN e IS NULL THEN t ELSE substr(t, 1, e) END), '[\p{L}\p{N}_]+') AS q,
    list_distinct(regexp_extract_all(lower(CASE WHEN e IS NULL THEN t ELSE substr(t, e + 1) END), '[\p{L}\p{N}_]+')) AS a
  FROM cut),
runs AS (
  SELECT f.doc_id, f.item_id, f.score, h.a, d.w, least(3, len(h.q)) AS n,
    list_distinct(list_transform(range(1, len(h.q) - least(3, len(h.q)) + 2),
      lambda i: array_to_string(h.q[i : i + least(3, len(h.q)) - 1], ' '))) AS asked
  FROM found f JOIN halves h USING (item_id) JOIN dw d USING (doc_id)),
shares AS (
  SELECT doc_id, item_id, score, len(list_intersect(a, w)) / len(a) AS ao,
    len(list_intersect(asked, list_transform(range(1, len(w) - n + 2),
      lambda i: array_to_string(w[i : i + n - 1], ' ')))) / len(asked) AS qo FROM runs)
SELECT doc_id, item_id, round(score, 4) AS score, round(qo, 4) AS question_overlap,
       round(ao, 4) AS answer_overlap FROM shares WHERE qo >= 0.5 AND ao >= 0.5"""

#: CRC-32 for engines without it.  Common tables: crc_table has one row whose list t holds the remainders of the 256 byte values.
CRC_TABLE = """crc_step AS (
  SELECT n, n AS v, 0 AS k FROM range(256) r(n)
  UNION ALL
  SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY n) AS t FROM crc_step WHERE k = 8)"""


def crc32_sql(text: str, table: str = "t") -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of an SQL text."""
    bytes_ = (f"list_transform(range(0, octet_length(encode({text}))), "
              f"lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))")
    return (f"xor(list_reduce(list_concat([4294967295], {bytes_}), "
            f"lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)")


VARIANT_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''),
    '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
distinct_runs AS (SELECT id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY id, run),
hashed AS (SELECT run, c, {crc32_sql("id || ':' || run")} AS h FROM distinct_runs, crc_table),
typed AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER))
    || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, c FROM hashed),
words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(c) > 1),
cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT c.word, c.n, w.word AS less, w.n AS less_n FROM cut c JOIN words w ON c.rest = w.word),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, less, less_n FROM shorter
  UNION SELECT less, word, n FROM shorter),
best AS (SELECT word, count(*) AS n_near FROM near GROUP BY word),
first AS (
  SELECT word, near AS top, near_n AS top_n FROM (
    SELECT word, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM near) WHERE r = 1),
formed AS (
  SELECT w.word, w.n, CASE WHEN f.top_n >= 10 * w.n THEN f.top END AS form,
    CASE WHEN f.top_n >= 10 * w.n THEN f.top_n END AS form_n, coalesce(b.n_near, 0) AS n_near
  FROM words w LEFT JOIN first f USING (word) LEFT JOIN best b USING (word)),
walk AS (
  SELECT word, word AS at, form AS onward FROM formed
  UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN formed f ON w.onward = f.word)
SELECT f.word, f.n, f.form, f.form_n, CAST(f.n_near AS BIGINT) AS n_near, w.at AS root
FROM formed f JOIN walk w ON f.word = w.word AND w.onward IS NULL"""

TRIE_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
rebuilt AS (
  SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
  UNION ALL
  SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h),
paths AS (
  SELECT c.conv_id, coalesce(string_agg(sha256(length(r.role) || ':' || r.role || r.text), '' ORDER BY r.pos), '') AS path,
    list(length(r.text) ORDER BY r.pos) AS chars, count(r.pos) AS depth
  FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
members AS (SELECT conv_id, path, chars, depth, unnest(range(0, depth + 1)) AS d FROM paths),
nodes AS (
  SELECT substr(path, 1, 64 * d) AS node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    max(CASE WHEN d > 0 THEN chars[d] ELSE 0 END) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = depth), '')) AS ends_sha256
  FROM members GROUP BY 1, 2),
children AS (SELECT substr(node, 1, 64 * (d - 1)) AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
below AS (
  SELECT substr(node, 1, 64 * k) AS node, sum(leaf) AS n_leaves, sum(saved) AS saved FROM (
    SELECT n.node, unnest(range(0, n.d + 1)) AS k, CASE WHEN c.n IS NULL THEN 1 ELSE 0 END AS leaf,
      (n.n_convs - 1) * n.chars AS saved
    FROM nodes n LEFT JOIN children c USING (node)) GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
  CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (node) LEFT JOIN children c USING (node)
LEFT JOIN nodes p ON n.d > 0 AND p.node = substr(n.node, 1, 64 * (n.d - 1))"""

VECTOR_SQL = """
WITH RECURSIVE sound AS (
  SELECT row_number() OVER () AS k, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS (
  SELECT a.k, a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
    ON a.k <> b.k AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
counted AS (SELECT k, count(*) AS n FROM linked GROUP BY k),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM sound UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a),
named AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT s.vec_id, coalesce(c.n, 0) AS n_links, n.component AS component_id, s.vec_id = n.component AS kept
FROM sound s LEFT JOIN counted c USING (k) JOIN named n ON n.a = s.vec_id
UNION ALL
SELECT vec_id, 0, vec_id, true FROM embeddings
WHERE vec_id IS NULL OR embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0
  OR len(list_filter(embedding, lambda x: x <> 0)) = 0"""
