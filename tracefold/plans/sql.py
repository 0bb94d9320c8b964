"""SQL text of the stored graphs, written independently of the Spark operators.

The edge fold here replays events with window functions; the Spark fold uses
two combinable aggregations.
"""

FACTS = {
    "parts": """
SELECT 'parts' AS region, 'part#' || p_partkey AS subject, f.relation, f.obj, f.ptype,
       CASE WHEN l_returnflag = 'R' THEN 'refute' ELSE 'teach' END AS kind,
       's' || l_suppkey AS source_label, CAST(NULL AS DOUBLE) AS initial_strength,
       'part#' || p_partkey || ' ' || f.relation || ' ' || f.obj AS source_text,
       CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT)
         * 10000000000000 + l_orderkey * 10 + l_linenumber AS seq
FROM lineitem JOIN part ON l_partkey = p_partkey,
LATERAL (SELECT * FROM (VALUES ('has_brand', lower(p_brand), 'brand'),
                               ('has_type', lower(p_type), 'type'),
                               ('has_name', lower(p_name), 'name')) v(relation, obj, ptype)) f
""",
    "market": """
SELECT 'market' AS region, 'customer#' || c_custkey AS subject, 'has_segment' AS relation,
       lower(c_mktsegment) AS obj, 'segment' AS ptype,
       CASE WHEN o_orderstatus = 'F' THEN 'refute' ELSE 'teach' END AS kind,
       lower(o_orderpriority) AS source_label, CAST(NULL AS DOUBLE) AS initial_strength,
       'customer#' || c_custkey || ' has_segment ' || lower(c_mktsegment) AS source_text,
       o_orderkey AS seq
FROM orders JOIN customer ON o_custkey = c_custkey
""",
    "geography": """
SELECT 'geography' AS region, lower(n_name) AS subject, 'has_region' AS relation,
       lower(r_name) AS obj, 'region' AS ptype, 'teach' AS kind,
       CAST(NULL AS VARCHAR) AS source_label, CAST(NULL AS DOUBLE) AS initial_strength,
       lower(n_name) || ' has_region ' || lower(r_name) AS source_text,
       CAST(n_nationkey AS BIGINT) AS seq
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT 'geography', lower(s_name), 'has_nation', lower(n_name), 'nation', 'teach', NULL, NULL,
       lower(s_name) || ' has_nation ' || lower(n_name), s_suppkey + 1000
FROM supplier JOIN nation ON s_nationkey = n_nationkey
""",
}

GRAPH = """
ev AS (
  SELECT region, obj AS src, subject || '_' || ptype AS dst, relation, 'property' AS src_type,
         'relation' AS dst_type, kind, source_label, initial_strength, seq, 0 AS step FROM facts
  UNION ALL
  SELECT region, subject || '_' || ptype, subject, 'describes', 'relation', 'concept', kind,
         source_label, initial_strength, seq, 1 FROM facts
  UNION ALL
  SELECT region, subject, subject || '_refuted', 'refutation_of', 'concept', 'relation', 'link',
         NULL, NULL, seq, 2 FROM facts WHERE kind = 'refute'
  UNION ALL
  SELECT region, subject || '_refuted', 'refuted', 'refutation_status', 'relation', 'property',
         'link', NULL, NULL, seq, 3 FROM facts WHERE kind = 'refute'
  UNION ALL
  SELECT region, unnest(string_split(subject, ' ')), subject, 'part_of', 'property', 'concept',
         'teach', NULL, NULL, seq, 10 FROM facts WHERE contains(subject, ' ')
  UNION ALL
  SELECT region, unnest(string_split(obj, ' ')), obj, 'part_of', 'property', 'property',
         'teach', NULL, NULL, seq, 1000 FROM facts WHERE contains(obj, ' ')
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY region, src, dst, relation ORDER BY seq, step) AS rn,
         row_number() OVER (PARTITION BY region, src, dst, relation, source_label
                            ORDER BY seq, step) AS rs
  FROM ev
),
counted AS (
  SELECT region, src, dst, relation,
         CAST(count(*) FILTER (kind = 'teach' AND rn > 1 AND
              (source_label IS NULL OR (source_label <> '' AND rs = 1))) AS BIGINT) AS traversals,
         CAST(count(*) FILTER (kind = 'refute') AS BIGINT) AS refutations,
         CAST(count(DISTINCT source_label) FILTER (source_label <> '') AS BIGINT) AS witnesses,
         coalesce(max(initial_strength) FILTER (rn = 1), 1.0) AS initial_strength,
         min(seq) AS first_seq, max(seq) AS last_seq
  FROM numbered GROUP BY region, src, dst, relation
),
edges AS (
  SELECT *, CASE WHEN traversals = 0 AND refutations = 0 THEN initial_strength
                 ELSE 1 + ln(1 + traversals) - ln(1 + refutations) END AS strength
  FROM counted
),
nodes AS (
  SELECT region, label, arg_min(typ, (seq, ord)) AS node_type FROM (
    SELECT region, src AS label, src_type AS typ, seq, step * 2 AS ord FROM ev
    UNION ALL SELECT region, dst, dst_type, seq, step * 2 + 1 FROM ev)
  GROUP BY region, label
),
pair AS (SELECT region, src, dst, max(strength) AS s FROM edges WHERE src <> dst GROUP BY ALL),
paths AS (
  SELECT region, seq, 0 AS part, obj AS origin, subject || '_' || ptype AS mid,
         subject AS terminus, relation, 'describes' AS rel2, source_text FROM facts
  UNION ALL
  SELECT region, seq, 1, subject, subject || '_refuted', 'refuted', 'refutation_of',
         'refutation_status', source_text FROM facts WHERE kind = 'refute'
),
weighed AS (
  SELECT p.*, (a.strength + b.strength) / 2 AS weight, least(a.strength, b.strength) AS weakest
  FROM paths p
  JOIN edges a ON a.region = p.region AND a.src = p.origin AND a.dst = p.mid
              AND a.relation = p.relation
  JOIN edges b ON b.region = p.region AND b.src = p.mid AND b.dst = p.terminus
              AND b.relation = p.rel2
)"""


def with_graph(name: str, body: str, extra: str = "") -> str:
    """``body`` over the graph tables facts, ev, edges, nodes, pair, paths, weighed."""
    return f"WITH facts AS ({FACTS[name]}),{GRAPH}{extra}\n{body}"


def forward_wave(seed_sql: str, min_strength: float = 0.5) -> str:
    """CTEs w0..w3 and wave(seed, node, hops, path, weight): a depth-3 forward wave.

    Each level ranks its nodes per seed by (parent rank, strength, label), as a
    queue would.
    """
    out = f""",
w0 AS (SELECT DISTINCT region, seed, seed AS node, 0 AS hops, CAST(1 AS BIGINT) AS rnk,
              [seed] AS path, 0.0 AS ws, 0 AS wn FROM ({seed_sql}))"""
    for hop in (1, 2, 3):
        seen = " UNION ALL ".join(f"SELECT region, seed, node FROM w{i}" for i in range(hop))
        out += f""",
c{hop} AS (
  SELECT w.region, w.seed, p.dst AS node, w.rnk AS prank, round(-p.s, 9) AS o,
         list_append(w.path, p.dst) AS path, w.ws + p.s AS ws, w.wn + 1 AS wn
  FROM w{hop - 1} w JOIN pair p ON p.region = w.region AND p.src = w.node AND p.s >= {min_strength}
  WHERE NOT EXISTS (SELECT 1 FROM ({seen}) z
                    WHERE z.region = w.region AND z.seed = w.seed AND z.node = p.dst)),
f{hop} AS (SELECT *, row_number() OVER (PARTITION BY region, seed, node
                                        ORDER BY prank, o) AS k FROM c{hop}),
w{hop} AS (SELECT region, seed, node, {hop} AS hops,
                  row_number() OVER (PARTITION BY region, seed ORDER BY prank, o, node) AS rnk,
                  path, ws, wn FROM f{hop} WHERE k = 1)"""
    out += """,
wave AS (SELECT region, seed, node, hops, path, ws / wn AS weight FROM w1
         UNION ALL SELECT region, seed, node, hops, path, ws / wn FROM w2
         UNION ALL SELECT region, seed, node, hops, path, ws / wn FROM w3)"""
    return out


def both_wave(seed_sql: str, min_strength: float = 0.5, tag: str = "") -> str:
    """CTEs ending in wave{tag}: the depth-3 wave that follows edges both ways."""
    out = f""",
adj{tag} AS (
  SELECT region, node, nxt, CASE WHEN max(f) >= {min_strength} THEN 0 ELSE 1 END AS dir,
         round(-CASE WHEN max(f) >= {min_strength} THEN max(f) ELSE max(b) END, 9) AS o,
         max(f) AS f
  FROM (SELECT region, src AS node, dst AS nxt, s AS f, CAST(NULL AS DOUBLE) AS b FROM pair
        UNION ALL SELECT region, dst, src, NULL, s FROM pair)
  GROUP BY region, node, nxt HAVING max(f) >= {min_strength} OR max(b) >= {min_strength}),
w0{tag} AS (SELECT DISTINCT region, seed, seed AS node, CAST(1 AS BIGINT) AS rnk, [seed] AS path,
                   0.0 AS ws, 0 AS wn FROM ({seed_sql}))"""
    for hop in (1, 2, 3):
        seen = " UNION ALL ".join(f"SELECT region, seed, node FROM w{i}{tag}" for i in range(hop))
        out += f""",
c{hop}{tag} AS (
  SELECT w.region, w.seed, a.nxt AS node, w.rnk AS prank, a.dir, a.o,
         list_append(w.path, a.nxt) AS path, w.ws + coalesce(a.f, 0) AS ws,
         w.wn + CASE WHEN a.f IS NULL THEN 0 ELSE 1 END AS wn
  FROM w{hop - 1}{tag} w JOIN adj{tag} a ON a.region = w.region AND a.node = w.node
  WHERE NOT EXISTS (SELECT 1 FROM ({seen}) z
                    WHERE z.region = w.region AND z.seed = w.seed AND z.node = a.nxt)),
f{hop}{tag} AS (SELECT *, row_number() OVER (PARTITION BY region, seed, node
                                             ORDER BY prank, dir, o) AS k FROM c{hop}{tag}),
w{hop}{tag} AS (SELECT region, seed, node, row_number() OVER (
                  PARTITION BY region, seed ORDER BY prank, dir, o, node) AS rnk, path, ws, wn
                FROM f{hop}{tag} WHERE k = 1)"""
    levels = " UNION ALL ".join(
        f"SELECT region, seed, node, {h} AS hops, path, CASE WHEN wn > 0 THEN ws / wn ELSE 0 END "
        f"AS weight FROM w{h}{tag}" for h in (1, 2, 3))
    return out + f", wave{tag} AS ({levels})"


def _inflect_sql(x):
    """(pos, variant) pairs of the inflections of x, in lookup order."""
    return f"""[
  {{'p': 0, 'v': {x} || 's'}}, {{'p': 1, 'v': {x} || 'es'}}, {{'p': 2, 'v': {x} || 'ian'}},
  {{'p': 3, 'v': {x} || 'ians'}}, {{'p': 4, 'v': {x} || 'an'}},
  {{'p': 5, 'v': CASE WHEN {x} LIKE '%ians' THEN left({x}, -4) WHEN {x} LIKE '%ian' THEN left({x}, -3)
     WHEN {x} LIKE '%ans' THEN left({x}, -3) WHEN {x} LIKE '%an' THEN left({x}, -2) END}},
  {{'p': 6, 'v': CASE WHEN {x} LIKE '%ians' THEN left({x}, -1) WHEN {x} LIKE '%ian' THEN {x} || 's'
     WHEN {x} LIKE '%ans' THEN left({x}, -1) END}},
  {{'p': 7, 'v': CASE WHEN {x} LIKE '%ies' THEN left({x}, -3) || 'y' WHEN {x} LIKE '%es'
     THEN left({x}, -2) WHEN {x} LIKE '%s' AND {x} NOT LIKE '%ss' THEN left({x}, -1) END}}]"""


def _one_byte(x: str) -> str:
    """The engine counts edits in bytes.  Where terms or labels are plain letters, any other
    character of the other side is as far from them as one mark."""
    return f"regexp_replace({x}, '[^\\x00-\\x7f]', '~', 'g')"


RESOLVE_SQL = f""",
lab AS (SELECT DISTINCT label FROM nodes),
r1 AS (SELECT term, term AS label, 0 AS distance, 'exact' AS method, 1 AS rank FROM terms
       WHERE term IN (SELECT label FROM lab)),
left1 AS (SELECT term FROM terms WHERE term NOT IN (SELECT term FROM r1)),
r2 AS (SELECT term, v.v AS label, 0 AS distance, 'inflect' AS method,
              row_number() OVER (PARTITION BY term ORDER BY min(v.p)) AS rank
       FROM (SELECT term, unnest({_inflect_sql('term')}) AS v FROM left1)
       WHERE v.v IN (SELECT label FROM lab) GROUP BY term, v.v),
left2 AS (SELECT term FROM left1 WHERE term NOT IN (SELECT term FROM r2)),
r3 AS (SELECT term, label, 0 AS distance, 'prefix' AS method,
              row_number() OVER (PARTITION BY term ORDER BY length(label), label) AS rank
       FROM left2 JOIN lab ON starts_with(label, term)),
left3 AS (SELECT term FROM left2 WHERE term NOT IN (SELECT term FROM r3)),
r4 AS (SELECT term, label, 0 AS distance, 'contains' AS method,
              row_number() OVER (PARTITION BY term ORDER BY length(label), label) AS rank
       FROM left3 JOIN lab ON contains(label, term)),
left4 AS (SELECT term, {_one_byte('term')} AS t, greatest(2, length(term) // 3) AS k FROM left3
          WHERE term NOT IN (SELECT term FROM r4)),
forms AS (SELECT label, p, {_one_byte('v')} AS v FROM (
          SELECT label, -1 AS p, label AS v FROM lab UNION ALL
          SELECT label, f.p, f.v FROM (SELECT label, unnest({_inflect_sql('label')}) AS f FROM lab)
          WHERE f.v IS NOT NULL)),
near AS (SELECT term, label, p, levenshtein(t, v) AS d, k FROM left4 JOIN forms
         ON abs(length(t) - length(v)) <= k),
r5 AS (SELECT term, label, d AS distance, 'fuzzy' AS method, row_number() OVER (
         PARTITION BY term ORDER BY d, abs(length(term) - length(label)), label) AS rank
       FROM (SELECT term, label, arg_min(d, p) AS d FROM near WHERE d <= k GROUP BY term, label)),
resolved AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2
  UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4 UNION ALL SELECT * FROM r5)"""
