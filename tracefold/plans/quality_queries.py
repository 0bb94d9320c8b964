"""Queries for label quality, resolution, grounding and answering."""

from pyspark.sql import functions as F

from ..functions import fixed, statements
from ..functions.strings import strip as strip_col
from ..operators import (answers, coverage, evidence, grounding, lookup, matching, observe,
                         quality, resolve, waves)
from ..sources import tables
from .catalog import query
from .graph_queries import blend_sql
from .graphs import graph, label_index
from .sql import RESOLVE_SQL, forward_wave, with_graph
from .sql_text import (SENTENCES, content_words, parse_ctes, quoted, sentences, strip, strip_punct,
                       with_documents, words)
from .text_queries import AS_OF, markup

COUNTS_SQL = """,
ends AS (SELECT origin AS label, source_text FROM paths
         UNION ALL SELECT terminus, source_text FROM paths),
counts AS (SELECT label, CAST(count(*) AS BIGINT) AS paths,
             CAST(count(*) FILTER (source_text IS NOT NULL AND source_text <> ''
                  AND NOT starts_with(source_text, '[cleanup]')) AS BIGINT) AS actionable
           FROM ends GROUP BY label)"""


@query("path_counts", with_documents("SELECT * FROM counts", COUNTS_SQL))
def path_counts(spark, sf_dir):
    return quality.path_counts(graph(spark, sf_dir, "documents", "paths")).drop("region")


_POLLUTION = COUNTS_SQL + f""",
kinds AS (
  SELECT label, unnest(list_filter([
    CASE WHEN l IN ({quoted(fixed.ARTICLES)}) THEN 'article' END,
    CASE WHEN l IN ({quoted(fixed.ARTICLE_TYPOS)}) THEN 'article_typo' END,
    CASE WHEN l IN ({quoted(fixed.PRONOUNS)}) THEN 'pronoun' END,
    CASE WHEN l IN ({quoted(fixed.QUESTION_WORD_TYPOS)}) THEN 'question_word_typo' END,
    CASE WHEN l IN ({quoted(fixed.STOPWORD_SUBJECTS)}) THEN 'stopword_subject' END,
    CASE WHEN len({words('l')}) >= 7 THEN 'sentence_subject' END,
    CASE WHEN regexp_matches(l, '[.,:;!?]$') THEN 'punctuation_artifact' END],
    lambda q: q IS NOT NULL)) AS kind
  FROM (SELECT label, {strip('label')} AS l FROM nodes)),
polluted AS (SELECT label, kind, actionable AS path_count FROM kinds JOIN counts USING (label)
             WHERE actionable > 0)"""


def _pollution(spark, sf_dir):
    return quality.detect_pollution(*graph(spark, sf_dir, "documents", "nodes", "edges", "paths"))


@query("detect_pollution", with_documents("SELECT * FROM polluted", _POLLUTION))
def detect_pollution(spark, sf_dir):
    return _pollution(spark, sf_dir).drop("region")


REVIEWED = ["article_typo", "pronoun", "question_word_typo", "stopword_subject"]


@query("review_candidates", with_documents(f"""
SELECT label, kind, path_count, min(source_text) AS example FROM polluted JOIN ends USING (label)
WHERE kind IN ({quoted(REVIEWED)}) GROUP BY ALL""", _POLLUTION))
def review_candidates(spark, sf_dir):
    return quality.candidate_listing(_pollution(spark, sf_dir), graph(spark, sf_dir, "documents", "paths"),
                                     REVIEWED).drop("region")


@query("scan_summary", with_documents("""SELECT kind, CAST(count(*) AS BIGINT) AS labels,
  CAST(sum(path_count) AS BIGINT) AS path_count FROM polluted GROUP BY kind""", _POLLUTION))
def scan_summary(spark, sf_dir):
    return quality.scan_summary(_pollution(spark, sf_dir)).drop("region")


@query("suspected_typos", with_documents(f"""
SELECT label, path_count, min(canonical) AS canonical,
       arg_min(canonical_paths, canonical) AS canonical_paths,
       CAST(arg_min(d, canonical) AS BIGINT) AS distance
FROM (SELECT a.label, a.paths AS path_count, b.label AS canonical, b.paths AS canonical_paths,
             levenshtein(a.label, b.label) AS d
      FROM counts a JOIN counts b ON abs(length(a.label) - length(b.label)) <= 2
        AND a.label <> b.label
      WHERE length(a.label) > 3 AND a.paths BETWEEN 1 AND 3 AND b.paths >= 5
        AND lower({strip('b.label')}) NOT IN ({quoted(quality.KNOWN_BAD)}))
WHERE d BETWEEN 1 AND 2 GROUP BY label, path_count""", COUNTS_SQL))
def suspected_typos(spark, sf_dir):
    nodes, paths = graph(spark, sf_dir, "documents", "nodes", "paths")
    return quality.suspected_typos(nodes, paths).select(
        "label", "path_count", "canonical", "canonical_paths",
        F.col("distance").cast("bigint"))


@query("mark_cleaned", with_documents("""
SELECT src, dst, relation FROM (
  SELECT label AS src, label || '_cleanup' AS dst, 'cleanup_reviewed' AS relation FROM bad
  UNION ALL SELECT label || '_cleanup', 'reviewed', 'cleanup_action' FROM bad
  UNION ALL SELECT start || '_cleanup', node, 'cleanup_cluster' FROM (
    SELECT start, node, row_number() OVER (PARTITION BY start ORDER BY n DESC, node) AS k
    FROM (SELECT b.label AS start, u.nxt AS node, count(*) AS n FROM bad b
          JOIN (SELECT src AS node, dst AS nxt FROM edges UNION ALL SELECT dst, src FROM edges
                UNION ALL SELECT label, label || '_cleanup' FROM bad) u ON u.node = b.label
          WHERE u.nxt <> b.label GROUP BY ALL)) WHERE k = 1)""",
    _POLLUTION + ", bad AS (SELECT DISTINCT label FROM polluted)"))
def mark_cleaned(spark, sf_dir):
    bad = _pollution(spark, sf_dir).select("region", "label").distinct()
    return quality.mark_cleaned(bad, graph(spark, sf_dir, "documents", "edges"), quality.LATEST).select(
        "src", "dst", "relation")


@query("refute_polluting_paths", with_documents("""
SELECT p.source_text, count(*) AS times FROM (
  SELECT e.seq, e.source_text, unnest([e.origin, e.terminus]) AS label FROM paths e) p
WHERE label IN (SELECT label FROM polluted) GROUP BY source_text""", _POLLUTION))
def refute_polluting_paths(spark, sf_dir):
    bad = _pollution(spark, sf_dir).select("region", "label").distinct()
    rows = quality.refute_paths_of(bad, graph(spark, sf_dir, "documents", "paths"), quality.LATEST)
    return rows.groupBy("source_text").agg(F.count("*").alias("times"))


@query("retext_paths", with_documents(f"""
SELECT kind, subject, relation, obj, CAST(count(*) AS BIGINT) AS times FROM (
  SELECT 'refute' AS kind, subject, relation, obj FROM parsed_a
  UNION ALL SELECT 'teach', subject, relation, obj FROM parsed_b) GROUP BY ALL""", f""",
chg AS (SELECT seq, source_text AS t, replace(replace(source_text, 'tion', 'sion'), 'thth', 'th')
        AS c FROM paths),
{parse_ctes('SELECT seq, t AS text FROM chg WHERE t <> c', '_a')},
{parse_ctes('SELECT seq, c AS text FROM chg WHERE t <> c', '_b')}"""))
def retext_paths(spark, sf_dir):
    old, new = quality.retext(graph(spark, sf_dir, "documents", "paths"),
                              [("tion", "sion"), ("thth", "th")], quality.LATEST)
    return old.unionByName(new).groupBy("kind", "subject", "relation", "obj").agg(
        F.count("*").alias("times"))


# --- resolution ------------------------------------------------------------------

def asked_terms(spark, sf_dir):
    """Terms from the part table: names as stored, plural, cut, inner and misspelt."""
    part = tables.table(spark, sf_dir, "part")
    name, key = F.lower("p_name"), F.concat(F.lit("part#"), F.col("p_partkey"))
    names = part.select(F.explode(F.array(
        name, F.concat(name, F.lit("s")), F.expr("left(lower(p_name), length(p_name) - 2)"),
        F.expr("substring(lower(p_name), 2)"), F.replace(name, F.lit("l"), F.lit("k")),
        F.replace(name, F.lit(" "), F.lit("")), F.lower("p_type"),
        F.replace(F.lower("p_brand"), F.lit("d#"), F.lit("t#")))).alias("term"))
    return names.distinct()


TERMS_SQL = """,
terms AS (SELECT DISTINCT unnest([lower(p_name), lower(p_name) || 's',
    left(lower(p_name), length(p_name) - 2), substring(lower(p_name), 2),
    replace(lower(p_name), 'l', 'k'), replace(lower(p_name), ' ', ''), lower(p_type),
    replace(lower(p_brand), 'd#', 't#')]) AS term FROM part)"""


@query("resolve_terms", with_graph("parts", """
SELECT term, label, CAST(distance AS BIGINT) AS distance, method, CAST(rank AS BIGINT) AS rank
FROM resolved""", TERMS_SQL + RESOLVE_SQL))
def resolve_terms(spark, sf_dir):
    out = resolve.resolve(asked_terms(spark, sf_dir), label_index(spark, sf_dir, "parts"))
    return out.select("term", "label", F.col("distance").cast("bigint"), "method",
                      F.col("rank").cast("bigint"))


@query("label_grams", with_graph("parts", """
SELECT gram, count(*) AS n FROM (
  SELECT label, unnest(CASE WHEN length(label) < 3 THEN [label] ELSE list_distinct(list_transform(
    range(1, length(label) - 1), lambda i: substr(label, i, 3))) END) AS gram
  FROM (SELECT DISTINCT label FROM nodes WHERE label <> '')) GROUP BY gram"""))
def label_grams(spark, sf_dir):
    """Grams of the stored label index and the labels that hold them."""
    return label_index(spark, sf_dir, "parts").gram_counts.select("gram", "n")


@query("resolve_exact", with_graph("parts", """
SELECT term FROM terms WHERE term IN (SELECT label FROM nodes)""", TERMS_SQL))
def resolve_exact(spark, sf_dir):
    return resolve.resolve_exact(asked_terms(spark, sf_dir),
                                 graph(spark, sf_dir, "parts", "nodes"), "term")


@query("did_you_mean", with_graph("parts", """
SELECT term, r.label, node_type, CAST(distance AS BIGINT) AS distance, method,
  coalesce(d.text, '') AS description
FROM resolved r JOIN nodes n ON n.label = r.label
LEFT JOIN (SELECT terminus, arg_min(source_text, (seq, part)) AS text FROM (
             SELECT *, row_number() OVER (PARTITION BY terminus, seq, part
                                          ORDER BY source_text) AS k FROM paths)
           WHERE k = 1 GROUP BY terminus) d
  ON d.terminus = r.label
WHERE method IN ('contains', 'fuzzy')""", TERMS_SQL + RESOLVE_SQL))
def did_you_mean(spark, sf_dir):
    nodes, paths = graph(spark, sf_dir, "parts", "nodes", "said")
    index = label_index(spark, sf_dir, "parts")
    return resolve.did_you_mean(asked_terms(spark, sf_dir), nodes, paths, index).select(
        "term", "label", "node_type", F.col("distance").cast("bigint"), "method", "description")


@query("qualified_variants", with_documents("""
SELECT term, v AS variant FROM (
  SELECT term, unnest([term, CASE WHEN term LIKE '%ians' THEN left(term, -4)
    WHEN term LIKE '%ian' THEN left(term, -3) END, term || ' people', term || ' language']) AS v
  FROM (SELECT DISTINCT unnest([label, label || 'ian', label || 'ians']) AS term FROM nodes
        WHERE node_type = 'concept'))
WHERE v IN (SELECT label FROM nodes)"""))
def qualified_variants(spark, sf_dir):
    nodes = graph(spark, sf_dir, "documents", "nodes")
    terms = nodes.filter("node_type = 'concept'").select(F.explode(F.array(
        "label", F.concat("label", F.lit("ian")), F.concat("label", F.lit("ians"))))
        .alias("term"))
    return resolve.qualified_variants(terms, nodes).select("term", "variant")


@query("check_ambiguity", with_graph("parts", f"""
SELECT statement_id, term, candidate, CAST(distance AS BIGINT) AS distance, false AS safety
FROM asked JOIN (
  SELECT term, v AS candidate, 0 AS distance FROM forms3 WHERE term IN (SELECT term FROM many)
  UNION ALL
  SELECT term, label, distance FROM resolved WHERE method IN ('contains', 'fuzzy')
    AND distance <= 2) USING (term)""", f""",
said AS (SELECT p_partkey AS statement_id,
                replace(lower(p_name), 'l', 'k') || ' is ' || lower(p_type) AS text FROM part),
{parse_ctes('SELECT * FROM said')},
asked AS (SELECT DISTINCT statement_id, unnest([subject, obj]) AS term FROM parsed
          WHERE length(subject) > 3 AND length(obj) > 3),
forms3 AS (SELECT term, v FROM (SELECT term, unnest([term, term || ' people',
             term || ' language']) AS v FROM (SELECT DISTINCT term FROM asked))
           WHERE v IN (SELECT label FROM nodes)),
many AS (SELECT term FROM forms3 GROUP BY term HAVING count(*) > 1),
terms AS (SELECT DISTINCT term FROM asked WHERE term NOT IN (SELECT term FROM many))"""
    + RESOLVE_SQL))
def check_ambiguity(spark, sf_dir):
    """Statements held back because a term is close to a stored part label."""
    nodes, paths = graph(spark, sf_dir, "parts", "nodes", "said")
    part = tables.table(spark, sf_dir, "part")
    said = part.select(F.col("p_partkey").alias("statement_id"), F.concat(
        F.replace(F.lower("p_name"), F.lit("l"), F.lit("k")), F.lit(" is "), F.lower("p_type"))
        .alias("text"))
    triples = statements.parse_statements(said, "text")
    _, held = resolve.check_ambiguity(triples, nodes, paths,
                                      fixed.PRIMITIVES["safety"].split(),
                                      label_index(spark, sf_dir, "parts"))
    return held.select("statement_id", "term", "candidate", F.col("distance").cast("bigint"),
                       "safety")


# --- text against graph ----------------------------------------------------------

@query("unknown_concepts", with_documents(f"""
SELECT DISTINCT word AS label FROM (
  SELECT {strip_punct('w')} AS word FROM (
    SELECT unnest({words('lower(text)')}) AS w FROM conversations))
WHERE length(word) > 2 AND word NOT IN ({quoted(w for ws in fixed.PRIMITIVES.values()
                                               for w in ws.split())},
  {quoted(fixed.STOPWORD_SUBJECTS)}, 'a', 'an', 'the', 'will', 'shall')
  AND word NOT IN (SELECT label FROM nodes)"""))
def unknown_concepts(spark, sf_dir):
    return grounding.unknown_concepts(tables.table(spark, sf_dir, "conversations"),
                                      graph(spark, sf_dir, "documents", "nodes"))


@query("concepts_mentioned", with_documents("""
SELECT d.doc_id, l.label AS concept FROM documents d
JOIN (SELECT label FROM nodes WHERE node_type = 'concept' AND length(label) >= 4) l
  ON contains(lower(d.text), l.label)"""))
def concepts_mentioned(spark, sf_dir):
    return coverage.concepts_mentioned(tables.table(spark, sf_dir, "documents"),
                                       graph(spark, sf_dir, "documents", "nodes"))


_SEEK = f"""length(label) >= 4 AND NOT contains(label, '/')
  AND NOT regexp_matches(label, '[^\\x00-\\x7f]')
  AND string_split(label, ' ')[1] NOT IN ({quoted(fixed.NON_CONCEPT_EDGES)})
  AND string_split(label, ' ')[-1] NOT IN ({quoted(fixed.NON_CONCEPT_EDGES)})"""


@query("text_gaps", with_documents("""
SELECT c.conv_id, t.concept, t.depth FROM thin t
JOIN (SELECT conv_id, string_agg(lower(text), chr(10) ORDER BY turn) AS low
      FROM conversations GROUP BY conv_id) c ON contains(c.low, t.concept)""", f""",
seek AS (SELECT label FROM nodes WHERE node_type = 'concept' AND {_SEEK}),
texts AS (SELECT lower(source_text) AS t, count(*) AS n FROM paths GROUP BY ALL),
thin AS (SELECT label AS concept, CAST(coalesce(sum(n), 0) AS BIGINT) AS depth
         FROM seek LEFT JOIN texts ON contains(t, label) GROUP BY label
         HAVING coalesce(sum(n), 0) < 3)"""))
def text_gaps(spark, sf_dir):
    nodes, paths = graph(spark, sf_dir, "documents", "nodes", "paths")
    turns = tables.table(spark, sf_dir, "conversations")
    # one text per turn; a concept is missing from a conversation only if every turn lacks it
    docs = turns.select(F.struct("conv_id", "turn").alias("doc_id"), "text")
    gaps = coverage.text_gaps(docs, nodes, paths)
    return gaps.select("doc_id.conv_id", "concept", "depth").distinct()


@query("retrieve_facts", f"""
WITH q AS (SELECT item_id, unnest(list_distinct(list_filter(
    regexp_extract_all(lower(text), '[a-z][a-z'']+'), lambda x: length(x) > 2 AND x NOT IN
    ({quoted(fixed.STOPWORD_SUBJECTS)}, 'the', 'a', 'an', 'will', 'shall')))) AS word
  FROM benchmark),
{SENTENCES},{parse_ctes('SELECT * FROM sents')},
t AS (SELECT DISTINCT text AS source_text FROM parsed),
h AS (SELECT item_id, source_text, count(*) AS hits FROM q
      JOIN t ON contains(lower(source_text), word) GROUP BY ALL HAVING count(*) >= 2)
SELECT item_id, source_text, CAST(hits AS BIGINT) AS hits, CAST(rk AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, source_text) AS rk FROM h)""")
def retrieve_facts(spark, sf_dir):
    texts = graph(spark, sf_dir, "documents", "paths").select(
        F.col("source_text").alias("text_id"), F.col("source_text").alias("text")).distinct()
    questions = tables.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return answers.retrieve_facts(questions, texts).select(
        F.col("question_id").alias("item_id"), F.col("text_id").alias("source_text"), "hits",
        F.col("rank").cast("bigint"))


@query("gap_context", with_documents(f"""
SELECT concept, doc_id, CAST(pos AS BIGINT) AS pos, sentence, CAST(rk AS BIGINT) AS rank FROM (
  SELECT concept, doc_id, pos, sentence, row_number() OVER (
           PARTITION BY concept ORDER BY doc_id, pos) AS rk
  FROM (SELECT *, row_number() OVER (PARTITION BY concept, sentence ORDER BY doc_id, pos) AS k
        FROM (SELECT concept, doc_id, pos, sentence
              FROM thin JOIN dots ON contains(lower(sentence), concept))) WHERE k = 1)""", f""",
dots AS (SELECT doc_id, i - 1 AS pos, trim(s[i]) AS sentence FROM
  (SELECT doc_id, string_split(replace(text, chr(10), ' '), '.') AS s FROM documents),
  LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i) WHERE length(trim(s[i])) > 30),
texts AS (SELECT lower(source_text) AS t, count(*) AS n FROM paths GROUP BY ALL),
thin AS (SELECT label AS concept FROM (SELECT label FROM nodes WHERE node_type = 'concept')
         LEFT JOIN texts ON contains(t, label) GROUP BY label HAVING coalesce(sum(n), 0) < 3)"""))
def gap_context(spark, sf_dir):
    nodes, paths = graph(spark, sf_dir, "documents", "nodes", "paths")
    gaps = coverage.knowledge_gaps(nodes, paths).select(F.col("topic").alias("concept"))
    docs = tables.table(spark, sf_dir, "documents")
    return answers.gap_context(docs, gaps).select(
        "concept", "doc_id", F.col("pos").cast("bigint"), "sentence",
        F.col("rank").cast("bigint"))


CONTEXT_SQL = f""",
kw AS (SELECT DISTINCT n_nationkey AS query_id, unnest(string_split(lower(n_name) || ' region ' ||
         lower(r_name), ' ')) AS keyword FROM nation JOIN region ON n_regionkey = r_regionkey),
hits AS (SELECT DISTINCT query_id, label FROM kw JOIN nodes
         ON (starts_with(label, keyword) OR starts_with(keyword, label)) AND length(label) > 2
         WHERE length(keyword) > 2 AND keyword NOT IN ({quoted(fixed.STOPWORD_SUBJECTS)}))"""


def nation_questions(spark, sf_dir):
    nation = tables.table(spark, sf_dir, "nation")
    region = tables.table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("bigint").alias("query_id"),
        F.concat(F.lower("n_name"), F.lit(" region "), F.lower("r_name")).alias("text"))


@query("context_lookup", with_graph("geography", """
SELECT CAST(query_id AS BIGINT) AS query_id, label, kind, text, source_text,
       round(weight, 6) AS weight
FROM hits JOIN (
  SELECT terminus AS label, 'why' AS kind, origin || ' → ' || mid || ' → ' || terminus AS text,
         source_text, weight FROM weighed WHERE weakest >= 0.5
  UNION ALL SELECT seed, 'trace', array_to_string(path, ' → '), NULL, weight FROM wave)
USING (label)""", CONTEXT_SQL + forward_wave("SELECT DISTINCT 'geography' AS region, label AS seed "
                                             "FROM hits")))
def context_lookup(spark, sf_dir):
    found = lookup.context(nation_questions(spark, sf_dir),
                           *graph(spark, sf_dir, "geography", "nodes", "paths", "edges"))
    return found.select("query_id", "label", "kind", "text", "source_text",
                        F.round("weight", 6).alias("weight"))


@query("rules_for", with_graph("geography", """
SELECT CAST(query_id AS BIGINT) AS query_id, label, source_text, round(weight, 6) AS weight
FROM (SELECT DISTINCT query_id, keyword AS label FROM kw WHERE length(keyword) > 2)
JOIN weighed ON terminus = label WHERE weakest >= 0.5""", CONTEXT_SQL))
def rules_for(spark, sf_dir):
    found = lookup.rules_for(nation_questions(spark, sf_dir),
                             *graph(spark, sf_dir, "geography", "nodes", "paths", "edges"))
    return found.select("query_id", "label", "source_text", F.round("weight", 6).alias("weight"))


@query("detect_conflicts", with_graph("parts", """
SELECT text_id, concept, property, min(claim) AS claim FROM (
  SELECT p_partkey AS text_id, 'part#' || p_partkey || ' is not ' || lower(p_type)
    || ' instead of ' || lower(p_brand) AS text FROM part) t
JOIN (SELECT DISTINCT terminus AS concept, origin AS property FROM paths) f
  ON contains(t.text, f.concept)
JOIN (SELECT property, c AS claim FROM (SELECT DISTINCT origin AS property,
        unnest(['not ' || origin, 'don''t use ' || origin, 'dont use ' || origin,
                'instead of ' || origin]) AS c FROM paths)) d
  USING (property) WHERE contains(t.text, d.claim) GROUP BY ALL"""))
def detect_conflicts(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part")
    texts = part.select(F.col("p_partkey").alias("text_id"), F.concat(
        F.lit("part#"), F.col("p_partkey"), F.lit(" is not "), F.lower("p_type"),
        F.lit(" instead of "), F.lower("p_brand")).alias("text"))
    known = graph(spark, sf_dir, "parts", "said").select(
        F.col("terminus").alias("concept"), F.col("origin").alias("property"))
    return grounding.detect_conflicts(texts, known)


_GROUND = f""",
sent AS (
  SELECT conv_id, turn, i - 1 AS pos, ss[i] AS s FROM (
    SELECT conv_id, turn, list_filter(list_transform({sentences(markup('text'))}, lambda q: {strip('q')}),
      lambda q: length(q) > 10) AS ss FROM conversations),
  LATERAL (SELECT unnest(range(1, len(ss) + 1)) AS i)),
word_rows AS (
  SELECT conv_id, turn, pos, unnest(list_filter(regexp_extract_all(lower(s), '[a-z][a-z'']+'),
    lambda q: length(q) > 3 AND q NOT IN ({quoted(fixed.GROUNDING_SKIP)}))) AS word FROM sent),
terms AS (SELECT DISTINCT word AS term FROM word_rows){RESOLVE_SQL},
hit_words AS (
  SELECT w.conv_id, w.turn, w.pos, r.label FROM word_rows w
  LEFT JOIN resolved r ON r.term = w.word AND r.rank = 1),
candidate_counts AS (
  SELECT conv_id, turn, pos, count(*) AS candidates, count(label) AS hits FROM hit_words GROUP BY ALL),
here_nodes AS (SELECT conv_id, turn, pos, label, count(*) AS times FROM hit_words WHERE label IS NOT NULL GROUP BY ALL),
onward_edges AS (SELECT DISTINCT src, dst FROM edges),
met_nodes AS (
  SELECT h.conv_id, h.turn, h.pos, o.dst, count(*) AS n, max(times) AS most,
    count(*) FILTER (h.label <> o.dst) AS others
  FROM here_nodes h JOIN onward_edges o ON o.src = h.label GROUP BY ALL),
linked_sents AS (
  SELECT conv_id, turn, pos FROM met_nodes WHERE n >= 2 OR most >= 2
  UNION SELECT m.conv_id, m.turn, m.pos FROM met_nodes m JOIN here_nodes h
    ON h.conv_id = m.conv_id AND h.turn = m.turn AND h.pos = m.pos AND h.label = m.dst WHERE m.others > 0),
ground AS (
  SELECT s.conv_id, s.turn, s.pos, coalesce(c.hits, 0) AS hits, coalesce(c.candidates, 0) AS candidates,
    coalesce(c.candidates > 0 AND c.hits * 2 >= c.candidates AND n.pos IS NOT NULL, false) AS grounded
  FROM sent s LEFT JOIN candidate_counts c USING (conv_id, turn, pos) LEFT JOIN linked_sents n USING (conv_id, turn, pos))"""


@query("ground_sentences", with_documents(
    "SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, hits, candidates, grounded FROM ground", _GROUND))
def ground_sentences(spark, sf_dir):
    nodes, edges = label_index(spark, sf_dir, "documents"), graph(spark, sf_dir, "documents", "edges")
    turns = tables.table(spark, sf_dir, "conversations").select(
        F.struct("conv_id", "turn").alias("turn_id"), "text")
    return grounding.ground_sentences(turns, nodes, edges).select(
        "turn_id.conv_id", "turn_id.turn", F.col("pos").cast("bigint"), "hits", "candidates",
        "grounded")


@query("grounding_report", with_documents("""
SELECT conv_id, turn, grounded, total, CASE WHEN grounded = total THEN 'fully sourced'
  WHEN grounded = 0 THEN 'ungrounded' WHEN grounded * 2 >= total THEN 'mostly grounded'
  ELSE 'mostly ungrounded' END AS label
FROM (SELECT conv_id, turn, count(*) FILTER (grounded) AS grounded, count(*) AS total FROM ground
      GROUP BY conv_id, turn)""", _GROUND))
def grounding_report(spark, sf_dir):
    nodes, edges = label_index(spark, sf_dir, "documents"), graph(spark, sf_dir, "documents", "edges")
    turns = tables.table(spark, sf_dir, "conversations").select(
        F.struct("conv_id", "turn").alias("turn_id"), "text")
    return grounding.grounding_report(grounding.ground_sentences(turns, nodes, edges)).select(
        "turn_id.conv_id", "turn_id.turn", "grounded", "total", "label")


@query("unanswerable_questions", with_graph("parts", """
SELECT conv_id, turn, topics FROM (
  SELECT conv_id, turn, max(r.term) AS known,
    string_agg(t.term, ', ' ORDER BY nth) FILTER (length(t.term) > 4) AS topics
  FROM topic t LEFT JOIN (SELECT DISTINCT term FROM resolved) r ON r.term = t.term GROUP BY conv_id, turn)
WHERE known IS NULL AND topics IS NOT NULL""", f""",
topic AS (
  SELECT conv_id, turn, i AS nth, w[i] AS term FROM (
    SELECT conv_id, turn, list_filter(list_transform({words("lower(text || '?')")}, lambda q: {strip_punct('q')}),
      lambda q: length(q) > 3 AND q NOT IN ({quoted(fixed.TOPIC_SKIP)})) AS w FROM conversations),
  LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
terms AS (SELECT DISTINCT term FROM topic)""" + RESOLVE_SQL))
def unanswerable_questions(spark, sf_dir):
    nodes = label_index(spark, sf_dir, "parts")
    turns = tables.table(spark, sf_dir, "conversations").select(
        F.struct("conv_id", "turn").alias("turn_id"),
        F.concat(F.col("text"), F.lit("?")).alias("text"))
    return grounding.unanswerable(turns, nodes).select("turn_id.conv_id", "turn_id.turn",
                                                       "topics")


# --- answering -------------------------------------------------------------------

def part_questions(spark, sf_dir):
    """One question per (name, type) pair of the part table; the first choice is right."""
    p = tables.table(spark, sf_dir, "part").select(
        F.lower("p_name").alias("name"), F.lower("p_type").alias("type")).distinct()
    first, last = F.substring_index("name", " ", 1), F.substring_index("name", " ", -1)
    return p.select(
        F.concat_ws("/", "name", "type").alias("question_id"),
        F.concat(F.lit("which "), F.col("type"), F.lit(" thing is "), F.col("name"))
        .alias("question"),
        F.array(F.concat(F.lit("the "), F.col("name")),
                F.concat(F.lit("some "), last, F.lit(" of "), first),
                F.concat(F.lit("any "), F.col("type")), F.lit("none of these")).alias("choices"),
        F.lit(0).alias("answer_idx"), F.col("type").alias("subdomain"))


QUESTION_SQL = f""",
q AS (SELECT DISTINCT lower(p_name) || '/' || lower(p_type) AS question_id, lower(p_name) AS name,
             lower(p_type) AS type FROM part),
evt AS (SELECT question_id AS event_id, unnest(regexp_extract_all(
          'which ' || type || ' thing is ' || name, '[a-z][a-z''-]+')) AS seed FROM q),
ev4 AS (SELECT event_id, seed, count(*) AS times FROM evt WHERE length(seed) >= 4
        AND seed NOT IN ({quoted(fixed.STOPWORD_SUBJECTS)}) GROUP BY ALL)"""
ANSWER_SQL = """,
sig AS (SELECT event_id, node AS label, sum(weight * times) AS w FROM ev4 JOIN wave USING (seed)
        WHERE length(node) >= 3 GROUP BY event_id, node HAVING count(*) >= 2),
ch AS (SELECT question_id, type, unnest([
         {'i': 0, 't': 'the ' || name},
         {'i': 1, 't': 'some ' || string_split(name, ' ')[2] || ' of ' || string_split(name, ' ')[1]},
         {'i': 2, 't': 'any ' || type}, {'i': 3, 't': 'none of these'}]) AS c FROM q),
sc AS (SELECT question_id, type, c.i AS idx, coalesce(sum(w), 0) AS weight, count(w) AS hits
       FROM ch LEFT JOIN sig ON event_id = question_id
         AND regexp_matches(c.t, '\\b' || label || '\\b') GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY question_id
           ORDER BY round(weight, 9) DESC, hits DESC, idx) AS k FROM sc),
ans AS (SELECT question_id, type, CASE WHEN round(weight, 9) <> 0 THEN idx END AS picked, weight,
               hits FROM best WHERE k = 1)"""
ANSWERS = QUESTION_SQL + forward_wave("SELECT 'parts' AS region, seed FROM ev4") + ANSWER_SQL


def _part_answers(spark, sf_dir):
    return answers.answer_by_intersection(part_questions(spark, sf_dir),
                                          graph(spark, sf_dir, "parts", "edges"), "parts")


@query("answer_by_intersection", with_graph("parts", """
SELECT question_id, CAST(picked AS BIGINT) AS picked, round(weight, 6) AS weight,
       CAST(hits AS BIGINT) AS hits FROM ans""", ANSWERS))
def answer_by_intersection(spark, sf_dir):
    return _part_answers(spark, sf_dir).select(
        "question_id", F.col("picked").cast("bigint"), F.round("weight", 6).alias("weight"),
        F.col("hits").cast("bigint"))


@query("score_report", with_graph("parts", """
SELECT type AS subdomain, CAST(count(*) AS BIGINT) AS questions,
  CAST(count(*) FILTER (picked = 0) AS BIGINT) AS correct,
  CAST(count(*) FILTER (picked <> 0) AS BIGINT) AS incorrect,
  CAST(count(*) FILTER (picked IS NULL) AS BIGINT) AS abstained,
  round(count(*) FILTER (picked = 0) * 100.0 / nullif(count(picked), 0), 6) AS scored_accuracy,
  round(count(picked) * 100.0 / count(*), 6) AS coverage,
  round(count(*) FILTER (picked = 0) * 100.0 / count(*), 6) AS overall
FROM ans GROUP BY ROLLUP (type)""", ANSWERS))
def score_report(spark, sf_dir):
    picked = _part_answers(spark, sf_dir).join(
        part_questions(spark, sf_dir).select("question_id", "answer_idx", "subdomain"),
        "question_id")
    out = answers.score_report(picked)
    for c in ("scored_accuracy", "coverage", "overall"):
        out = out.withColumn(c, F.round(c, 6))
    return out


ECHO_CHOICES = """(SELECT CAST(r_regionkey AS BIGINT) AS question_id, c.i AS idx, c.t AS choice,
    'which suppliers belong to ' || lower(r_name) AS question,
    r_regionkey * 10 + c.i AS event_id
  FROM (SELECT *, unnest([{'i': 0, 't': lower(r_name)}, {'i': 1, 't': 'africa'},
    {'i': 2, 't': 'asia'}, {'i': 3, 't': 'middle east'}]) AS c FROM region))"""
ECHO_SEEDS = f"""SELECT event_id, unnest(list_concat({content_words('question', True)},
  {content_words('choice', True)})) AS seed FROM {ECHO_CHOICES}"""


@query("answer_by_echo", with_graph("geography", f"""
SELECT question_id, CAST(CASE WHEN weight <> 0 THEN idx END AS BIGINT) AS picked,
       round(weight * 10, 5) AS weight, CAST(hits AS BIGINT) AS hits
FROM (SELECT *, row_number() OVER (PARTITION BY question_id
                                   ORDER BY weight DESC, hits DESC, idx) AS k FROM (
  SELECT question_id, idx, round(coalesce(sum(activation * (a + b)), 0), 5) AS weight,
         count(CASE WHEN a + b > 0 THEN node END) AS hits
  FROM (SELECT c.question_id, c.idx, x.node, x.activation,
          CASE WHEN regexp_matches(choice, '\\b' || node || '\\b') THEN 1 ELSE 0 END AS a,
          CASE WHEN regexp_matches(question, '\\b' || node || '\\b') THEN 1 ELSE 0 END AS b
        FROM {ECHO_CHOICES} c LEFT JOIN act x ON x.event_id = c.event_id)
  GROUP BY question_id, idx)) WHERE k = 1""", blend_sql(ECHO_SEEDS)))
def answer_by_echo(spark, sf_dir):
    region = tables.table(spark, sf_dir, "region")
    questions = region.select(
        F.col("r_regionkey").alias("question_id"),
        F.concat(F.lit("which suppliers belong to "), F.lower("r_name")).alias("question"),
        F.array(F.lower("r_name"), F.lit("africa"), F.lit("asia"), F.lit("middle east"))
        .alias("choices"))
    return answers.answer_by_echo(questions, graph(spark, sf_dir, "geography", "edges"),
                                  {"geography": 10.0}).select(
        F.col("question_id").cast("bigint"), F.col("picked").cast("bigint"),
        F.round("weight", 5).alias("weight"), F.col("hits").cast("bigint"))


@query("keyword_scores", with_graph("parts", f"""
SELECT p_partkey, round(sum(w), 6) AS weight, CAST(count(*) AS BIGINT) AS hits
FROM part JOIN (SELECT lower(p_name) AS event_id, label, max(w) AS w FROM (
    SELECT event_id, node AS label, sum(weight * times) AS w
    FROM (SELECT event_id, seed, count(*) AS times FROM evt GROUP BY ALL) JOIN wave USING (seed)
    GROUP BY ALL) JOIN (SELECT DISTINCT p_name FROM part) ON lower(p_name) = event_id GROUP BY ALL) k
  ON k.event_id = lower(p_name)
  AND regexp_matches(lower(p_name) || ' part#' || p_partkey, '\\b' || label || '\\b')
GROUP BY p_partkey""", """,
evt AS (SELECT event_id, unnest(string_split(event_id, ' ')) AS seed
        FROM (SELECT DISTINCT lower(p_name) AS event_id FROM part))"""
    + forward_wave("SELECT 'parts' AS region, seed FROM evt")))
def keyword_scores(spark, sf_dir):
    from .graph_queries import name_events
    texts = tables.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("text_id"), F.lower("p_name").alias("event_id"),
        F.concat(F.lower("p_name"), F.lit(" part#"), F.col("p_partkey")).alias("text"))
    scores = answers.converged_scores(texts, name_events(spark, sf_dir), graph(spark, sf_dir, "parts", "edges"))
    return scores.select(
        F.col("text_id").alias("p_partkey"), F.round("weight", 6).alias("weight"), "hits")


@query("top_activation", with_graph("geography", """
SELECT event_id, node, activation, CAST(rk AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY activation DESC, node) AS rk
  FROM act)""", blend_sql()))
def top_activation(spark, sf_dir):
    from .graph_queries import region_seeds
    act = waves.multi_echo(region_seeds(spark, sf_dir), graph(spark, sf_dir, "geography", "edges"))
    act = act.withColumn("activation", F.round("activation", 6))
    return answers.top_activation(act).select("event_id", "node", "activation",
                                              F.col("rank").cast("bigint"))


@query("learning_curve", """
WITH r AS (SELECT CAST(year(l_shipdate) - 1994 AS INTEGER) AS round, l_orderkey AS question_id,
                  max(l_returnflag) AS answer FROM lineitem GROUP BY ALL),
ok AS (SELECT *, answer = 'R' AS ok, lag(answer = 'R') OVER (PARTITION BY question_id
                                                          ORDER BY round) AS was FROM r),
per AS (SELECT round, count(*) AS questions, count(*) FILTER (ok) AS n_correct,
               count(*) FILTER (was AND NOT ok) AS regressions,
               list_sort(list(question_id) FILTER (NOT ok)) AS wrong FROM ok GROUP BY round)
SELECT CAST(a.round AS BIGINT) AS round, CAST(a.questions AS BIGINT) AS questions,
  CAST(a.n_correct AS BIGINT) AS n_correct,
  round(a.n_correct * 100.0 / a.questions, 6) AS accuracy,
  CAST(a.regressions AS BIGINT) AS regressions,
  coalesce(a.n_correct = b.n_correct AND a.wrong = b.wrong, false) AS plateau
FROM per a LEFT JOIN per b ON b.round = a.round - 1""")
def learning_curve(spark, sf_dir):
    """Years as rounds, orders as questions: an order is right when it was returned."""
    rounds = tables.table(spark, sf_dir, "lineitem").groupBy(
        (F.year("l_shipdate") - 1994).alias("round"), F.col("l_orderkey").alias("question_id")) \
        .agg(F.max("l_returnflag").alias("answer")).withColumn("correct", F.lit("R"))
    return answers.learning_curve(rounds).select(
        F.col("round").cast("bigint"), "questions", F.col("n_correct").cast("bigint"),
        F.round("accuracy", 6).alias("accuracy"), "regressions", "plateau")


# --- observation -----------------------------------------------------------------

@query("apply_corrections", """
WITH obs AS (SELECT DISTINCT 'part#' || p_partkey AS item, lower(p_type) AS property FROM part),
cor AS (SELECT 'part#' || p_partkey AS item, lower(p_name) AS label FROM part),
said AS (SELECT item AS s, label AS o FROM cor
         UNION ALL SELECT label, property FROM obs JOIN cor USING (item))
SELECT s AS subject, o AS obj, CAST(count(*) AS BIGINT) AS times FROM said GROUP BY ALL""")
def apply_corrections(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part")
    item = F.concat(F.lit("part#"), F.col("p_partkey")).alias("item")
    observed = part.select(item, F.lower("p_type").alias("property"))
    labels = part.select(item, F.lower("p_name").alias("label"), F.col("p_partkey").alias("seq"))
    taught = observe.apply_corrections(observed, labels)
    return taught.groupBy("subject", "obj").agg(F.count("*").alias("times"))


@query("verification_candidates", with_graph("parts", """
SELECT 'part#' || p_partkey AS item, origin AS property FROM part
JOIN (SELECT DISTINCT terminus, origin FROM weighed WHERE weakest >= 0.5)
  ON terminus = 'part#' || p_partkey WHERE origin <> lower(p_type)"""))
def verification_candidates(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part")
    item = F.concat(F.lit("part#"), F.col("p_partkey"))
    base = part.select(F.lit("parts").alias("region"), item.alias("item"),
                       F.lower("p_type").alias("property"), item.alias("label"))
    paths, edges = graph(spark, sf_dir, "parts", "paths", "edges")
    return observe.verification_candidates(
        base.select("region", "item", "property"), base.select("region", "item", "label"),
        paths, edges).select("item", "property")


@query("unobserved_associations", """
WITH o AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part),
a AS (SELECT unnest(['color', 'taste', 'shape', 'texture', 'size', 'temperature']) AS association)
SELECT DISTINCT p.p_partkey AS item, a.association FROM part p, a
WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.p_partkey = p.p_partkey AND a.association =
  CASE WHEN w IN ('red', 'blue') THEN 'color' WHEN w IN ('small', 'large') THEN 'size'
       WHEN w IN ('hot', 'cold') THEN 'temperature' END)""")
def unobserved_associations(spark, sf_dir):
    seen = tables.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"), F.explode(F.split(F.lower("p_name"), " "))
        .alias("property"))
    return observe.unobserved_associations(seen)


@query("ingest_documents")
def ingest_documents(spark, sf_dir):
    sents = tables.document_sentences(spark, sf_dir).select(
        F.col("sentence").alias("text"), (F.col("doc_id") * 1_000_000 + F.col("pos")).alias("seq"),
        F.lit("documents").alias("region"))
    _, log = observe.ingest_statements(sents, AS_OF)
    return evidence.fold_evidence(log).select(
        "src", "dst", "relation", "traversals", "refutations",
        F.round("strength", 6).alias("strength"))
