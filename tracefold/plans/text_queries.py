"""Queries over the text tables: clean-up, parsing, turns, dates, content words."""

import datetime

from pyspark.sql import functions as F

from ..functions import (chunks, cleaning, contents, dates, fixed, measures, pollution, qualify,
                         statements, strings, turns)
from ..functions.fixed import WORD, WS
from ..operators import coverage, evidence, teaching
from ..sources import tables
from .catalog import query
from .graphs import graph
from .sql import GRAPH
from .sql_text import (NOT_WORD, SENTENCES, content_words, html_text, parse_ctes, quoted,
                       rejection, sentences, strip, strip_punct, with_documents, words)

AS_OF = datetime.date(2024, 6, 15)


def _table(spark, sf_dir, name):
    return tables.table(spark, sf_dir, name)


for _profile in ("plain", "article"):
    def _html(spark, sf_dir, profile=_profile):
        return _table(spark, sf_dir, "pages").select(
            "page_id", cleaning.html_to_text(F.col("html"), profile).alias("text"))
    query(f"html_to_text_{_profile}",
          f"SELECT page_id, {html_text('html', _profile)} AS text FROM pages")(_html)

ARTICLE_SQL = f"art AS (SELECT page_id, {html_text('html', 'article')} AS text FROM pages)"
BODY_SQL = f"""{ARTICLE_SQL}, ln AS (
  SELECT page_id, list_filter(list_transform(string_split(text, chr(10)), lambda q: {strip('q')}),
    lambda s: s = '' OR (length(s) >= 20 AND NOT regexp_matches(lower(s), '{
    "|".join(p.replace(".", "[.]") for p in
             fixed.BOILERPLATE_PHRASES + fixed.BOILERPLATE_FREE_TEXT)}'))) AS l FROM art),
body AS (SELECT page_id, regexp_replace(array_to_string(l, chr(10)), '^\\n+', '') AS text FROM ln)
"""


def article_bodies(spark, sf_dir):
    text = cleaning.html_to_text(F.col("html"), "article")
    return _table(spark, sf_dir, "pages").select(
        "page_id", cleaning.strip_boilerplate(text).alias("text"))


@query("strip_boilerplate", f"WITH {BODY_SQL} SELECT * FROM body")
def strip_boilerplate(spark, sf_dir):
    return article_bodies(spark, sf_dir)


@query("detect_format", """
SELECT page_id, CASE
  WHEN regexp_matches(lower(url), '\\.(md|markdown)$') THEN 'markdown'
  WHEN regexp_matches(lower(url), '\\.(py|js|ts|go|rs|java|c|cpp|h)$') THEN 'code'
  WHEN ltrim(html, ' ' || chr(9) || chr(10) || chr(13)) LIKE '#%'
       AND contains(html, chr(10) || '## ') THEN 'markdown'
  WHEN contains(html, chr(10) || 'def ') OR contains(html, chr(10) || 'class ') THEN 'code'
  ELSE 'text' END AS format FROM pages""")
def detect_format(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select(
        "page_id", cleaning.detect_format(F.col("html"), F.col("url")).alias("format"))


def _greedy(units: str, limit: int, glue: int) -> str:
    """Recursive packing of unit(id, i, u): one row per unit with its chunk number."""
    return f"""units AS ({units}),
packed AS (
  SELECT id, i, u, 0 AS chunk_no, length(u) + {glue} AS n FROM units WHERE i = 1
  UNION ALL
  SELECT t.id, t.i, t.u, CASE WHEN p.n + length(t.u) > {limit} THEN p.chunk_no + 1
                              ELSE p.chunk_no END,
         CASE WHEN p.n + length(t.u) > {limit} THEN length(t.u) + {glue}
              ELSE p.n + length(t.u) + {glue} END
  FROM packed p JOIN units t ON t.id = p.id AND t.i = p.i + 1)
"""


@query("chunk_skim", f"""WITH RECURSIVE {BODY_SQL}, {_greedy(f'''
  SELECT page_id AS id, u, row_number() OVER (PARTITION BY page_id ORDER BY i) AS i FROM (
    SELECT page_id, {strip('s[i]')} AS u, i FROM
      (SELECT page_id, string_split(text, chr(10) || chr(10)) AS s FROM body),
      LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i))
  WHERE length(u) >= 30''', 2500, 2)}
SELECT id AS page_id, CAST(chunk_no AS BIGINT) AS chunk_no,
       string_agg(u, chr(10) || chr(10) ORDER BY i) AS chunk FROM packed GROUP BY ALL""")
def chunk_skim(spark, sf_dir):
    return chunks.chunk_documents(article_bodies(spark, sf_dir), ["page_id"], max_chars=2500,
                                  strategy="skim").select(
        "page_id", F.col("chunk_no").cast("bigint"), "chunk")


@query("chunk_documents", f"""WITH RECURSIVE {_greedy('''
  SELECT doc_id AS id, i, s[i] AS u FROM
    (SELECT doc_id, string_split(regexp_replace(text, '^[ \\n]+|[ \\n]+$', '', 'g'), chr(10)) AS s
     FROM documents),
    LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)''', 1500, 1)}
SELECT id AS doc_id, CAST(chunk_no AS BIGINT) AS chunk_no,
       string_agg(u, chr(10) ORDER BY i) AS chunk FROM packed GROUP BY ALL""")
def chunk_documents(spark, sf_dir):
    return chunks.chunk_documents(_table(spark, sf_dir, "documents"), ["doc_id"],
                                  source="source").select(
        "doc_id", F.col("chunk_no").cast("bigint"), "chunk")


@query("chunk_sentences", f"""WITH RECURSIVE {_greedy(f'''
  SELECT doc_id AS id, i, s[i] AS u FROM
    (SELECT doc_id, {sentences(strip('text'))} AS s FROM documents
     WHERE length({strip('text')}) > 800),
    LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)
  UNION ALL SELECT doc_id, 1, {strip('text')} FROM documents WHERE length({strip('text')}) <= 800
''', 800, 1)},
made AS (SELECT id, chunk_no, string_agg(u, ' ' ORDER BY i) AS chunk FROM packed GROUP BY ALL)
SELECT id AS doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY chunk_no) - 1 AS BIGINT)
         AS chunk_no, chunk FROM made WHERE length({strip('chunk')}) > 50""")
def chunk_sentences(spark, sf_dir):
    return chunks.chunk_documents(_table(spark, sf_dir, "documents"), ["doc_id"], max_chars=800,
                                  strategy="sentence").select(
        "doc_id", F.col("chunk_no").cast("bigint"), "chunk")


BULLETS = "^[*•·0123456789.)-]+"
LINE_SQL = f"""lns AS (
  SELECT conv_id, turn, i, {strip(f"regexp_replace({strip('s[i]')}, '{BULLETS}', '')")} AS line
  FROM (SELECT conv_id, turn, regexp_split_to_array(text, '\\r\\n|[\\n\\r]') AS s
        FROM conversations), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i))"""


@query("clean_statement_lines", f"""WITH {LINE_SQL}
SELECT conv_id, turn, line FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn, lower(line) ORDER BY i) AS k FROM lns
  WHERE line <> '' AND upper(line) <> 'NONE'
    AND NOT regexp_matches(lower(line), 'http|www|import |def |class ')) WHERE k = 1""")
def clean_statement_lines(spark, sf_dir):
    return cleaning.clean_statement_lines(
        _table(spark, sf_dir, "conversations"), ["conv_id", "turn"]).drop("pos")


@query("clean_labels", f"""WITH raw AS (
  SELECT conv_id, turn, i, lower({strip('''CASE WHEN contains(b, ':')
         THEN regexp_replace(b, '^[^:]*:', '') ELSE b END''')}) AS line
  FROM (SELECT conv_id, turn, i, regexp_replace({strip('s[i]')}, '{BULLETS}', '') AS b
        FROM (SELECT conv_id, turn, regexp_split_to_array(text, '\\r\\n|[\\n\\r]') AS s
              FROM conversations), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i))),
part AS (
  SELECT DISTINCT conv_id, turn, {strip(f'''regexp_replace(regexp_replace({strip('p')},
    '^["''`]+|["''`]+$', '', 'g'), '[^a-z0-9_ -]', '', 'g')''')} AS label
  FROM (SELECT conv_id, turn, unnest(string_split(line, ',')) AS p FROM raw))
SELECT * FROM part WHERE regexp_matches(label, '^[a-z0-9][a-z0-9_ -]*$')
  AND NOT regexp_matches(label, 'http|www|import |def |class ')""")
def clean_labels(spark, sf_dir):
    return cleaning.clean_labels(_table(spark, sf_dir, "conversations"),
                                 ["conv_id", "turn"]).drop("pos")


def _hedged(x):
    for pattern, plain in fixed.HEDGES:
        body = pattern.replace("\\b", "")
        x = (f"regexp_replace({x}, '(?i)(^|{NOT_WORD}){body}($|{NOT_WORD})', "
             f"'\\1{plain}\\2', 'g')")
    return x


_REST = "[" + WORD[1:-1] + WS[1:-1] + "\\-]"
_CLAIM = f"(?i)({WORD}{_REST}{{1,40}}?){WS}+({fixed.EXTRACT_VERBS}){WS}+({WORD}{_REST}+)"
def markup(x):
    return f"regexp_replace({x}, '\\*\\*|`|#+{WS}*', '', 'g')"


@query("extract_statements", f"""WITH sn AS (
  SELECT doc_id, i AS pos, regexp_replace({strip('s[i]')}, '\\.+$', '') AS s FROM
    (SELECT doc_id, {sentences('text')} AS s FROM documents),
    LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)),
m AS (SELECT doc_id, pos, regexp_extract(h, '{_CLAIM}', 1) AS sj,
             lower(regexp_extract(h, '{_CLAIM}', 2)) AS verb,
             regexp_extract(h, '{_CLAIM}', 3) AS ob
      FROM (SELECT doc_id, pos, {_hedged('s')} AS h FROM sn) WHERE regexp_matches(h, '{_CLAIM}')),
c AS (SELECT doc_id, pos, verb, array_to_string({words('sj')}[-4:], ' ') AS sj,
      {strip(f"CASE WHEN regexp_matches(ob, '(^|{NOT_WORD})(and|but|not|which|that|when)($|{NOT_WORD})') THEN regexp_extract(ob, '(?s)^((?:.*?{NOT_WORD})??)(?:and|but|not|which|that|when)(?:$|{NOT_WORD})', 1) ELSE ob END")} AS ob
      FROM m),
st AS (SELECT doc_id, pos, {strip(f'''regexp_replace(regexp_replace({markup("sj || ' ' || verb || ' ' || ob")},
   '^{WS}*[-*]{WS}+', ''), '^{WS}*[0-9]+[.)]{WS}+', '')''')} AS statement FROM c
  WHERE lower(sj) NOT IN ({quoted(fixed.NOISE_SUBJECTS)})
    AND lower(string_split(sj, ' ')[1]) NOT IN ({quoted(fixed.NOISE_STARTS)}) AND length(ob) > 2),
one AS (SELECT *, row_number() OVER (PARTITION BY doc_id, statement ORDER BY pos) AS k FROM st
        WHERE length(statement) > 10)
SELECT doc_id, statement, CAST(nth AS BIGINT) AS nth FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM one WHERE k = 1)""")
def extract_statements(spark, sf_dir):
    return cleaning.extract_statements(_table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", "statement", F.col("nth").cast("bigint"))


@query("plain_sentences", f"""
SELECT doc_id, CAST(count(*) AS BIGINT) AS sentences, CAST(sum(length(s)) AS BIGINT) AS chars FROM (
  SELECT doc_id, {strip('s')} AS s FROM (
    SELECT doc_id, unnest({sentences(markup('text'))}) AS s FROM documents))
WHERE length(s) > 10 GROUP BY doc_id""")
def plain_sentences(spark, sf_dir):
    return (_table(spark, sf_dir, "documents")
            .select("doc_id", F.explode(cleaning.plain_sentences(F.col("text"))).alias("s"))
            .groupBy("doc_id").agg(F.count("*").alias("sentences"),
                                   F.sum(F.length("s")).alias("chars")))


@query("parse_document_statements", f"""
WITH {SENTENCES},{parse_ctes('SELECT * FROM sents')}
SELECT doc_id, CAST(pos AS BIGINT) AS pos, subject, relation, obj, ptype, negated FROM parsed""")
def parse_document_statements(spark, sf_dir):
    sents = tables.document_sentences(spark, sf_dir)
    return statements.parse_statements(sents, "sentence").select(
        "doc_id", F.col("pos").cast("bigint"), "subject", "relation", "obj", "ptype", "negated")


@query("filter_polluting", f"""
WITH {SENTENCES} SELECT doc_id, reason, CAST(count(*) AS BIGINT) AS sentences
FROM (SELECT doc_id, {rejection('text')} AS reason FROM sents) GROUP BY ALL""")
def filter_polluting(spark, sf_dir):
    return (pollution.filter_polluting(tables.document_sentences(spark, sf_dir), "sentence")
            .groupBy("doc_id", "reason").agg(F.count("*").alias("sentences")))


@query("teach_documents", with_documents("""SELECT region, src, dst, relation, traversals,
  refutations, witnesses, round(strength, 6) AS strength FROM edges"""))
def teach_documents(spark, sf_dir):
    log = evidence.teach(tables.document_facts(spark, sf_dir))
    return evidence.fold_evidence(log).select(
        "region", "src", "dst", "relation", "traversals", "refutations", "witnesses",
        F.round("strength", 6).alias("strength"))


@query("taxonomy_labels", """
SELECT p_partkey, w AS label, CASE WHEN w IN ('red', 'blue') THEN 'color'
  WHEN w IN ('small', 'large') THEN 'size' WHEN w IN ('hot', 'cold') THEN 'temperature'
  ELSE 'attribute' END AS ptype, 'thing' AS category,
  'part#' || p_partkey || '_' || CASE WHEN w IN ('red', 'blue') THEN 'color'
  WHEN w IN ('small', 'large') THEN 'size' WHEN w IN ('hot', 'cold') THEN 'temperature'
  ELSE 'attribute' END AS relation_label
FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part)""")
def taxonomy_labels(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(
        "p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("obj"),
        F.concat(F.lit("part#"), F.col("p_partkey")).alias("subject"))
    return statements.with_taxonomy(rows).select(
        "p_partkey", F.col("obj").alias("label"), "ptype", "category", "relation_label")


@query("seekable_concepts", with_documents(f"""
SELECT label, length(s) >= 4 AND NOT contains(s, '/') AND NOT regexp_matches(s, '[^\\x00-\\x7f]')
  AND len(w) > 0 AND w[1] NOT IN ({quoted(fixed.NON_CONCEPT_EDGES)})
  AND w[-1] NOT IN ({quoted(fixed.NON_CONCEPT_EDGES)}) AS seekable
FROM (SELECT label, lower({strip('label')}) AS s, {words(f"lower({strip('label')})")} AS w
      FROM nodes WHERE node_type = 'concept')"""))
def seekable_concepts(spark, sf_dir):
    nodes = graph(spark, sf_dir, "documents", "nodes").filter("node_type = 'concept'")
    return nodes.select("label", coverage.is_seekable(F.col("label")).alias("seekable"))


@query("primitive_layers", f"""
SELECT w AS word, layer, CAST(count(*) AS BIGINT) AS times FROM (
  SELECT unnest({words('lower(text)')}) AS w FROM documents)
JOIN (VALUES {", ".join(f"('{w}', '{layer}')" for layer, ws in fixed.PRIMITIVES.items()
                        for w in ws.split())}) v(label, layer) ON label = w GROUP BY ALL""")
def primitive_layers(spark, sf_dir):
    tokens = _table(spark, sf_dir, "documents").select(
        F.explode(strings.words(F.lower("text"))).alias("word"))
    return (tokens.groupBy("word").agg(F.count("*").alias("times"))
            .select("word", F.explode(contents.primitive_layers(F.col("word"))).alias("layer"),
                    "times"))


# --- turns ---------------------------------------------------------------------

_QW = quoted(fixed.QUESTION_PREFIXES)
_STOP = quoted(fixed.TURN_STOPWORDS)


def _case_prefix(x, phrases, then):
    return "CASE " + " ".join(
        f"WHEN starts_with({x}, {quoted([p])}) THEN {then(len(p) + 1)}" for p in phrases) + " END"


def _compound(x):
    for sep in fixed.SENTENCE_TERMINATORS + fixed.CONJUNCTIONS:
        x = f"flatten(list_transform({x}, lambda q: string_split(q, '{sep}')))"
    return f"list_filter(list_transform({x}, lambda q: {strip('q')}), lambda q: q <> '')"


_QUANT = quoted(fixed.QUANTIFIERS_HIGH + fixed.QUANTIFIERS_LOW + fixed.QUANTIFIERS_NEGATING)
TURNS_SQL = f"""
t0 AS (SELECT conv_id, turn, {strip('text')} AS t, lower({strip('text')}) AS low
       FROM conversations),
t1 AS (SELECT *, {strip("regexp_replace(low, '[?.!]+$', '')")} AS clean,
              {words('low')} AS lw FROM t0),
t2 AS (SELECT *, {_case_prefix('clean', fixed.ASSOCIATION_PHRASES,
                               lambda n: f'substr(clean, {n})')} AS asked,
              {words('clean')} AS cw FROM t1),
t3 AS (SELECT *, CASE WHEN asked IS NOT NULL THEN {words('asked')}
   WHEN len(cw) BETWEEN 1 AND 4 AND NOT list_has_any(cw,
     [{_QW}, {quoted(fixed.COPULAS + fixed.POSSESSION)}]) THEN cw END AS aw FROM t2),
t4 AS (SELECT *, list_filter(list_transform(aw, lambda q: {strip_punct('q')}),
   lambda q: length(q) > 1 AND q NOT IN ({_STOP})) AS atop FROM t3),
t5 AS (SELECT *, CASE WHEN t = '' THEN 'unknown'
   WHEN lw[1] IN ({quoted(fixed.GREETINGS)}) OR low IN ({quoted(fixed.GREETINGS)}) THEN 'greeting'
   WHEN len(atop) > 0 THEN 'association'
   WHEN low LIKE '%?' OR lw[1] IN ({_QW}) THEN 'question' END AS early,
   {strip(_case_prefix('low', fixed.SOURCE_PHRASES, lambda n: f'substr(t, {n})'))} AS rest FROM t4),
t6 AS (SELECT *, regexp_matches(rest, '(?is)(^|{NOT_WORD})(says|that|claims|tells us)[,\\s]')
         AS byverb FROM t5),
t7 AS (SELECT *,
   CASE WHEN byverb THEN regexp_replace({strip(f"regexp_extract(rest, '(?is)^((?:.*?{NOT_WORD})??)(?:says|that|claims|tells us)[,\\s]', 1)")}, '[,.:;]+$', '')
        WHEN contains(rest, ',') THEN regexp_replace({strip("split_part(rest, ',', 1)")}, '[.:;]+$', '')
   END AS source,
   CASE WHEN byverb THEN {strip(f"regexp_replace(rest, '(?is)^(?:.*?{NOT_WORD})??(?:says|that|claims|tells us)[,\\s]+', '')")}
        WHEN contains(rest, ',') THEN {strip("regexp_replace(rest, '^[^,]*,', '')")} ELSE t END AS body
   FROM t6),
subs AS (SELECT conv_id, turn, i, s[i] AS original,
   array_to_string(list_filter({words('s[i]')}, lambda q: lower(q) NOT IN ({_QUANT})), ' ') AS text
   FROM (SELECT conv_id, turn, {_compound('[body]')} AS s FROM t7 WHERE early IS NULL),
   LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)),
{parse_ctes('SELECT * FROM subs')},
perturn AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER (negated) AS neg
            FROM parsed GROUP BY ALL),
kinds AS (SELECT t7.*, coalesce(n, 0) AS n_facts, CASE WHEN early IS NOT NULL THEN early
   WHEN n IS NULL THEN 'unknown' WHEN neg > 0 AND n = 1 THEN 'negation'
   WHEN neg > 0 THEN 'correction' ELSE 'statement' END AS kind
   FROM t7 LEFT JOIN perturn USING (conv_id, turn))"""


@query("classify_turns", f"""WITH {TURNS_SQL}
SELECT conv_id, turn, kind, CASE WHEN early IS NULL THEN source END AS source,
  CAST(CASE WHEN early IS NULL THEN n_facts ELSE 0 END AS BIGINT) AS n_facts,
  array_to_string(CASE WHEN kind = 'association' THEN atop WHEN kind = 'question' THEN
    list_filter(list_transform(CASE WHEN qw[1] IN ({_QW}) THEN qw[2:] ELSE qw END,
      lambda q: {strip_punct('q')}), lambda q: length(q) > 2 AND q NOT IN ({_STOP}, {_QW},
      'a', 'an', 'the')) END, '|') AS topics
FROM (SELECT *, {words("replace(low, '?', '')")} AS qw FROM kinds)""")
def classify_turns(spark, sf_dir):
    return turns.classify_turns(_table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", "kind", "source",
        F.coalesce(F.size("facts"), F.lit(0)).cast("bigint").alias("n_facts"),
        F.array_join("topics", "|").alias("topics"))


@query("turn_facts", f"""WITH {TURNS_SQL}
SELECT conv_id, turn, subject, relation, obj, negated, original AS original_text,
  CASE WHEN list_has_any(ow, [{quoted(fixed.QUANTIFIERS_HIGH)}]) THEN 1.0
       WHEN list_has_any(ow, [{quoted(fixed.QUANTIFIERS_LOW)}]) THEN 0.5
       WHEN list_has_any(ow, [{quoted(fixed.QUANTIFIERS_NEGATING)}]) THEN 0.2
       ELSE 1.0 END AS confidence
FROM (SELECT *, {words('lower(original)')} AS ow FROM parsed)""".replace("1.0 ", "1.0::DOUBLE ")
       .replace("THEN 0.5", "THEN 0.5::DOUBLE").replace("THEN 0.2", "THEN 0.2::DOUBLE"))
def turn_facts(spark, sf_dir):
    out = turns.classify_turns(_table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", F.inline("facts")).select(
        "conv_id", "turn", "subject", "relation", "obj", "negated", "original_text",
        "confidence")


@query("split_compound", f"""
SELECT conv_id, turn, CAST(i AS BIGINT) AS part, s[i] AS text FROM
  (SELECT conv_id, turn, {_compound('[text]')} AS s FROM conversations),
  LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)""")
def split_compound(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.posexplode(turns.split_compound(F.col("text")))
        .alias("part", "text")).withColumn("part", (F.col("part") + 1).cast("bigint"))


def disputed_turns(spark, sf_dir):
    """Turns as replies that open with a correction, chosen by turn number."""
    conv = _table(spark, sf_dir, "conversations")
    return conv.withColumn("text", F.concat(
        F.element_at(F.array(F.lit("No, actually, "), F.lit("that's wrong. "), F.lit("")),
                     (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)) + 1).cast("int")),
        F.col("text")))


_PREF = "|".join(p.replace(".", "\\.").replace("'", "''") for p in
                 sorted(fixed.CORRECTION_PREFIXES, key=len, reverse=True))


def _unprefix(x):
    return (f"CASE WHEN regexp_matches({x}, '(?i)^({_PREF})') THEN {strip(f'''regexp_replace(
      regexp_replace({x}, '(?i)^({_PREF})', ''), '^[,.:; ]+', '')''')} ELSE {x} END")


@query("detect_corrections", f"""WITH d AS (
  SELECT conv_id, turn, {strip('''['No, actually, ', 'that''s wrong. ', '']
    [1 + (conv_id + turn) % 3] || text''')} AS t FROM conversations),
c1 AS (SELECT *, {_unprefix('t')} AS a FROM d),
c2 AS (SELECT *, {_unprefix('a')} AS b FROM c1),
c3 AS (SELECT *, {_unprefix('b')} AS cleaned FROM c2
       WHERE regexp_matches(t, '(?i)^({_PREF})')),
tails AS (SELECT conv_id, turn, i, {strip("array_to_string(p[i:], ',')")} AS text FROM
  (SELECT conv_id, turn, string_split(cleaned, ',') AS p FROM c3),
  LATERAL (SELECT unnest(range(2, len(p) + 1)) AS i)),
{parse_ctes("SELECT * FROM tails WHERE text <> ''")},
best AS (SELECT conv_id, turn, arg_min(text, i) AS tail FROM parsed
         WHERE NOT contains(subject, ',') GROUP BY ALL)
SELECT conv_id, turn, coalesce(tail, cleaned) AS correction
FROM c3 LEFT JOIN best USING (conv_id, turn)""")
def detect_corrections(spark, sf_dir):
    return (disputed_turns(spark, sf_dir)
            .withColumn("correction", turns.detect_correction(F.col("text")))
            .filter(F.col("correction").isNotNull()).select("conv_id", "turn", "correction"))


# --- content words -------------------------------------------------------------

for _name, _q in (("question", True), ("round", False)):
    def _content(spark, sf_dir, profile=_name):
        return (_table(spark, sf_dir, "documents").select("doc_id", F.explode(
            contents.extract_words(F.col("text"), profile)).alias("word"))
            .groupBy("word").agg(F.count("*").alias("docs")))
    query(f"extract_words_{_name}", f"""
SELECT word, CAST(count(*) AS BIGINT) AS docs FROM (
  SELECT doc_id, unnest({content_words('text', _q)}) AS word FROM documents)
GROUP BY word""")(_content)


@query("concept_words", f"""
SELECT item_id, word, CAST(count(*) AS BIGINT) AS times FROM (
  SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]+')) AS word
  FROM benchmark)
WHERE length(word) >= 4 AND word NOT IN ({quoted(fixed.STOPWORD_SUBJECTS)}) GROUP BY ALL""")
def concept_words(spark, sf_dir):
    return (_table(spark, sf_dir, "benchmark").select("item_id", F.explode(
        contents.concept_words(F.col("text"), fixed.STOPWORD_SUBJECTS)).alias("word"))
        .groupBy("item_id", "word").agg(F.count("*").alias("times")))


_INNATE = quoted([w for ws in fixed.PRIMITIVES.values() for w in ws.split()])


@query("digest_words", f"""
SELECT word, CAST(count(DISTINCT (conv_id, turn)) AS BIGINT) AS turns FROM (
  SELECT conv_id, turn, {strip_punct('w')} AS word FROM (
    SELECT conv_id, turn, unnest({words('lower(text)')}) AS w FROM conversations))
WHERE length(word) > 2 AND word NOT IN ({_INNATE}, {quoted(fixed.STOPWORD_SUBJECTS)},
  'a', 'an', 'the', 'will', 'shall') GROUP BY ALL""")
def digest_words(spark, sf_dir):
    return (_table(spark, sf_dir, "conversations").select(F.explode(
        contents.digest_words(F.col("text"))).alias("word"))
        .groupBy("word").agg(F.count("*").alias("turns")))


@query("proposal_words", f"""
SELECT word, CAST(count(DISTINCT (conv_id, turn)) AS BIGINT) AS turns FROM (
  SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-zA-Z_][a-zA-Z0-9_]*')) AS word
  FROM conversations)
WHERE length(word) > 2 AND word NOT IN ({quoted(fixed.PROPOSAL_STOPS)}) GROUP BY ALL""")
def proposal_words(spark, sf_dir):
    return (_table(spark, sf_dir, "conversations").select(F.explode(
        contents.proposal_words(F.col("text"))).alias("word"))
        .groupBy("word").agg(F.count("*").alias("turns")))


@query("inflections", """
SELECT DISTINCT p_name AS label, v AS variant FROM (SELECT p_name, unnest([
  p_name || 's', p_name || 'es', p_name || 'ian', p_name || 'ians', p_name || 'an',
  CASE WHEN p_name LIKE '%ians' THEN left(p_name, -4) WHEN p_name LIKE '%ian' THEN left(p_name, -3)
       WHEN p_name LIKE '%ans' THEN left(p_name, -3) WHEN p_name LIKE '%an' THEN left(p_name, -2) END,
  CASE WHEN p_name LIKE '%ians' THEN left(p_name, -1) WHEN p_name LIKE '%ian' THEN p_name || 's'
       WHEN p_name LIKE '%ans' THEN left(p_name, -1) END,
  CASE WHEN p_name LIKE '%ies' THEN left(p_name, -3) || 'y'
       WHEN p_name LIKE '%es' THEN left(p_name, -2)
       WHEN p_name LIKE '%s' AND p_name NOT LIKE '%ss' THEN left(p_name, -1) END]) AS v
  FROM part) WHERE v IS NOT NULL""")
def inflections(spark, sf_dir):
    names = _table(spark, sf_dir, "part").select(F.col("p_name").alias("label")).distinct()
    return names.select("label", F.explode(strings.inflections(F.col("label")))
                        .alias("variant")).distinct()


# --- dates, qualification, triage, rendering -------------------------------------

def dated_orders(spark, sf_dir):
    """One dated sentence per order, built from its columns."""
    return _table(spark, sf_dir, "orders").select(
        F.lit("market").alias("region"), F.concat(F.lit("order#"), F.col("o_orderkey"))
        .alias("fact"), F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("placed around "), F.year("o_orderdate"),
                 F.when(F.col("o_orderstatus") == "F", " BCE after").otherwise(" until"),
                 F.lit(" the late "), F.lower(F.regexp_extract("o_orderpriority", "[A-Z ]+", 0)),
                 F.lit(" period, not "),
                 F.when(F.col("o_custkey") % 2 == 0, "today").otherwise("tomorrow")).alias("text"))


DATED_SQL = """dated AS (
  SELECT o_orderkey AS seq, 'order#' || o_orderkey AS fact, CAST(year(o_orderdate) AS VARCHAR) AS y,
         lower(regexp_extract(o_orderpriority, '[A-Z ]+')) AS p, o_orderstatus = 'F' AS bce,
         o_custkey % 2 = 0 AS even,
         CASE WHEN o_orderstatus = 'F' THEN 'after' ELSE 'until' END AS rel FROM orders),
refs AS (
  SELECT seq, fact, rel, y || CASE WHEN bce THEN '_bce' ELSE '_ce' END AS label, 'moment' AS type
  FROM dated
  UNION ALL SELECT seq, fact, rel, 'late_' || replace(p, ' ', '_') || '_period', 'era' FROM dated
  UNION ALL SELECT seq, fact, rel, CASE WHEN even THEN 'day_2024_06_15' ELSE 'day_2024_06_16' END,
                   'moment' FROM dated)"""


@query("extract_dates", f"WITH {DATED_SQL} SELECT fact, label, type FROM refs")
def extract_dates(spark, sf_dir):
    return dated_orders(spark, sf_dir).select(
        "fact", F.inline(dates.extract_dates(F.col("text"), AS_OF)))


@query("temporal_relations", f"""WITH {DATED_SQL}
SELECT rel AS relation, CAST(count(*) AS BIGINT) AS orders FROM dated GROUP BY ALL""")
def temporal_relations(spark, sf_dir):
    return (dated_orders(spark, sf_dir)
            .select(F.explode(dates.temporal_relations(F.col("text"))).alias("relation"))
            .groupBy("relation").agg(F.count("*").alias("orders")))


@query("link_dates", f"""WITH {DATED_SQL}
SELECT src, dst, relation, CAST(count(*) AS BIGINT) AS events FROM (
  SELECT label AS src, type AS dst, 'is_a' AS relation FROM refs
  UNION ALL SELECT fact, label, 'happened_' || rel FROM refs) GROUP BY ALL""")
def link_dates(spark, sf_dir):
    return (dates.link_dates(dated_orders(spark, sf_dir), AS_OF)
            .groupBy("src", "dst", "relation").agg(F.count("*").alias("events")))


@query("link_to_day", """
WITH timed AS (
  SELECT 'user#' || user_id AS who, strftime(ts, 'day_%Y_%m_%d') AS day,
         CASE WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 17 THEN 'afternoon'
              WHEN hour(ts) < 21 THEN 'evening' ELSE 'night' END AS period FROM events)
SELECT src, dst, relation, period, CAST(count(*) AS BIGINT) AS events FROM (
  SELECT who AS src, day AS dst, 'happened_on' AS relation, period FROM timed
  UNION ALL SELECT day, 'moment', 'is_a', period FROM timed) GROUP BY ALL""")
def link_to_day(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(
        F.lit("activity").alias("region"), F.concat(F.lit("user#"), F.col("user_id"))
        .alias("concept"), "ts", F.col("event_id").alias("seq"))
    linked = dates.link_to_day(rows, "ts")
    when = rows.select("seq", dates.day_period(F.hour("ts")).alias("period"))
    return (linked.join(when, "seq").groupBy("src", "dst", "relation", "period")
            .agg(F.count("*").alias("events")))


def _clue_sql(clues):
    single = [c for c in clues if " " not in c]
    multi = [c for c in clues if " " in c]
    return f"len(list_intersect(w, [{quoted(single)}]))" + "".join(
        f" + CASE WHEN contains(low, '{c}') THEN 2 ELSE 0 END" for c in multi)


@query("qualify_terms", f"""
WITH {SENTENCES},{parse_ctes('SELECT * FROM sents')},
sc AS (SELECT doc_id, pos, subject, lower(subject) AS ls, lower(text) AS low,
              list_distinct({words('lower(text)')}) AS w FROM parsed),
pt AS (SELECT *, {_clue_sql(fixed.PLACE_CLUES)} AS p, {_clue_sql(fixed.PEOPLE_CLUES)} AS e,
              {_clue_sql(fixed.LANGUAGE_CLUES)} AS g FROM sc)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, subject,
  CASE WHEN p >= 2 AND p - greatest(e, g) >= 2 THEN CASE WHEN ls LIKE '%ians' THEN left(ls, -4)
            WHEN ls LIKE '%ian' THEN left(ls, -3) ELSE ls END
       WHEN e >= 2 AND e - greatest(p, g) >= 2 THEN ls || ' people'
       WHEN g >= 2 AND g - greatest(p, e) >= 2 THEN ls || ' language' ELSE subject END AS qualified
FROM pt""")
def qualify_terms(spark, sf_dir):
    parsed = statements.parse_statements(tables.document_sentences(spark, sf_dir), "sentence")
    return parsed.select("doc_id", F.col("pos").cast("bigint"), "subject", qualify.qualify_term(
        F.col("subject"), F.col("sentence")).alias("qualified"))


@query("triage", """
WITH cases AS (
  SELECT o_orderkey, o_custkey, (o_orderkey % 11)::DOUBLE AS severity, o_orderstatus <> 'F' AS self_rescue,
    o_orderstatus = 'O' AS aware, CAST(o_custkey % 60 AS INTEGER) AS years,
    (o_orderkey % 5) / 4.0 AS reach FROM orders),
scored AS (SELECT o_orderkey, o_custkey, round(CASE WHEN severity = 0 THEN 0.0
  WHEN NOT self_rescue AND NOT aware THEN severity * 1000.0
  ELSE severity * CASE WHEN self_rescue THEN 1.0 ELSE 2.0 END * CASE WHEN aware THEN 1.0 ELSE 1.5 END
    * CASE WHEN years < 5 THEN 2.0 WHEN years < 18 THEN 1.5 ELSE 1.0 END * reach END::DOUBLE, 6)
  AS urgency FROM cases)
SELECT o_orderkey, urgency, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY urgency DESC)
  AS BIGINT) AS rank FROM scored""")
def triage(spark, sf_dir):
    """Orders read as cases, ranked per customer: key digits give severity and reach."""
    o = _table(spark, sf_dir, "orders")
    scored = o.select("o_orderkey", "o_custkey", F.round(measures.urgency(
        (F.col("o_orderkey") % 11).cast("double"), F.col("o_orderstatus") != "F",
        F.col("o_orderstatus") == "O", F.col("o_custkey") % 60,
        (F.col("o_orderkey") % 5) / F.lit(4.0)), 6).alias("urgency"))
    return measures.triage_rank(scored, ["o_custkey"]).select(
        "o_orderkey", "urgency", F.col("rank").cast("bigint"))


@query("render_statements", f"""
WITH {SENTENCES},{parse_ctes('SELECT * FROM sents')}
SELECT doc_id, CAST(pos AS BIGINT) AS pos, CASE
  WHEN relation = 'is_a' OR starts_with(relation, 'has_') THEN subject || ' is ' || obj
  WHEN relation = 'has' THEN subject || ' has ' || obj
  ELSE subject || ' ' || relation || ' ' || obj END AS statement FROM parsed""")
def render_statements(spark, sf_dir):
    parsed = statements.parse_statements(tables.document_sentences(spark, sf_dir), "sentence")
    return parsed.select("doc_id", F.col("pos").cast("bigint"), statements.render_statement(
        F.col("subject"), F.col("relation"), F.col("obj")).alias("statement"))


@query("teach_tentative_documents", f"""WITH {SENTENCES},
{parse_ctes("SELECT * FROM sents WHERE (" + rejection("text") + ") = ''")},
facts AS (SELECT 'documents' AS region, subject, relation, obj, ptype,
  CASE WHEN negated THEN 'refute' ELSE 'teach' END AS kind, source AS source_label,
  0.4::DOUBLE AS initial_strength, text AS source_text, doc_id * 1000000 + pos AS seq
  FROM parsed),{GRAPH}
SELECT src, dst, relation, traversals, refutations, witnesses, round(strength, 6) AS strength
FROM edges""")
def teach_tentative_documents(spark, sf_dir):
    sents = tables.document_sentences(spark, sf_dir).select(
        F.col("sentence").alias("text"), F.col("source").alias("source_label"),
        (F.col("doc_id") * 1_000_000 + F.col("pos")).alias("seq"))
    rows = teaching.teach_texts(sents, "tentative", region=F.lit("documents"))
    return evidence.fold_evidence(evidence.teach(rows)).select(
        "src", "dst", "relation", "traversals", "refutations", "witnesses",
        F.round("strength", 6).alias("strength"))


@query("teach_turns", f"""WITH {TURNS_SQL},
again AS (SELECT conv_id * 10000000000 + turn * 10000 + i AS seq, negated AS denied, CASE
    WHEN NOT negated THEN original
    WHEN relation = 'is_a' OR starts_with(relation, 'has_') THEN subject || ' is ' || obj
    WHEN relation = 'has' THEN subject || ' has ' || obj
    ELSE subject || ' ' || relation || ' ' || obj END AS text FROM parsed),
{parse_ctes("SELECT * FROM again", "2")},
facts AS (SELECT 'turns' AS region, subject, relation, obj, ptype,
  CASE WHEN denied THEN 'refute' ELSE 'teach' END AS kind, CAST(NULL AS VARCHAR) AS source_label,
  CAST(NULL AS DOUBLE) AS initial_strength, text AS source_text, seq FROM parsed2),{GRAPH}
SELECT src, dst, relation, traversals, refutations, round(strength, 6) AS strength FROM edges""")
def teach_turns(spark, sf_dir):
    conv = _table(spark, sf_dir, "conversations").withColumn(
        "seq", F.col("conv_id") * 10_000_000_000 + F.col("turn") * 10_000)
    rows = teaching.teach_turns(conv, ["conv_id", "turn"], region=F.lit("turns"))
    return evidence.fold_evidence(evidence.teach(rows)).select(
        "src", "dst", "relation", "traversals", "refutations",
        F.round("strength", 6).alias("strength"))
