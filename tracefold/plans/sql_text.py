"""SQL text of the statement grammar and text clean-up, for RE2 and list lambdas."""

from ..functions import fixed
from ..functions.fixed import WORD, WS

NOT_WORD = "[^" + WORD[1:]


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda q: q <> '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sentences(x: str) -> str:
    return f"string_split(regexp_replace({x}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))"


def replace_all(x: str, pairs) -> str:
    for old, new in pairs:
        x = f"replace({x}, '" + old.replace("'", "''") + "', '" + new.replace("'", "''") + "')"
    return x


def _ptype(obj: str) -> str:
    cases = " ".join(f"WHEN '{w}' THEN '{t}'" for w, t in fixed.PROPERTY_TYPES.items())
    return f"CASE lower({obj}) {cases} ELSE 'attribute' END"


def parse_ctes(source: str, tag: str = "") -> str:
    """CTE parsed{tag}(<source columns>, subject, relation, obj, ptype, negated) over text."""
    arts, aux = quoted(fixed.ARTICLES), quoted(fixed.AUXILIARIES)
    verbs = quoted(fixed.COPULAS + fixed.POSSESSION + fixed.RELATION_VERBS)
    pron = quoted(fixed.PRONOUNS)
    neg = quoted(fixed.NEGATORS)
    return f"""
p0{tag} AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '{WS}+'),
              lambda q: q <> '' AND q NOT IN ({arts})) AS w FROM ({source})),
p1{tag} AS (SELECT *,
  list_min(list_filter(range(1, len(w) + 1), lambda i: w[i] IN ({aux}) AND i + 2 <= len(w)
     AND w[i + 1] = 'not' AND length(w[i + 2]) > 1 AND w[i + 2] NOT IN ({arts}))) AS ax,
  list_min(list_filter(range(1, len(w) + 1), lambda i: w[i] IN ({verbs}))) AS vb FROM p0{tag}),
p2{tag} AS (SELECT *, coalesce(ax, vb) AS v FROM p1{tag}
            WHERE coalesce(ax, vb) > 1 AND coalesce(ax, vb) < len(w) AND len(w) >= 3),
p3{tag} AS (SELECT * EXCLUDE (ax, vb), w[1:v - 1] AS raw,
  CASE WHEN ax IS NOT NULL THEN w[v + 2] ELSE w[v] END AS verb,
  ax IS NOT NULL OR w[v + 1] IN ({neg}) AS negated,
  CASE WHEN ax IS NOT NULL THEN w[v + 3:] WHEN w[v + 1] IN ({neg}) THEN w[v + 2:]
       ELSE w[v + 1:] END AS ow FROM p2{tag}),
p4{tag} AS (SELECT * EXCLUDE (w, v, ow), array_to_string(raw, ' ') AS s,
                   array_to_string(ow, ' ') AS obj
            FROM p3{tag} WHERE len(ow) > 0 AND NOT (len(raw) = 1 AND raw[1] IN ({pron}))),
p5{tag} AS (SELECT * EXCLUDE (raw, s),
  CASE WHEN s LIKE '%ies' THEN left(s, -3) || 'y'
       WHEN regexp_matches(s, '(ches|shes|xes|zes|ses)$') THEN left(s, -2)
       WHEN s LIKE '%s' AND s NOT LIKE '%ss' THEN left(s, -1) ELSE s END AS subject,
  {_ptype('obj')} AS ptype FROM p4{tag}),
parsed{tag} AS (SELECT * EXCLUDE (verb),
  CASE WHEN verb IN ({quoted(fixed.COPULAS)}) THEN
         CASE WHEN ptype = 'attribute' THEN 'is_a' ELSE 'has_' || ptype END
       WHEN verb IN ({quoted(fixed.POSSESSION)}) THEN 'has' ELSE verb END AS relation
  FROM p5{tag} WHERE len({words('subject')}) <= 4
    AND NOT list_has_any({words('subject')}, [{pron}]))"""


SENTENCES = f"""sents AS (
  SELECT doc_id, source, i - 1 AS pos, {strip('s[i]')} AS text FROM
    (SELECT doc_id, source, {sentences('text')} AS s FROM documents),
    LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i) WHERE {strip('s[i]')} <> '')"""

DOCUMENT_FACTS = f"""
SELECT 'documents' AS region, subject, relation, obj, ptype, 'teach' AS kind, source AS source_label,
       CAST(NULL AS DOUBLE) AS initial_strength, text AS source_text,
       doc_id * 1000000 + pos AS seq, negated FROM parsed"""


def with_documents(body: str, extra: str = "", recursive: bool = False) -> str:
    """``body`` over the graph tables of the document statements."""
    from .sql import GRAPH
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (f"{head}{SENTENCES},{parse_ctes('SELECT * FROM sents')},\n"
            f"facts AS ({DOCUMENT_FACTS}),{GRAPH}{extra}\n{body}")


def html_text(x: str, profile: str) -> str:
    tags = ["script", "style"] + (["nav", "footer"] if profile == "article" else [])
    for tag in tags:
        x = f"regexp_replace({x}, '(?s)<{tag}[^>]*>.*?</{tag}>', '', 'g')"
    if profile == "article":
        for cls in ("sidebar", "reflist"):
            x = (f"regexp_replace({x}, '(?s)<div[^>]*class=\"[^\"]*{cls}[^\"]*\"[^>]*>.*?</div>',"
                 " '', 'g')")
        x = f"regexp_replace({x}, '\\[[0-9]+\\]', '', 'g')"
    x = f"regexp_replace({x}, '(?i)</?({fixed.BLOCK_TAGS})[^>]*>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    if profile == "article":
        x = replace_all(x, fixed.HTML_ENTITIES.items())
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    x = f"regexp_replace({x}, '\\n[ \\t]*\\n(?:\\n|{WS})*', chr(10) || chr(10), 'g')"
    return strip(x)


def rejection(x: str) -> str:
    s = strip(x)
    subj = (f"CASE WHEN regexp_matches({s}, '{WS}(is|are|was|were|has|have|had|requires|contains)"
            f"{WS}') THEN {strip(f'''regexp_extract({s}, '(?s)^(.*?){WS}+(?:is|are|was|were|has|have|had|requires|contains){WS}', 1)''')}"
            f" ELSE {s} END")
    return f"""CASE WHEN {s} = '' THEN 'empty'
  WHEN regexp_matches({s}, '(?i)(doi:|https?://|www\\.)') THEN 'url_or_doi'
  WHEN regexp_matches({s}, '(^|{NOT_WORD})[A-Z][a-z''-]+{WS}+\\([0-9]{{4}}\\)')
    THEN 'author_year_citation'
  WHEN regexp_matches({s}, '\\[[0-9]+\\]') THEN 'reference_bracket'
  WHEN regexp_matches({s}, '(?i)(^|{NOT_WORD})et{WS}+al') THEN 'et_al_attribution'
  WHEN length({s}) > 220 THEN 'too_long' WHEN length({s}) < 6 THEN 'too_short'
  WHEN {subj} = '' THEN 'no_subject'
  WHEN lower({subj}) IN ({quoted(fixed.STOPWORD_SUBJECTS)}) THEN 'stopword_subject'
  WHEN lower({subj}) IN ({quoted(fixed.ARTICLES)}) THEN 'article_subject'
  WHEN lower({subj}) IN ({quoted(fixed.PRONOUNS)}) THEN 'pronoun_subject'
  WHEN len({words(subj)}) > 6 THEN 'subject_too_long' ELSE '' END"""


def strip_punct(x: str) -> str:
    return f"regexp_replace({x}, '^[.,;:!?\"''()-]+|[.,;:!?\"''()-]+$', '', 'g')"


def stems(question: bool) -> str:
    """List expression of the stem forms of word q."""
    forms = ["q", "CASE WHEN q LIKE '%er' AND length(q) > 4 THEN left(q, -2) END"]
    if question:
        forms.append("CASE WHEN q LIKE '%er' AND length(q) > 5 AND q[-3] = q[-4] "
                     "THEN left(q, -3) END")
    forms += ["CASE WHEN q LIKE '%est' AND length(q) > 5 THEN left(q, -3) END",
              "CASE WHEN q LIKE '%ly' AND length(q) > 4 THEN left(q, -2) END",
              "CASE WHEN q LIKE '%ing' AND length(q) > 5 THEN left(q, -3) END",
              "CASE WHEN q LIKE '%ing' AND length(q) > 5 THEN left(q, -3) || 'e' END"]
    if question:
        forms += ["CASE WHEN q LIKE '%es' AND length(q) > 4 THEN left(q, -2) END",
                  "CASE WHEN length(q) > 4 AND (q LIKE '%es' OR (q LIKE '%s' AND q NOT LIKE '%ss'))"
                  " THEN left(q, -1) END"]
    else:
        forms.append("CASE WHEN length(q) > 4 AND q LIKE '%s' AND q NOT LIKE '%ss' "
                     "THEN left(q, -1) END")
    return "[" + ", ".join(forms) + "]"


def content_words(x: str, question: bool) -> str:
    """List of distinct stemmed content words of x (order not kept)."""
    stops = quoted(fixed.QUESTION_STOPS if question else fixed.ROUND_STOPS)
    base = (f"list_filter(regexp_extract_all(lower({x}), '[a-z][a-z''-]+'), "
            f"lambda q: length(q) >= 4 AND q NOT IN ({stops}))")
    return (f"list_distinct(list_filter(flatten(list_transform({base}, lambda q: "
            f"{stems(question)})), lambda q: q IS NOT NULL AND length(q) >= 3 "
            f"AND q NOT IN ({stops})))")
