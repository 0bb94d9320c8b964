"""Content words of questions, sentences and proposals."""

from pyspark.sql import Column, functions as F

from . import fixed
from .strings import cut, lit_array, strip_chars, words


def _not_in(values):
    return lambda w: ~F.array_contains(lit_array(values), w)


def raw_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z'-]+)"), F.lit(1))


def concept_words(text: Column, stops) -> Column:
    """Words of four or more letters outside ``stops``; repeats are kept."""
    return F.filter(raw_words(text), lambda w: (F.length(w) >= 4) & _not_in(stops)(w))


def _stems(w: Column, doubled: bool, es_form: bool) -> Column:
    n = F.length(w)

    def ends(s):
        return F.endswith(w, F.lit(s))
    none = F.lit(None).cast("string")
    er = F.when(ends("er") & (n > 4), cut(w, 2)).otherwise(none)
    twice = F.when(ends("er") & (n > 5) & (F.substring(w, -3, 1) == F.substring(w, -4, 1)),
                   cut(w, 3)).otherwise(none)
    est = F.when(ends("est") & (n > 5), cut(w, 3)).otherwise(none)
    ly = F.when(ends("ly") & (n > 4), cut(w, 2)).otherwise(none)
    ing = ends("ing") & (n > 5)
    bare = F.when(ing, cut(w, 3)).otherwise(none)
    with_e = F.when(ing, F.concat(cut(w, 3), F.lit("e"))).otherwise(none)
    plural = ends("s") & ~ends("ss") & (n > 4)
    forms = [w, er] + ([twice] if doubled else []) + [est, ly, bare, with_e]
    if es_form:
        es = ends("es") & (n > 4)
        forms += [F.when(es, cut(w, 2)).otherwise(none),
                  F.when(es | plural, cut(w, 1)).otherwise(none)]
    else:
        forms += [F.when(plural, cut(w, 1)).otherwise(none)]
    return F.array_compact(F.array(*forms))


def extract_words(text: Column, profile: str = "question") -> Column:
    """Distinct content words with their stems, in order of appearance.

    'question' and 'round' differ in stop list and plural rule.
    """
    question = profile == "question"
    stops = fixed.QUESTION_STOPS if question else fixed.ROUND_STOPS
    base = F.filter(raw_words(text), lambda w: (F.length(w) >= 4) & _not_in(stops)(w))
    forms = F.flatten(F.transform(base, lambda w: _stems(w, question, question)))
    return F.array_distinct(F.filter(forms, lambda f: (F.length(f) >= 3) & _not_in(stops)(f)))


def grounding_words(text: Column) -> Column:
    """Content words of a sentence to check against the graph; repeats count."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z']+)"), F.lit(1))
    return F.filter(found, lambda w: (F.length(w) > 3) & _not_in(fixed.GROUNDING_SKIP)(w))


def topic_words(text: Column) -> Column:
    """Candidate topics of a question, for the no-knowledge check."""
    w = F.transform(words(F.lower(text)), lambda x: strip_chars(x, fixed.EDGE_PUNCTUATION))
    return F.filter(w, lambda x: (F.length(x) > 3) & _not_in(fixed.TOPIC_SKIP)(x))


def digest_words(text: Column) -> Column:
    """Words of a statement that may be concepts: not innate, no stop word, length > 2."""
    innate = [w for ws in fixed.PRIMITIVES.values() for w in ws.split()]
    skip = list(dict.fromkeys(innate + fixed.STOPWORD_SUBJECTS + ["a", "an", "the", "will",
                                                                  "shall"]))
    w = F.transform(words(F.lower(text)), lambda x: strip_chars(x, fixed.EDGE_PUNCTUATION))
    return F.array_distinct(F.filter(w, lambda x: (F.length(x) > 2) & _not_in(skip)(x)))


def proposal_words(text: Column) -> Column:
    """Identifiers of a proposal outside the stop list, unique, longer than two letters."""
    w = F.regexp_extract_all(F.lower(text), F.lit("([a-zA-Z_][a-zA-Z0-9_]*)"), F.lit(1))
    return F.array_distinct(F.filter(w, lambda x: (F.length(x) > 2)
                                     & _not_in(fixed.PROPOSAL_STOPS)(x)))


def retrieval_words(text: Column) -> Column:
    """Distinct question words for overlap retrieval."""
    skip = fixed.STOPWORD_SUBJECTS + ["the", "a", "an", "will", "shall"]
    w = F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z']+)"), F.lit(1))
    return F.array_distinct(F.filter(w, lambda x: (F.length(x) > 2) & _not_in(skip)(x)))


def primitive_layers(label: Column) -> Column:
    """Innate layers a label belongs to (may be several)."""
    low = F.lower(strip_chars(label, " "))
    return F.array_compact(F.array(*[
        F.when(low.isin(ws.split()), F.lit(layer)) for layer, ws in fixed.PRIMITIVES.items()]))


def content_label(prefix: str, stem: Column, content: Column) -> Column:
    """Label of a piece of content: prefix, name and the first digits of its SHA-256."""
    name = F.replace(F.lower(stem), F.lit(" "), F.lit("_"))
    return F.concat_ws("_", F.lit(prefix), name, F.substring(F.sha2(content, 256), 1, 6))
