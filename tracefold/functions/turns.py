"""Conversation turns: kind, topics, source, quantifiers and extracted facts."""

import functools

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed
from .fixed import WS
from .statements import parse_struct, property_type, relation_of
from .strings import let, lit_array, strip, strip_chars, words


def _member(c: Column, values) -> Column:
    return F.array_contains(lit_array(values), c)


def _splitter(regex: str):
    return lambda p: F.split(p, regex)


def split_compound(text: Column) -> Column:
    """Sub-statements: sentence ends first, then conjunctions, in a fixed order."""
    parts = F.array(text)
    for sep in fixed.SENTENCE_TERMINATORS + fixed.CONJUNCTIONS:
        regex = "".join("\\" + ch if ch in ".?!" else ch for ch in sep)
        parts = F.flatten(F.transform(parts, _splitter(regex)))
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def quantifier_weight(text: Column) -> Column:
    w = words(F.lower(text))
    return (F.when(F.arrays_overlap(w, lit_array(fixed.QUANTIFIERS_HIGH)), 1.0)
            .when(F.arrays_overlap(w, lit_array(fixed.QUANTIFIERS_LOW)), 0.5)
            .when(F.arrays_overlap(w, lit_array(fixed.QUANTIFIERS_NEGATING)), 0.2)
            .otherwise(1.0))


def strip_quantifiers(text: Column) -> Column:
    every = lit_array(fixed.QUANTIFIERS_HIGH + fixed.QUANTIFIERS_LOW
                      + fixed.QUANTIFIERS_NEGATING)
    return F.array_join(F.filter(words(text), lambda w: ~F.array_contains(every, F.lower(w))),
                        " ")


def extract_source(text: Column) -> Column:
    """Struct (source, body) of a text that opens by citing someone."""
    low = F.lower(text)
    rest = F.lit(None).cast("string")
    for phrase in reversed(fixed.SOURCE_PHRASES):
        rest = F.when(F.startswith(low, F.lit(phrase)),
                      strip(F.substr(text, F.lit(len(phrase) + 1)))).otherwise(rest)
    verb = rf"(?isU)^(.*?)\b(?:says|that|claims|tells us)(?:,|{WS})+(.*)$"

    def cut(rest):
        by_verb = rest.rlike(verb)
        by_comma = F.contains(rest, F.lit(","))
        source = F.when(by_verb, F.regexp_replace(strip(F.regexp_extract(rest, verb, 1)),
                                                  "[,.:;]+$", "")) \
            .when(by_comma, F.regexp_replace(strip(F.substring_index(rest, ",", 1)),
                                             "[.:;]+$", ""))
        body = F.when(by_verb, strip(F.regexp_extract(rest, verb, 2))) \
            .when(by_comma, strip(F.regexp_replace(rest, "(?s)^[^,]*,", ""))).otherwise(text)
        return F.struct(source.alias("source"), body.alias("body"))
    return let(rest, cut)


def is_greeting(low: Column) -> Column:
    return _member(F.get(words(low), F.lit(0)), fixed.GREETINGS) | low.isin(fixed.GREETINGS)


def association_topics(low: Column) -> Column:
    """Topics of an association request, null if the turn is none."""
    clean = strip(F.regexp_replace(low, "[?.!]+$", ""))

    def topics(c):
        t = F.transform(words(c), lambda w: strip_chars(w, fixed.EDGE_PUNCTUATION))
        t = F.filter(t, lambda w: (F.length(w) > 1) & ~_member(w, fixed.TURN_STOPWORDS))
        return F.when(F.size(t) > 0, t)
    asked = F.lit(None).cast("string")
    for phrase in reversed(fixed.ASSOCIATION_PHRASES):
        asked = F.when(F.startswith(clean, F.lit(phrase)),
                       F.substr(clean, F.lit(len(phrase) + 1))).otherwise(asked)
    w = words(clean)
    verbless = ~F.arrays_overlap(w, lit_array(fixed.QUESTION_PREFIXES + fixed.COPULAS
                                              + fixed.POSSESSION))
    bare = (F.size(w) >= 1) & (F.size(w) <= 4) & verbless
    return F.when(asked.isNotNull(), topics(asked)).when(bare, topics(clean))


def is_question(low: Column) -> Column:
    return F.endswith(low, F.lit("?")) | F.coalesce(
        _member(F.get(words(low), F.lit(0)), fixed.QUESTION_PREFIXES), F.lit(False))


def question_topics(low: Column) -> Column:
    w = words(F.replace(low, F.lit("?"), F.lit("")))
    w = F.when(_member(F.get(w, F.lit(0)), fixed.QUESTION_PREFIXES),
               F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))).otherwise(w)
    w = F.transform(w, lambda x: strip_chars(x, fixed.EDGE_PUNCTUATION))
    return F.filter(w, lambda x: (F.length(x) > 2) & ~_member(
        x, fixed.TURN_STOPWORDS + fixed.QUESTION_PREFIXES + fixed.ARTICLES))


def turn_facts(body: Column, strict: bool = False) -> Column:
    """Array of facts parsed from the sub-statements of a turn."""
    def fact(s):
        p = parse_struct(strip_quantifiers(s), strict)
        ptype = property_type(p["obj"])
        return F.when(p.isNotNull(), F.struct(
            p["subject"].alias("subject"), relation_of(p["verb"], ptype).alias("relation"),
            p["obj"].alias("obj"), ptype.alias("ptype"), p["negated"].alias("negated"),
            quantifier_weight(s).alias("confidence"), s.alias("original_text")))
    return F.array_compact(F.transform(split_compound(body), fact))


def classify_turns(df: DataFrame, text: str = "text", strict: bool = False) -> DataFrame:
    """Add kind, topics, source and facts to a table of turns."""
    df = (df.withColumn("_t", strip(F.col(text))).withColumn("_low", F.lower("_t"))
          .withColumn("_assoc", association_topics(F.col("_low"))))
    early = (F.when(F.col("_t") == "", "unknown").when(is_greeting(F.col("_low")), "greeting")
             .when(F.col("_assoc").isNotNull(), "association")
             .when(is_question(F.col("_low")), "question"))
    df = df.withColumn("_early", early).withColumn("_src", extract_source(F.col("_t")))
    df = df.withColumn("facts", F.when(F.col("_early").isNull(),
                                       turn_facts(F.col("_src.body"), strict)))
    negated = F.exists("facts", lambda f: f["negated"])
    kind = (F.when(F.col("_early").isNotNull(), F.col("_early"))
            .when(F.size("facts") == 0, "unknown")
            .when(negated & (F.size("facts") == 1), "negation")
            .when(negated, "correction").otherwise("statement"))
    topics = F.when(F.col("_early") == "association", F.col("_assoc")) \
        .when(F.col("_early") == "question", question_topics(F.col("_low")))
    return (df.withColumns({"kind": kind, "topics": topics,
                            "source": F.when(F.col("_early").isNull(), F.col("_src.source"))})
            .drop("_t", "_low", "_assoc", "_early", "_src"))


_PREFIX = "(?i)^(?:" + "|".join(
    "\\Q" + p + "\\E" for p in sorted(fixed.CORRECTION_PREFIXES, key=len, reverse=True)) + ")"


def detect_correction(text: Column) -> Column:
    """Corrected statement of a turn; '' for a bare refusal, null if no correction.

    Up to three nested prefixes are removed; a comma tail that parses on its own
    is preferred to the full remainder.
    """
    def unprefix(p):
        hit = p["cleaned"].rlike(_PREFIX)
        rest = strip(F.regexp_replace(F.regexp_replace(p["cleaned"], _PREFIX, ""),
                                      "^[,.:; ]+", ""))
        return F.struct(F.when(hit, rest).otherwise(p["cleaned"]).alias("cleaned"),
                        (p["found"] | hit).alias("found"))

    def choose(p):
        parts = F.split(p["cleaned"], ",")
        tails = F.transform(F.when(F.size(parts) >= 2, F.sequence(F.lit(2), F.size(parts)))
                            .otherwise(F.array().cast("array<int>")),
                            lambda i: strip(F.array_join(F.slice(parts, i, F.size(parts)), ",")))
        good = F.filter(tails, lambda t: (t != "") & F.coalesce(
            ~F.contains(parse_struct(t)["subject"], F.lit(",")), F.lit(False)))
        return F.when(p["found"], F.when(p["cleaned"] == "", "").otherwise(
            F.coalesce(F.get(good, F.lit(0)), p["cleaned"])))

    state = F.struct(strip(text).alias("cleaned"), F.lit(False).alias("found"))
    for _ in range(3):
        state = let(state, unprefix)
    return let(state, choose)
