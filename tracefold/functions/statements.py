"""Statement parsing with native column expressions.

``parse_statements`` turns a text column into (subject, relation, obj, ptype,
negated, original) rows; texts that are not statements are dropped.
"""

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed
from .strings import let, lit_array, singular, strip, words


def property_type(label: Column) -> Column:
    """Built-in property type of a label ('attribute' when unknown)."""
    lookup = F.create_map(*[F.lit(x) for x in itertools.chain(*fixed.PROPERTY_TYPES.items())])
    return F.coalesce(F.element_at(lookup, F.lower(label)), F.lit("attribute"))


def category(label: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for x in itertools.chain(*fixed.CATEGORIES.items())])
    return F.coalesce(F.element_at(lookup, F.lower(label)), F.lit("thing"))


def with_taxonomy(df: DataFrame, properties: DataFrame = None,
                  categories: DataFrame = None) -> DataFrame:
    """Add ptype, category and relation_label; dynamic rows override built-ins.

    ``properties`` (label, ptype) and ``categories`` (label, category) hold at
    most one row per label.
    """
    ptype, cat = property_type(F.col("obj")), category(F.col("subject"))
    if properties is not None:
        df = df.join(properties.select(F.col("label").alias("obj"),
                                       F.col("ptype").alias("dyn_ptype")), "obj", "left")
        ptype = F.coalesce(F.col("dyn_ptype"), ptype)
    if categories is not None:
        df = df.join(categories.select(F.col("label").alias("subject"),
                                       F.col("category").alias("dyn_cat")), "subject", "left")
        cat = F.coalesce(F.col("dyn_cat"), cat)
    out = df.withColumns({"ptype": ptype, "category": cat})
    return (out.withColumn("relation_label", F.concat_ws("_", "subject", "ptype"))
            .drop("dyn_ptype", "dyn_cat"))


def parse_struct(text: Column, strict: bool = False) -> Column:
    """Struct (subject, verb, obj, negated) of a statement, null if it is none."""
    def has(arr, c):
        return F.array_contains(arr, c)
    verbs = lit_array(fixed.COPULAS + fixed.POSSESSION + fixed.RELATION_VERBS)
    pronouns = lit_array(fixed.PRONOUNS)

    tokens = words(F.lower(text))
    if not strict:
        tokens = F.filter(tokens, lambda w: ~has(lit_array(fixed.ARTICLES), w))

    def at(w, i):
        return F.get(w, i)

    def locate(w):
        idx = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)))
        aux = F.array_min(F.filter(idx, lambda i: has(lit_array(fixed.AUXILIARIES), at(w, i))
                                   & (i + 2 < F.size(w)) & (at(w, i + 1) == "not")
                                   & (F.length(at(w, i + 2)) > 1)
                                   & ~has(lit_array(fixed.ARTICLES), at(w, i + 2))))
        verb = F.array_min(F.filter(idx, lambda i: has(verbs, at(w, i))))
        return F.struct(w.alias("w"), aux.alias("aux"), F.coalesce(aux, verb).alias("v"))

    def cut(p):
        w, aux, v = p["w"], p["aux"], p["v"]
        size = F.size(w)
        rest = F.slice(w, v + 2, F.greatest(size - v - 1, F.lit(0)))
        negator = has(lit_array(fixed.NEGATORS), F.get(rest, F.lit(0)))
        plain = F.when(negator, F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0)))) \
            .otherwise(rest)
        obj = F.when(aux.isNotNull(), F.slice(w, v + 4, F.greatest(size - v - 3, F.lit(0)))) \
            .otherwise(plain)
        raw = F.slice(w, 1, v)
        ok = (size >= 3) & v.isNotNull() & (v > 0) & (v < size - 1) & (F.size(obj) > 0) \
            & ~((F.size(raw) == 1) & has(pronouns, F.get(raw, F.lit(0))))
        return F.when(ok, F.struct(
            singular(F.array_join(raw, " ")).alias("subject"),
            F.when(aux.isNotNull(), at(w, v + 2)).otherwise(at(w, v)).alias("verb"),
            F.array_join(obj, " ").alias("obj"),
            (aux.isNotNull() | F.coalesce(negator, F.lit(False))).alias("negated")))

    def check(p):
        sw = words(p["subject"])
        return F.when((F.size(sw) <= 4) & ~F.arrays_overlap(sw, pronouns), p)

    return let(let(let(tokens, locate), cut), check)


def relation_of(verb: Column, ptype: Column) -> Column:
    return (F.when(verb.isin(fixed.COPULAS),
                   F.when(ptype != "attribute", F.concat(F.lit("has_"), ptype))
                   .otherwise("is_a"))
            .when(verb.isin(fixed.POSSESSION), "has").otherwise(verb))


def parse_statements(df: DataFrame, text: str = "text", strict: bool = False,
                     properties: DataFrame = None) -> DataFrame:
    """Add subject, relation, obj, ptype, negated, original; keep statements only."""
    parsed = (df.withColumn("_p", parse_struct(F.col(text), strict))
              .filter(F.col("_p").isNotNull())
              .withColumns({"subject": F.col("_p.subject"), "obj": F.col("_p.obj"),
                            "verb": F.col("_p.verb"), "negated": F.col("_p.negated"),
                            "original": strip(F.col(text))})
              .drop("_p"))
    typed = with_taxonomy(parsed, properties).drop("category", "relation_label")
    return typed.withColumn("relation", relation_of(F.col("verb"), F.col("ptype"))).drop("verb")


def render_statement(subject: Column, relation: Column, obj: Column) -> Column:
    """Positive sentence of a triple (also used to refute a negated fact)."""
    return (F.when((relation == "is_a") | F.startswith(relation, F.lit("has_")),
                   F.concat_ws(" is ", subject, obj))
            .when(relation == "has", F.concat_ws(" has ", subject, obj))
            .otherwise(F.concat_ws(" ", subject, relation, obj)))


def render_path(origin: Column, middle: Column, terminus: Column, source_text: Column) -> Column:
    """Sentence of a recorded path: its own text, else a template by relation."""
    last = F.element_at(F.split(middle, "_"), -1)
    relation = F.when(~F.contains(middle, F.lit("_")), "is_a") \
        .when(last == "attribute", "is_a").otherwise(F.concat(F.lit("has_"), last))
    rows = list(itertools.chain(*[(F.lit(k), F.lit(v)) for k, v in fixed.TEMPLATES.items()]))
    template = F.coalesce(F.element_at(F.create_map(*rows), relation),
                          F.lit("{subject} {relation} {object}."))
    filled = F.replace(F.replace(F.replace(
        template, F.lit("{subject}"), terminus), F.lit("{object}"), origin),
        F.lit("{relation}"), F.translate(relation, "_", " "))
    own = source_text.isNotNull() & (source_text != "") \
        & ~F.startswith(source_text, F.lit("[cleanup]"))
    return F.when(own, F.concat(F.regexp_replace(source_text, r"\.+$", ""), F.lit("."))) \
        .otherwise(filled)
