"""Label resolution: exact, inflected, prefix, contained, then edit distance.

Each tier only sees the terms the tiers before it left over.  All look terms up in
the stored label index, and lose no match.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.qualify import place_form
from ..functions.strings import inflections
from ..sources.scratch import materialize
from .labelindex import LabelIndex, containing_labels, index_of, near_labels


def resolve_exact(df: DataFrame, nodes: DataFrame, column: str = "label") -> DataFrame:
    """Rows whose label is a node."""
    labels = nodes.select(F.col("label").alias(column)).distinct()
    return df.join(labels, column, "left_semi")


def _ranked(df: DataFrame, order: list, max_results: int = None) -> DataFrame:
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy("term").orderBy(*order)))
    return ranked if max_results is None else ranked.filter(F.col("rank") <= max_results)


def resolve(terms: DataFrame, nodes, max_results: int = None) -> DataFrame:
    """(term, label, distance, method, rank) of the first tier that matches.

    ``nodes`` is a LabelIndex, or a table with a label column, which is then indexed for
    this call.  Ties are ordered by label; the strongest result has rank 1.  ``max_results``
    keeps the best labels of a term, None all that the tier finds.
    """
    index = index_of(nodes)
    terms = materialize(terms.select("term").distinct(), "terms")
    cols = ["term", "label", "distance", "method", "rank"]

    # the term itself comes first, then its inflections in order
    spelled = terms.select("term", F.posexplode(F.concat(F.array("term"), inflections(F.col("term")))).alias("pos", "label"))
    known = spelled.join(index.labels, "label", "left_semi").groupBy("term", "label").agg(F.min("pos").alias("pos"))
    known = _ranked(known, ["pos"])
    exact = F.min("pos").over(W.partitionBy("term")) == 0
    known = known.withColumn("exact", exact).filter("NOT exact OR pos = 0").select(
        "term", "label", F.lit(0).alias("distance"), F.when(F.col("exact"), "exact").otherwise("inflect").alias("method"), "rank")
    known = materialize(known if max_results is None else known.filter(F.col("rank") <= max_results), "tier-spelled")
    rest = terms.join(known.select("term").distinct().hint("merge"), "term", "left_anti")

    inside = containing_labels(rest, index).withColumn("starts", F.startswith("label", F.col("term")))
    inside = inside.withColumn("any", F.max("starts").over(W.partitionBy("term"))).filter("starts OR NOT any")
    inside = materialize(_ranked(inside, [F.length("label"), "label"], max_results).select(
        "term", "label", F.lit(0).alias("distance"), F.when(F.col("starts"), "prefix").otherwise("contains").alias("method"),
        "rank"), "tier-contained")
    rest = rest.join(inside.select("term").distinct().hint("merge"), "term", "left_anti")

    gap = F.abs(F.length("term") - F.length("label"))
    if max_results is None:
        near = near_labels(rest, index)
    else:
        # terms with enough labels one edit away have their best ones, and are looked up no further
        close = materialize(near_labels(rest, index, within=1), "tier-close")
        enough = close.groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= max_results).select("term") \
            .hint("merge")
        rest = materialize(rest.join(enough, "term", "left_anti"), "terms-left")
        near = close.join(enough, "term", "left_semi").unionByName(near_labels(rest, index))
    fuzzy = _ranked(near, ["distance", gap, "label"], max_results).withColumn("method", F.lit("fuzzy"))
    return known.select(*cols).unionByName(inside.select(*cols)).unionByName(fuzzy.select(*cols))


def resolved_labels(asked: DataFrame, nodes, column: str = "label") -> DataFrame:
    """Rows of ``asked`` with the stored label that theirs resolves to; others are left out.

    ``nodes``: a LabelIndex or nodes, as for resolve.
    """
    best = resolve(asked.select(F.col(column).alias("term")), nodes, 1).select("term", F.col("label").alias("stored"))
    rows = asked.join(best.hint("merge"), F.col(column) == F.col("term")).drop("term")
    return rows.withColumn(column, F.col("stored")).drop("stored")


def did_you_mean(terms: DataFrame, nodes: DataFrame, paths: DataFrame,
                 index: LabelIndex = None, resolved: DataFrame = None) -> DataFrame:
    """Candidates of terms that only match by containment or edit distance.

    ``index``: the stored index over the nodes; ``resolved``: what resolve returned already.
    The description is the text of the first path recorded to the candidate, the least of those of one moment.
    """
    found = resolve(terms, nodes if index is None else index) if resolved is None else resolved
    loose = found.filter(F.col("method").isin("contains", "fuzzy"))
    first = (paths.join(loose.select(F.col("label").alias("terminus")).distinct(), "terminus", "left_semi")
             .groupBy(F.col("terminus").alias("label"))
             .agg(F.min(F.struct("seq", "part", "source_text"))["source_text"].alias("description")))
    types = nodes.select("label", "node_type").dropDuplicates(["label"])
    return (loose.join(types, "label").join(first, "label", "left")
            .fillna("", ["description"]))


def qualified_variants(terms: DataFrame, nodes: DataFrame) -> DataFrame:
    """(term, variant, nth): stored forms of a term: itself, place, people, language."""
    term = F.col("term")
    place = place_form(term)
    forms = F.array_compact(F.array(term, F.when(place != term, place),
                                    F.concat(term, F.lit(" people")),
                                    F.concat(term, F.lit(" language"))))
    every = terms.select("term").distinct().select(
        "term", F.posexplode(forms).alias("nth", "variant"))
    return every.join(nodes.select(F.col("label").alias("variant")).distinct(), "variant",
                      "left_semi")


def check_ambiguity(triples: DataFrame, nodes: DataFrame, paths: DataFrame, safety: list[str],
                    index: LabelIndex = None):
    """Split parsed statements into (clean, held) before teaching.

    ``triples`` is (statement_id, subject, obj, ...).  A statement is held when a
    term longer than three characters has several qualified variants, or is
    unknown and within two edits (or contained) of a stored label.  ``held`` has
    one row per (statement_id, term, candidate).
    """
    terms = triples.select("statement_id", F.explode(F.array("subject", "obj")).alias("term")) \
        .filter(F.length("term") > 3).distinct()
    asked = materialize(terms.select("term").distinct(), "ambiguous-terms")
    variants = qualified_variants(asked, nodes)
    many = variants.groupBy("term").agg(F.count("*").alias("n")).filter("n > 1")
    by_variant = variants.join(many, "term", "left_semi").select(
        "term", F.col("variant").alias("candidate"), F.lit(0).alias("distance"))
    rest = asked.join(many, "term", "left_anti")
    by_guess = did_you_mean(rest, nodes, paths, index).filter("distance <= 2").select(
        "term", F.col("label").alias("candidate"), "distance")
    found = materialize(by_variant.unionByName(by_guess), "candidates")
    held = terms.join(found, "term")
    words = held.groupBy("statement_id").agg(
        F.max(F.lower("candidate").isin(safety).cast("int")).alias("near"))
    said = triples.select("statement_id", (F.lower("subject").isin(safety)
                                           | F.lower("obj").isin(safety)).alias("own"))
    held = (held.join(words, "statement_id").join(said, "statement_id")
            .withColumn("safety", (F.col("near") == 1) | F.col("own")).drop("near", "own"))
    clean = triples.join(held.select("statement_id").distinct(), "statement_id", "left_anti")
    return clean, held
