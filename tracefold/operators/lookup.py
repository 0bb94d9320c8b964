"""Point lookups, asked for many labels at once."""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import fixed
from ..functions.strings import words
from ..sources.scratch import materialize
from .evidence import EDGE_KEY, chains_of, times
from .resolve import did_you_mean, resolve, resolved_labels
from .similar import similar_to
from .waves import top_per_group, trace


def neighbors(labels: DataFrame, edges: DataFrame, direction: str = "out",
              k: int = None) -> DataFrame:
    """Adjacent edges of each (region, label); with ``k`` only the strongest, ranked.

    Without ``k`` the rows are not numbered: a hub's edges stay spread, and a sort
    by (label, strength) splits them by range.
    """
    near = "src" if direction == "out" else "dst"
    asked = labels.select("region", F.col("label").alias(near)).distinct()
    out = edges.join(asked, ["region", near], "left_semi")
    if k is None:
        return out
    return top_per_group(out, ["region", near],
                         [F.desc(F.round("strength", 9)), "src", "dst", "relation"], k)


def find_edges(keys: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(keys.select(*EDGE_KEY).distinct(), EDGE_KEY, "left_semi")


def paths_to(labels: DataFrame, paths: DataFrame) -> DataFrame:
    return paths.join(labels.select("region", F.col("label").alias("terminus")).distinct(),
                      ["region", "terminus"], "left_semi")


def paths_from(labels: DataFrame, paths: DataFrame) -> DataFrame:
    return paths.join(labels.select("region", F.col("label").alias("origin")).distinct(),
                      ["region", "origin"], "left_semi")


def chain_weights(chains: DataFrame, edges: DataFrame, min_strength: float | None = None) -> DataFrame:
    """(chain, weight, weakest): mean and lowest step strength of each chain of the dictionary.

    A chain with any step below ``min_strength`` is left out; None keeps all.
    """
    out = (chains.join(edges.select(*EDGE_KEY, "strength"), EDGE_KEY).groupBy("chain")
           .agg(F.avg("strength").alias("weight"), F.min("strength").alias("weakest")))
    return out if min_strength is None else out.filter(F.col("weakest") >= min_strength)


def why(labels: DataFrame, paths: DataFrame, edges: DataFrame,
        min_strength: float | None = fixed.MIN_STRENGTH, chains: DataFrame = None) -> DataFrame:
    """Recorded paths that end at each label, with their signed weight.

    A path with any step below ``min_strength`` is left out; None keeps all.  ``chains``: the
    stored dictionary of the paths, else worked out here.
    """
    paths = paths_to(labels, paths)
    return paths.join(chain_weights(chains_of(paths) if chains is None else chains, edges, min_strength), "chain")


def why_counts(labels: DataFrame, paths: DataFrame, edges: DataFrame,
               min_strength: float | None = fixed.MIN_STRENGTH, chains: DataFrame = None, index=None) -> DataFrame:
    """(region, label, origin, source_text, weight, weakest, paths) of paths that end at each label.

    Statements repeat, chains do not: equal statements are counted per chain and text before
    weights are joined to them, so no statement meets a weight by itself.  With ``index``,
    labels are free terms that are resolved first.
    """
    if index is not None:
        labels = resolved_labels(labels, index)
    said = (paths_to(labels, paths).groupBy("region", F.col("terminus").alias("label"), "origin", "source_text", "chain")
            .agg(F.sum(times(paths)).alias("paths")))
    weighed = chain_weights(chains_of(paths) if chains is None else chains, edges, min_strength)
    return said.join(weighed, "chain").drop("chain")


def chain_of(fact_rows: DataFrame) -> DataFrame:
    """Both edges of every parsed fact."""
    mid = F.concat_ws("_", "subject", "ptype")
    return fact_rows.withColumn("edge", F.explode(F.array(
        F.struct(F.lit(0).alias("step"), F.col("obj").alias("src"), mid.alias("dst"),
                 F.col("relation").alias("rel")),
        F.struct(F.lit(1).alias("step"), mid.alias("src"), F.col("subject").alias("dst"),
                 F.lit("describes").alias("rel"))))) \
        .select("region", "statement_id", "edge.step", "edge.src", "edge.dst",
                F.col("edge.rel").alias("relation"))


def witness_count(fact_rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct sources of each fact: the lower count of its two edges, 0 if unknown."""
    counts = chain_of(fact_rows).join(edges.select(*EDGE_KEY, "witnesses"), EDGE_KEY, "left")
    return (counts.groupBy("region", "statement_id")
            .agg(F.min(F.coalesce("witnesses", F.lit(0))).alias("witness_count")))


def sources_for(fact_rows: DataFrame, witnesses: DataFrame) -> DataFrame:
    """Sources of each fact (first edge), numbered oldest first."""
    first = chain_of(fact_rows).filter("step = 0").drop("step")
    return (first.join(witnesses.hint("merge"), EDGE_KEY)
            .withColumn("nth", F.row_number().over(
                W.partitionBy("region", "statement_id").orderBy("first_seq", "source")))
            .select("region", "statement_id", "source", "nth"))


def prefix_hits(keywords: DataFrame, nodes: DataFrame, min_label: int = 3) -> DataFrame:
    """(query_id, region, label): labels equal to a keyword, or one a prefix of the other.

    Prefixes are exploded so both directions are equi joins.
    """
    def prefixes(df, column, other, wanted):
        """Prefixes of ``column`` as long as some value of ``wanted``."""
        lengths = wanted.select(F.length(other).alias("n")).distinct()
        return (df.withColumn("n", F.explode(F.sequence(F.lit(1), F.length(column))))
                .join(lengths, "n", "left_semi")
                .withColumn(other, F.substring(F.col(column), F.lit(1), F.col("n"))).drop("n"))
    labels = nodes.select("region", "label").filter(F.length("label") >= min_label)
    kw = keywords.select("query_id", "keyword").filter("keyword <> ''").distinct()
    longer = kw.join(prefixes(labels, "label", "keyword", kw), "keyword").select(
        "query_id", "region", "label")
    shorter = prefixes(kw, "keyword", "label", labels).select("query_id", "label") \
        .join(labels, "label").select("query_id", "region", "label")
    return longer.unionByName(shorter).distinct()


def context_keywords(queries: DataFrame) -> DataFrame:
    """Search words of (query_id, text): longer than two characters, no stop words."""
    return (queries.select("query_id", F.explode(words(F.lower("text"))).alias("keyword"))
            .filter(F.length("keyword") > 2)
            .filter(~F.col("keyword").isin(fixed.STOPWORD_SUBJECTS)).distinct())


def context(queries: DataFrame, nodes: DataFrame, paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Everything known about the words of a text: recorded paths to, and waves from, each hit."""
    hits = prefix_hits(context_keywords(queries), nodes)
    return hits.join(knowledge(hits.select("region", "label").distinct(), paths, edges),
                     ["region", "label"])


def knowledge(labels: DataFrame, paths: DataFrame, edges: DataFrame,
              min_strength: float = fixed.MIN_STRENGTH) -> DataFrame:
    """why + trace of each label as one table (label, kind, text, source_text, weight)."""
    to = why(labels, paths, edges, min_strength).select(
        "region", F.col("terminus").alias("label"), F.lit("why").alias("kind"),
        F.concat_ws(" → ", "origin", F.col("steps")[0]["dst"], "terminus").alias("text"),
        "source_text", "weight")
    away = trace(labels, edges, min_strength=min_strength).select(
        "region", "label", F.lit("trace").alias("kind"),
        F.array_join("path", " → ").alias("text"),
        F.lit(None).cast("string").alias("source_text"), "weight")
    return to.unionByName(away)


def rules_for(queries: DataFrame, nodes: DataFrame, paths: DataFrame, edges: DataFrame):
    """Recorded paths to every node named by a word of the text."""
    kw = (queries.select("query_id", F.explode(words(F.lower("text"))).alias("label"))
          .filter(F.length("label") > 2).distinct())
    hits = kw.join(nodes.select("region", "label"), "label")
    known = why(hits.select("region", "label"), paths, edges)
    return hits.join(known.withColumnRenamed("terminus", "label"), ["region", "label"])


def query_association(asked: DataFrame, paths: DataFrame, properties: DataFrame) -> DataFrame:
    """Properties of a subject under an association.

    ``asked`` (region, subject, association); ``properties`` (association,
    property) as listed by :func:`association_properties`.
    """
    # from the recorded paths outwards, so no subject meets a whole association
    held = paths.select("region", F.col("terminus").alias("subject"),
                        F.col("origin").alias("property")).distinct()
    return (held.join(properties, "property")
            .join(asked.select("region", "subject", "association").distinct(),
                  ["region", "subject", "association"], "left_semi")
            .select("region", "subject", "association", "property").distinct())


def refuted_answers(weighed: DataFrame) -> DataFrame:
    """Believed / refuted / contested counts per recorded text of each label."""
    refuted, none = F.col("weight") < 0, F.lit(0).cast("bigint")
    return (weighed.groupBy("region", F.col("terminus").alias("label"), "source_text")
            .agg(F.sum(F.when(~refuted, times(weighed)).otherwise(none)).alias("taught"),
                 F.sum(F.when(refuted, times(weighed)).otherwise(none)).alias("refuted"))
            .withColumn("standing", F.when(F.col("refuted") == 0, "believed")
                        .when(F.col("taught") == 0, "refuted").otherwise("contested")))


def summarize(labels: DataFrame, paths: DataFrame, edges: DataFrame, pairs: DataFrame):
    """(region, label, kind, text, value): recorded paths to, and nodes similar to, a label.

    Counted paths are listed as often as they were recorded.
    """
    known = why(labels, paths, edges)
    if "times" in paths.columns:
        known = known.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    to = known.select(
        "region", F.col("terminus").alias("label"), F.lit("path").alias("kind"),
        F.concat_ws(" → ", "origin", F.col("steps")[0]["dst"], "terminus").alias("text"),
        F.col("weight").alias("value"))
    near = similar_to(labels, pairs).select(
        "region", "label", F.lit("similar").alias("kind"), F.col("other").alias("text"),
        F.col("overlap").alias("value"))
    return to.unionByName(near)


def query_topics(topics: DataFrame, nodes: DataFrame, paths: DataFrame, edges: DataFrame, index=None):
    """All that is known about free topics (region, topic); suggestions where nothing is.

    Returns (topic, label, kind, text, weight) with kind why, trace or did_you_mean.
    """
    resolved = materialize(resolve(topics.select(F.lower("topic").alias("term")), nodes if index is None else index),
                           "topics")
    best = resolved.filter("rank = 1").select(F.col("term").alias("topic"), "label")
    asked = nodes.select("region", "label").join(best.select("label").distinct(), "label",
                                                 "left_semi")
    known = best.join(knowledge(asked, paths, edges), "label").select(
        "topic", "label", "kind", "text", "weight")
    nothing = resolved.join(known.select(F.col("topic").alias("term")).distinct(), "term",
                            "left_anti")
    guesses = did_you_mean(None, nodes, paths, resolved=nothing).select(
        F.col("term").alias("topic"), "label", F.lit("did_you_mean").alias("kind"),
        F.col("description").alias("text"), F.lit(None).cast("double").alias("weight"))
    return known.unionByName(guesses)
