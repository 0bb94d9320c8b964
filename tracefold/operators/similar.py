"""Path similarity of property nodes."""

from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import materialize
from .waves import reach_kinds

BLOCK = 2000
#: Relations that mark a standing instead of saying something about a node.
MARKERS = ("refutation_of", "refutation_status", "cleanup_reviewed", "cleanup_action",
           "cleanup_cluster")


def downstream(nodes: DataFrame, edges: DataFrame, depth: int = 10, markers=MARKERS) -> DataFrame:
    """(region, prop, node, times): what every property node reaches, not over ``markers`` relations.

    A row stands for the ``times`` nodes of one kind, which the same properties reach.
    """
    props = nodes.filter("node_type = 'property'").select("region", "label")
    edges = edges.filter(~F.col("relation").isin(list(markers))) if markers else edges
    reached, members = reach_kinds(props, edges, depth)
    many = members.groupBy("region", "kind").agg(F.count("*").alias("times"))
    return reached.join(many, ["region", "kind"]).select(
        "region", F.col("seed").alias("prop"), F.col("kind").alias("node"), "times")


def similarity(nodes: DataFrame, edges: DataFrame, depth: int = 10, labels: DataFrame = None,
               min_shared: int = 1, markers=MARKERS) -> DataFrame:
    """Property pairs that share downstream nodes: shared count and overlap ratio.

    Relations that mark a standing (refuted, reviewed) lead to one node from
    everywhere and would pair every property with every other; ``markers`` leaves
    them out of reach.  ``labels`` (region, label) keeps pairs with one of the
    labels, before pairs are built; ``min_shared`` keeps pairs that share as many nodes.

    Nodes of one kind are merged before properties are expanded (waves.equal_nodes), and nodes
    reached by exactly the same properties into one
    weighted node, so a pair is met once per distinct fan-in set instead of once
    per shared node.  A fan-in set larger than ``BLOCK`` is cut into blocks whose
    pairs are spread over tasks; every pair is still compared.
    """
    down = materialize(downstream(nodes, edges, depth, markers), "downstream")
    sizes = down.groupBy("region", "prop").agg(F.sum("times").alias("size"))
    signature = (down.groupBy("region", "node")
                 .agg(F.count("*").alias("fan_in"), F.min("times").alias("times"),
                      F.sum(F.shiftright(F.xxhash64("prop"), 20)).alias("h1"),
                      F.bit_xor(F.xxhash64("prop", F.lit(1))).alias("h2"),
                      F.bit_xor(F.xxhash64(F.lit(2), "prop")).alias("h3")))
    merged = (signature.filter("fan_in > 1").groupBy("region", "fan_in", "h1", "h2", "h3")
              .agg(F.min("node").alias("node"), F.sum("times").alias("weight")))
    member = down.join(merged.select("region", "node", "weight", "fan_in"), ["region", "node"])
    blocks = F.ceil(F.col("fan_in") / F.lit(BLOCK)).cast("int")
    member = member.withColumn("blocks", blocks).withColumn(
        "b", F.pmod(F.xxhash64("prop"), F.col("blocks")).cast("int"))
    spread = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = member.select("region", "node", "weight", F.col("prop").alias("a"),
                         F.col("b").alias("i"), spread.alias("j"))
    right = member.select("region", "node", F.col("prop").alias("z"),
                          F.col("b").alias("j"), spread.alias("i"))
    if labels is None:
        pairs = left.join(right, ["region", "node", "i", "j"]).filter("a < z")
    else:
        # pairs start at a label; one between two labels is met from the smaller
        asked = labels.select("region", F.col("label").alias("a")).distinct()
        other = labels.select("region", F.col("label").alias("z"), F.lit(True).alias("both")).distinct()
        pairs = (left.join(asked, ["region", "a"], "left_semi")
                 .join(right, ["region", "node", "i", "j"]).filter("a <> z")
                 .join(other, ["region", "z"], "left").filter("both IS NULL OR a < z")
                 .select("region", "weight", F.least("a", "z").alias("a"),
                         F.greatest("a", "z").alias("z")))
    shared = (pairs.groupBy("region", "a", "z").agg(F.sum("weight").alias("shared"))
              .filter(F.col("shared") >= min_shared))
    return (shared.join(sizes.withColumnsRenamed({"prop": "a", "size": "na"}), ["region", "a"])
            .join(sizes.withColumnsRenamed({"prop": "z", "size": "nz"}), ["region", "z"])
            .select("region", "a", F.col("z").alias("b"), "shared",
                    (F.col("shared") / (F.col("na") + F.col("nz") - F.col("shared")))
                    .alias("overlap")))


def similar_to(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Similarity rows of each label, seen from that label."""
    both = pairs.select("region", F.col("a").alias("label"), F.col("b").alias("other"),
                        "shared", "overlap").unionByName(
        pairs.select("region", F.col("b").alias("label"), F.col("a").alias("other"),
                     "shared", "overlap"))
    return both.join(labels.select("region", "label").distinct(), ["region", "label"],
                     "left_semi")
