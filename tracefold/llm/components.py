"""Connected components as DataFrame joins: large-star and small-star rounds.

Edges shrink towards stars around the smallest id of each component.  Every
round is two aggregations and two joins, written to the shared checkpoint
folder, so the plan stays short and neither edges nor components ever meet in
the driver or in one task.
"""

from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (both.filter("v > u").join(least.select("u", F.least("u", "m").alias("m")), "u")
            .select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
                 .first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every id on an edge (a, b); component is the smallest id reachable.

    Self loops, repeated edges and nulls add nothing; no edges give no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize(edges.filter("a <> b").distinct(), name)
    before = _state(edges)
    while before[0]:
        edges = materialize(_small_star(_large_star(edges)).distinct(), name)
        now = _state(edges)
        if now == before:
            break
        before = now
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.union(stars.select("component", "component").distinct())
