"""Column expressions over edge counters and triage cases."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def strength(traversals: Column, refutations: Column) -> Column:
    return F.lit(1.0) + F.log1p(traversals) - F.log1p(refutations)


def belief(traversals: Column, refutations: Column) -> Column:
    return F.log1p(traversals) - F.log1p(refutations)


def evidence_weight(traversals: Column, refutations: Column) -> Column:
    return F.log1p(traversals + refutations)


def epistemic_state(traversals: Column, refutations: Column) -> Column:
    b = belief(traversals, refutations)
    return (F.when(evidence_weight(traversals, refutations) < 1.0, "unknown")
            .when(F.abs(b) < 0.3, "contested")
            .when(b > 0, "believed").otherwise("refuted"))


def with_edge_measures(edges):
    """Add belief, evidence_weight, state and is_refuted to an edge table."""
    t, r = F.col("traversals"), F.col("refutations")
    return edges.withColumns({
        "belief": belief(t, r), "evidence_weight": evidence_weight(t, r),
        "state": epistemic_state(t, r), "is_refuted": r > t})


def visible(edges, min_strength=0.5):
    return edges.filter(F.col("strength") >= min_strength)


def urgency(severity: Column, self_rescue: Column, aware: Column, years: Column,
            reach: Column) -> Column:
    """Triage score: helpless cases outrank everything, else scaled need."""
    score = (severity
             * F.when(self_rescue, 1.0).otherwise(2.0)
             * F.when(aware, 1.0).otherwise(1.5)
             * F.when(years < 5, 2.0).when(years < 18, 1.5).otherwise(1.0)
             * reach)
    return (F.when(severity == 0, 0.0)
            .when(~self_rescue & ~aware, severity * 1000.0).otherwise(score))


def triage_rank(cases: DataFrame, group: list[str]) -> DataFrame:
    """Rank scored cases (column urgency) by need within each group."""
    return cases.withColumn("rank", F.rank().over(
        W.partitionBy(*group).orderBy(F.desc("urgency"))))


METADATA = "map<string,string>"


def metadata_from_json(raw: Column) -> Column:
    """Metadata of a stored JSON text; null stays null."""
    return F.from_json(raw, METADATA)


def metadata_json(metadata: Column) -> Column:
    return F.to_json(metadata)
