"""Observed items: corrections, missing properties, qualified ingest."""

import datetime

from pyspark.sql import DataFrame, functions as F

from ..functions import dates, fixed, qualify, statements
from ..functions.statements import property_type
from .evidence import facts, teach
from .lookup import why


def _is_facts(df: DataFrame, subject: str, obj: str) -> DataFrame:
    """Facts of '<subject> is <obj>' sentences (parsed, so articles and plurals fold)."""
    said = df.withColumn("text", F.concat_ws(" is ", subject, obj))
    parsed = statements.parse_statements(said, "text")
    return facts(parsed.withColumn("source_text", F.col("original")))


def apply_corrections(observations: DataFrame, corrections: DataFrame) -> DataFrame:
    """Facts taught by corrections.

    ``observations`` (item, property, seq), ``corrections`` (item, label, seq): the
    item is the label, and the label gets every property observed on the item.
    """
    identity = corrections.select(F.col("item").alias("s"), F.col("label").alias("o"), "seq")
    moved = (observations.select("item", "property").distinct()
             .join(corrections, "item")
             .select(F.col("label").alias("s"), F.col("property").alias("o"), "seq"))
    return _is_facts(identity.unionByName(moved), "s", "o")


def verification_candidates(observations: DataFrame, candidates: DataFrame, paths: DataFrame,
                            edges: DataFrame) -> DataFrame:
    """Known properties of an item's top candidate that were not observed on it.

    ``observations`` (region, item, property), ``candidates`` (region, item, label).
    """
    known = why(candidates.select("region", "label"), paths, edges).select(
        "region", F.col("terminus").alias("label"), F.col("origin").alias("property")).distinct()
    return (candidates.join(known, ["region", "label"])
            .join(observations, ["region", "item", "property"], "left_anti")
            .select("region", "item", "label", "property"))


def unobserved_associations(observations: DataFrame, associations: list[str] = ()) -> DataFrame:
    """(item, association) whose property type was not yet observed on the item."""
    seen = (observations.withColumn("association", property_type(F.col("property")))
            .filter("association <> 'attribute'").select("item", "association").distinct())
    items = observations.select("item").distinct()
    pairs = F.explode(F.array(*[F.lit(n) for n in fixed.QUESTION_WORDS]))
    every = items.select("item", pairs.alias("association"))
    if associations:
        more = F.explode(F.array(*[F.lit(n) for n in associations]))
        every = every.unionByName(items.select("item", more.alias("association"))).distinct()
    return every.join(seen, ["item", "association"], "left_anti")


def ingest_statements(df: DataFrame, as_of: datetime.date, text: str = "text") -> tuple:
    """(facts, evidence): parse, qualify both ends, teach and link dates.

    A qualified end replaces its first occurrence in the statement, which is then
    parsed again.
    """
    first = statements.parse_statements(df, text)
    scores = qualify.clue_scores(F.col(text))
    first = first.withColumn("_sc", scores)
    subject = qualify.qualified(F.col("subject"), F.col("_sc"))
    obj = qualify.qualified(F.col("obj"), F.col("_sc"))

    rows = first.withColumns({"_qs": subject, "_qo": obj})
    rows = rows.withColumn("_t", F.expr(
        f"case when _qs <> subject and instr({text}, subject) > 0 then "
        f"overlay({text} placing _qs from instr({text}, subject) for length(subject)) "
        f"else {text} end"))
    rows = rows.withColumn("_t", F.expr(
        "case when _qo <> obj and instr(_t, obj) > 0 then "
        "overlay(_t placing _qo from instr(_t, obj) for length(obj)) else _t end"))
    keep = [c for c in df.columns if c != text]
    again = rows.select(*keep, F.col("_t").alias("text"))
    parsed = statements.parse_statements(again, "text")
    fact_rows = facts(parsed.withColumn("source_text", F.col("original")))
    dated = dates.link_dates(fact_rows.select(
        "region", F.col("subject").alias("fact"), F.col("source_text").alias("text"), "seq"),
        as_of)
    return fact_rows, teach(fact_rows).unionByName(dated)
