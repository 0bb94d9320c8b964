"""Date references and temporal relation phrases."""

import datetime

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed
from ..operators.evidence import links


def day_label(d: datetime.date) -> str:
    return f"day_{d.year}_{d.month:02d}_{d.day:02d}"


def extract_dates(text: Column, as_of: datetime.date) -> Column:
    """Array of (label, type) references: BCE and CE years, eras, relative days."""
    def refs(labels, kind):
        return F.transform(labels, lambda x: F.struct(x.alias("label"),
                                                      F.lit(kind).alias("type")))
    bce = F.regexp_extract_all(text, F.lit("(?U)" + fixed.BCE_YEAR), F.lit(1))
    ce = F.regexp_extract_all(text, F.lit("(?U)" + fixed.CE_YEAR), F.lit(1))
    ce = F.filter(ce, lambda y: (F.length(y) == 4) & (y.cast("int") > 1000)
                  & ~F.array_contains(bce, y))
    out = [refs(F.transform(bce, lambda y: F.concat(y, F.lit("_bce"))), "moment"),
           refs(F.transform(ce, lambda y: F.concat(y, F.lit("_ce"))), "moment")]
    for pattern in fixed.ERA_PATTERNS:
        eras = F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(1))
        out.append(refs(F.transform(eras, lambda e: F.replace(F.lower(e), F.lit(" "),
                                                              F.lit("_"))), "era"))
    low = F.lower(text)
    for word, offset in fixed.DAY_WORDS.items():
        label = F.lit(day_label(as_of + datetime.timedelta(days=offset)))
        day = F.struct(label.alias("label"), F.lit("moment").alias("type"))
        out.append(F.when(F.contains(low, F.lit(word)), F.array(day))
                   .otherwise(F.filter(F.array(day), lambda _: F.lit(False))))
    return F.array_distinct(F.concat(*out))


def temporal_relations(text: Column) -> Column:
    """Relations whose phrase occurs in the text, in dictionary order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[
        F.when(F.contains(low, F.lit(phrase)), F.lit(rel))
        for phrase, rel in fixed.TIME_RELATIONS.items()]))


def link_dates(df: DataFrame, as_of: datetime.date) -> DataFrame:
    """(region, fact, text, seq) -> evidence rows tying the fact to its dates."""
    relation = F.concat(F.lit("happened_"), F.coalesce(
        F.get(temporal_relations(F.col("text")), F.lit(0)), F.lit("during")))
    rows = df.withColumn("relation_name", relation).withColumn(
        "d", F.explode(extract_dates(F.col("text"), as_of)))
    note = F.concat(F.lit("[temporal] linked to "), F.col("d.label"), F.lit(" from: "), F.col("text"))

    def row(src, dst, rel, st, dt):
        return F.struct(src.alias("src"), dst.alias("dst"), rel.alias("relation"),
                        F.lit(st).alias("src_type"), F.lit(dt).alias("dst_type"))
    both = F.array(row(F.col("d.label"), F.col("d.type"), F.lit("is_a"), "concept", "property"),
                   row(F.col("fact"), F.col("d.label"), F.col("relation_name"), "concept",
                       "concept"))
    return links(rows.select("region", note.alias("source_text"), "seq", F.inline(both)))


def day_period(hour: Column) -> Column:
    return (F.when(hour < 12, "morning").when(hour < 17, "afternoon")
            .when(hour < 21, "evening").otherwise("night"))


def link_to_day(df: DataFrame, at: str) -> DataFrame:
    """(region, concept, <at>, seq) -> evidence rows tying concepts to their day.

    The time comes from a column, not from the clock of a worker.
    """
    day = F.concat(F.lit("day_"), F.date_format(at, "yyyy_MM_dd"))
    pair = F.array(
        F.struct(day.alias("src"), F.lit("moment").alias("dst"), F.lit("is_a").alias("relation"),
                 F.lit("concept").alias("src_type"), F.lit("property").alias("dst_type")),
        F.struct(F.col("concept").alias("src"), day.alias("dst"),
                 F.lit("happened_on").alias("relation"), F.lit("concept").alias("src_type"),
                 F.lit("concept").alias("dst_type")))
    return links(df.select("region", F.concat(F.lit("[temporal] linked to "), day)
                           .alias("source_text"), "seq", F.inline(pair)))
