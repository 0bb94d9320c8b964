"""Associations, question words and categories as dimension tables."""

import itertools

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from ..functions.strings import strip
from .evidence import links


def _norm(name):
    return F.lower(strip(F.col(name)))


def builtin_rows(spark, table: dict, key: str, value: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(a).alias(key), F.lit(b).alias(value)) for a, b in table.items()])
    return spark.range(1).select(F.inline(rows))


def define_associations(df: DataFrame) -> DataFrame:
    """(association, question_word, seq) -> current question word, last one wins."""
    return (df.select(_norm("association").alias("association"),
                      _norm("question_word").alias("question_word"), "seq")
            .filter(F.col("question_word").isNotNull() & (F.col("question_word") != ""))
            .groupBy("association").agg(F.max_by("question_word", "seq").alias("question_word")))


def describe_associations(df: DataFrame, known: DataFrame):
    """(association, property, seq) -> (evidence rows, registered rows, unknown names).

    A description is only taken for a defined association.
    """
    rows = df.select(_norm("association").alias("association"),
                     _norm("property").alias("property"), "seq").filter("property <> ''")
    good = rows.join(known.select("association").distinct(), "association", "left_semi")
    bad = rows.join(known.select("association").distinct(), "association", "left_anti")
    evidence = links(good.select(
        F.lit("main").alias("region"), F.col("property").alias("src"),
        F.col("association").alias("dst"), F.lit("is_a").alias("relation"),
        F.lit("property").alias("src_type"), F.lit("association").alias("dst_type"),
        F.lit(fixed.ASSOCIATION).alias("initial_strength"), "seq"))
    return evidence, good.select("association", "property").distinct(), bad


def taxonomy_from(registered: DataFrame) -> DataFrame:
    """Dynamic property types (label, ptype); the last name in order wins for a label."""
    return (registered.groupBy(F.col("property").alias("label"))
            .agg(F.max("association").alias("ptype")))


def association_properties(spark, registered: DataFrame) -> DataFrame:
    builtin = builtin_rows(spark, fixed.PROPERTY_TYPES, "property", "association")
    return registered.select("association", "property").unionByName(
        builtin.select("association", "property")).distinct()


def categorize(df: DataFrame, spark) -> DataFrame:
    """(label, category, seq): last tag wins and overrides the built-in category."""
    own = (df.groupBy(_norm("label").alias("label"))
           .agg(F.max_by(_norm("category"), F.col("seq")).alias("category")))
    builtin = builtin_rows(spark, fixed.CATEGORIES, "label", "category")
    return own.unionByName(builtin.join(own, "label", "left_anti"))


def resolve_question_words(asked: DataFrame, defined: DataFrame) -> DataFrame:
    """(question_word) -> associations; defined ones replace the built-in list."""
    pairs = [F.struct(F.lit(q).alias("question_word"), F.lit(a).alias("association"))
             for a, q in fixed.QUESTION_WORDS.items()]
    builtin = asked.sparkSession.range(1).select(F.inline(F.array(*pairs)))
    dynamic = asked.join(defined, "question_word").select("question_word", "association")
    rest = asked.join(defined, "question_word", "left_anti")
    return dynamic.unionByName(rest.join(builtin, "question_word")
                               .select("question_word", "association"))


def list_question_words(defined: DataFrame) -> DataFrame:
    pairs = [F.struct(F.lit(q).alias("question_word"), F.lit(a).alias("association"))
             for a, q in fixed.QUESTION_WORDS.items()]
    builtin = defined.sparkSession.range(1).select(F.inline(F.array(*pairs)))
    return (builtin.unionByName(defined.select("question_word", "association"))
            .distinct().orderBy("question_word", "association"))


def list_associations(registered: DataFrame) -> DataFrame:
    """(association, properties): every association with its sorted properties."""
    return (registered.groupBy("association")
            .agg(F.sort_array(F.collect_set("property")).alias("properties")))


def list_categories(categorized: DataFrame) -> DataFrame:
    """(category, labels): every category with its sorted labels."""
    return (categorized.groupBy("category")
            .agg(F.sort_array(F.collect_set("label")).alias("labels")))
