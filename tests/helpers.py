"""Small builders for operator tests."""

from pyspark.sql import functions as F

from tracefold.functions.statements import parse_statements
from tracefold.operators import evidence
from tracefold.plans.graphs import build


def fact_rows(spark, texts, mode="confident"):
    """Facts of (text, kind, source) rows taught in order."""
    rows = [(i, *(t if isinstance(t, tuple) else (t, "teach", None))) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "seq long, text string, kind string, source_label string")
    parsed = parse_statements(df, "text").withColumn("source_text", F.col("original"))
    return evidence.with_mode(evidence.facts(parsed), mode)


def graph_of(spark, texts, mode="confident"):
    return build(fact_rows(spark, texts, mode))


def edge(g, src, dst):
    return g.edges.filter((F.col("src") == src) & (F.col("dst") == dst)).collect()[0]


def labels(spark, names, column="label"):
    df = spark.createDataFrame([(n,) for n in names], f"{column} string")
    return df.withColumn("region", F.lit("main"))
