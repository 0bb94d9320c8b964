"""From texts and conversation turns to facts."""

from pyspark.sql import DataFrame, functions as F

from ..functions import pollution, statements, turns
from .evidence import facts, with_mode


def teach_texts(df: DataFrame, mode: str = "confident", negation: str = "refute",
                text: str = "text", strict: bool = False, **columns) -> DataFrame:
    """Facts of a text table (text, seq, optional source_label).

    'tentative' texts pass the pollution filter first.  A negated statement
    refutes, or teaches like any other with ``negation='ignore'``.
    """
    if mode == "tentative":
        df = pollution.filter_polluting(df, text).filter("ok").drop("ok", "reason")
    parsed = statements.parse_statements(df, text, strict)
    kind = F.when(F.col("negated"), "refute").otherwise("teach") if negation == "refute" \
        else F.lit("teach")
    rows = facts(parsed.withColumn("source_text", F.col("original")), kind=kind, **columns)
    return with_mode(rows, mode)


def teach_turns(df: DataFrame, key: list[str], text: str = "text", **columns) -> DataFrame:
    """Facts asserted by conversation turns (text, seq plus key columns).

    A plain claim is taught in its own words, a denied one refutes its positive
    form; a form that does not parse again is dropped.
    """
    said = turns.classify_turns(df, text)
    rows = said.select(*key, "seq", F.posexplode("facts").alias("nth", "f")).select(
        *key, (F.col("seq") + F.col("nth")).alias("seq"), F.col("f.negated").alias("denied"),
        F.when(F.col("f.negated"), statements.render_statement(
            F.col("f.subject"), F.col("f.relation"), F.col("f.obj")))
        .otherwise(F.col("f.original_text")).alias("text"))
    parsed = statements.parse_statements(rows, "text")
    kind = F.when(F.col("denied"), "refute").otherwise("teach")
    return facts(parsed.withColumn("source_text", F.col("original")), kind=kind, **columns)
