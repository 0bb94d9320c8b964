"""Reasons to refuse a statement before it reaches the graph."""

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed
from .fixed import WS
from .strings import let, strip, words


def rejection(text: Column) -> Column:
    """First reason that applies, '' when the statement is clean."""
    copula = rf"{WS}+(?:is|are|was|were|has|have|had|requires|contains){WS}+"

    def reason(p):
        s, subject = p["s"], p["subject"]
        low = F.lower(subject)
        return (F.when(s == "", "empty")
                .when(s.rlike(r"(?i)(?:doi:|https?://|www\.)"), "url_or_doi")
                .when(s.rlike(rf"(?U)\b[A-Z][a-z'-]+{WS}+\([0-9]{{4}}\)"),
                      "author_year_citation")
                .when(s.rlike(r"\[[0-9]+\]"), "reference_bracket")
                .when(s.rlike(rf"(?iU)\bet{WS}+al\.?"), "et_al_attribution")
                .when(F.length(s) > 220, "too_long")
                .when(F.length(s) < 6, "too_short")
                .when(subject == "", "no_subject")
                .when(low.isin(fixed.STOPWORD_SUBJECTS), "stopword_subject")
                .when(low.isin(fixed.ARTICLES), "article_subject")
                .when(low.isin(fixed.PRONOUNS), "pronoun_subject")
                .when(F.size(words(subject)) > 6, "subject_too_long")
                .otherwise(""))

    return let(let(strip(text), lambda s: F.struct(
        s.alias("s"), strip(F.split(s, copula, 2)[0]).alias("subject"))), reason)


def filter_polluting(df: DataFrame, text: str = "text") -> DataFrame:
    reason = rejection(F.col(text))
    return df.withColumn("reason", reason).withColumn("ok", F.col("reason") == "")
