"""Qualify ambiguous terms (place, people, language) from their context."""

from pyspark.sql import Column, functions as F

from . import fixed
from .strings import cut, strip, words


def _score(low: Column, tokens: Column, clues) -> Column:
    single = [c for c in clues if " " not in c]
    phrases = [c for c in clues if " " in c]
    total = F.size(F.array_intersect(tokens, F.array(*[F.lit(c) for c in single])))
    for phrase in phrases:
        total = total + F.when(F.contains(low, F.lit(phrase)), 2).otherwise(0)
    return total


def place_form(term: Column) -> Column:
    return (F.when(F.endswith(term, F.lit("ians")), cut(term, 4))
            .when(F.endswith(term, F.lit("ian")), cut(term, 3)).otherwise(term))


def clue_scores(context: Column) -> Column:
    low = F.lower(context)
    tokens = F.array_distinct(words(low))
    return F.struct(_score(low, tokens, fixed.PLACE_CLUES).alias("place"),
                    _score(low, tokens, fixed.PEOPLE_CLUES).alias("people"),
                    _score(low, tokens, fixed.LANGUAGE_CLUES).alias("language"))


def qualified(term: Column, scores: Column) -> Column:
    """Qualified label when one category scores at least 2 and leads by at least 2."""
    p, e, g = scores["place"], scores["people"], scores["language"]
    low = F.lower(strip(term))

    def wins(a, b, c):
        return (a >= 2) & (a - F.greatest(b, c) >= 2)
    return (F.when(wins(p, e, g), place_form(low))
            .when(wins(e, p, g), F.concat(low, F.lit(" people")))
            .when(wins(g, p, e), F.concat(low, F.lit(" language")))
            .otherwise(term))


def qualify_term(term: Column, context: Column) -> Column:
    return qualified(term, clue_scores(context))
