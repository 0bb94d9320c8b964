"""Small string helpers shared by the text operators (all native columns)."""

import functools

from pyspark.sql import Column, functions as F

from .fixed import WS


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def words(c: Column) -> Column:
    """Split on white space runs, dropping empty pieces."""
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def strip_chars(c: Column, chars: str) -> Column:
    cls = "[" + "".join("\\" + ch for ch in chars) + "]"
    return F.regexp_replace(c, f"^{cls}+|{cls}+$", "")


def lstrip_chars(c: Column, chars: str) -> Column:
    cls = "[" + "".join(ch if ch.isalnum() else "\\" + ch for ch in chars) + "]"
    return F.regexp_replace(c, f"^{cls}+", "")


def any_contains(c: Column, phrases) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in phrases])


def any_startswith(c: Column, phrases) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.startswith(c, F.lit(p)) for p in phrases])


def any_endswith(c: Column, phrases) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.endswith(c, F.lit(p)) for p in phrases])


def split_sentences(c: Column) -> Column:
    """Pieces that follow ``.``, ``!`` or ``?`` and white space."""
    return F.split(c, f"(?<=[.!?]){WS}+")


def singular(c: Column) -> Column:
    n = F.length(c)
    return (F.when(F.endswith(c, F.lit("ies")), F.concat(F.substring(c, F.lit(1), n - 3), F.lit("y")))
            .when(any_endswith(c, ["ches", "shes", "xes", "zes", "ses"]),
                  F.substring(c, F.lit(1), n - 2))
            .when(F.endswith(c, F.lit("s")) & ~F.endswith(c, F.lit("ss")),
                  F.substring(c, F.lit(1), n - 1))
            .otherwise(c))


def cut(c: Column, k: int) -> Column:
    """Drop the last ``k`` characters."""
    return F.substring(c, F.lit(1), F.length(c) - k)


def inflection_slots(c: Column) -> list[Column]:
    """Plural / demonym variants of a label, in lookup order; null where one doesn't apply."""
    def ends(s):
        return F.endswith(c, F.lit(s))
    add = [F.concat(c, F.lit(s)) for s in ("s", "es", "ian", "ians", "an")]
    none = F.lit(None).cast("string")
    first = F.when(ends("ians"), cut(c, 4)).when(ends("ian"), cut(c, 3)) \
        .when(ends("ans"), cut(c, 3)).when(ends("an"), cut(c, 2)).otherwise(none)
    second = F.when(ends("ians"), cut(c, 1)).when(ends("ian"), F.concat(c, F.lit("s"))) \
        .when(ends("ans"), cut(c, 1)).otherwise(none)
    last = F.when(ends("ies"), F.concat(cut(c, 3), F.lit("y"))).when(ends("es"), cut(c, 2)) \
        .when(ends("s") & ~ends("ss"), cut(c, 1)).otherwise(none)
    return [*add, first, second, last]


def inflections(c: Column) -> Column:
    """The variants that apply, as an array."""
    return F.array_compact(F.array(*inflection_slots(c)))
