"""Character references of HTML, decoded in the JVM."""

from html.entities import html5

from pyspark.sql import Column, functions as F

REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def _code_point(number: Column) -> Column:
    """The character of a code point; the replacement character where there is none."""
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\ufffd")


def decode_entities(text: Column) -> Column:
    """Text with named and numeric references decoded once; unknown names stay.

    References to the ampersand come last, so that what they write isn't read as
    another reference.
    """
    names = F.create_map(*[F.lit(x) for name, char in html5.items() if name.endswith(";")
                           for x in ("&" + name, char)])

    def meaning(ref):
        digits = F.regexp_extract(ref, "^&#[xX]?([0-9a-fA-F]+);$", 1)
        number = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("bigint")
        return F.when(F.startswith(ref, F.lit("&#")), _code_point(number)).otherwise(F.coalesce(names[ref], ref))
    found = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({REFERENCE})"), F.lit(1))),
                        lambda r: F.struct((meaning(r) == "&").alias("last"), r.alias("ref"), meaning(r).alias("char")))
    return F.when(F.contains(text, F.lit("&")), F.aggregate(
        F.array_sort(found), text, lambda t, x: F.replace(t, x["ref"], x["char"]))).otherwise(text)
