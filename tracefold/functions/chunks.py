"""Greedy packing of text units into chunks, as one fold over an array."""

from pyspark.sql import Column, DataFrame, functions as F

from .cleaning import detect_format
from .strings import split_sentences, strip


def pack(units: Column, limit: int, glue: str, explode_unit=None) -> Column:
    """Join consecutive units with ``glue`` while their summed length fits ``limit``.

    A unit's length counts with its glue once it is in the buffer; an empty
    buffer takes any unit.  With ``explode_unit`` a unit longer than ``limit``
    closes the buffer and is cut into chunks of its own.
    """
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), none.alias("cur"), F.lit(0).alias("n"))

    def flush(acc):
        return F.when(F.size(acc["cur"]) > 0,
                      F.array_append(acc["out"], F.array_join(acc["cur"], glue))) \
            .otherwise(acc["out"])

    def step(acc, u):
        full = (acc["n"] + F.length(u) > limit) & (F.size(acc["cur"]) > 0)
        taken = F.struct(
            F.when(full, flush(acc)).otherwise(acc["out"]).alias("out"),
            F.when(full, F.array(u)).otherwise(F.array_append(acc["cur"], u)).alias("cur"),
            (F.when(full, 0).otherwise(acc["n"]) + F.length(u) + len(glue)).alias("n"))
        if explode_unit is None:
            return taken
        cut = F.struct(F.concat(flush(acc), explode_unit(u)).alias("out"), none.alias("cur"),
                       F.lit(0).alias("n"))
        return F.when(F.length(u) > limit, cut).otherwise(taken)

    return F.aggregate(units, start, step, flush)


def _paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")


def paragraph_chunks(text: Column, limit: int = 1500) -> Column:
    return pack(_paragraphs(text), limit, "\n\n",
                             lambda p: pack(F.split(p, "\n"), limit, "\n"))


def sentence_chunks(text: Column, limit: int = 800) -> Column:
    packed = pack(_paragraphs(text), limit, "\n\n",
                               lambda p: pack(split_sentences(p), limit, " "))
    return F.filter(packed, lambda c: F.length(strip(c)) > 50)


def skim_chunks(text: Column, limit: int = 2500) -> Column:
    return pack(F.filter(_paragraphs(text), lambda p: F.length(p) >= 30), limit, "\n\n")


def markdown_chunks(text: Column, limit: int = 1500) -> Column:
    sections = F.filter(F.transform(F.split(text, r"(?m)(?=^#{1,6}\s)"), strip),
                        lambda p: p != "")
    return pack(sections, limit, "\n\n", lambda p: paragraph_chunks(p, limit))


def code_chunks(text: Column, limit: int = 1500) -> Column:
    parts = F.split(text, r"(?m)(?=^(?:def |class |async def ))")
    parts = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"\s+$", "")),
                     lambda p: p != "")
    return pack(parts, limit, "\n", lambda p: paragraph_chunks(p, limit))


STRATEGIES = {"text": paragraph_chunks, "markdown": markdown_chunks, "code": code_chunks,
              "sentence": sentence_chunks, "skim": skim_chunks}


def chunk_documents(df: DataFrame, key: list[str], text: str = "text", source: str = None,
                    max_chars: int = 1500, strategy: str = None) -> DataFrame:
    """(key, chunk_no, chunk): by a named strategy, or by detected format."""
    if strategy is not None:
        return df.select(*key, F.posexplode(STRATEGIES[strategy](F.col(text), max_chars))
                         .alias("chunk_no", "chunk"))
    name = F.col(source) if source else F.lit("")
    kind = df.withColumn("_format", detect_format(F.col(text), name))
    parts = [kind.filter(F.col("_format") == f).select(
        *key, F.posexplode(STRATEGIES[f](F.col(text), max_chars)).alias("chunk_no", "chunk"))
        for f in ("text", "markdown", "code")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
