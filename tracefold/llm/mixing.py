"""Mixing sources to target weights by Poisson replication.

Each source has a target weight; its mean repetition rate is its target share
of the budget over its own size.  A document's number of copies is the
quantile of the Poisson law with that mean at a uniform number hashed from
seed and doc_id, so a document's fate needs no coordination, survives a lost
executor and changes only with its source's rate.  Copies are dealt out by a
range shuffle on a hashed key, a global random order.
"""

from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import materialize

SIZE = "CAST(coalesce(octet_length(text), 0) AS BIGINT) + 1"
TAIL = 12
LARGEST_MEAN = 500      # a larger mean is the sum of several draws


def _uniform(*parts):
    """52 hashed bits as a number in [0, 1)."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("?")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


def source_rates(docs: DataFrame, weights: dict | None = None, power: float = 0.5,
                 budget: float = 1.0) -> DataFrame:
    """(source, size, rate): bytes held and mean number of copies of each source.

    weights: target weight by source, others 0; None sets them to size ** power.
    budget: bytes wanted, as a multiple of the bytes held.  A null source is a
    source of its own.  Rates are rounded to six places.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.expr(SIZE)).alias("size"))
    if weights is None:
        w = F.pow(F.col("size").cast("double"), F.lit(power))
    else:
        w = F.lit(0.0)
        for name, value in weights.items():
            w = F.when(F.col("source").eqNullSafe(F.lit(name)), float(value)).otherwise(w)
    sizes = sizes.withColumn("w", w)
    sizes = materialize(sizes, "sources")
    all_w, all_size = sizes.agg(F.sum("w"), F.sum("size")).first()
    share = F.col("w") / F.lit(all_w) if all_w else F.lit(0.0)
    return sizes.select("source", "size",
                        F.round(share * budget * F.lit(all_size) / F.col("size"), 6).alias("rate"))


def poisson_quantile(u, rate):
    """Smallest k whose Poisson distribution function exceeds u.

    Terms run to mean + 12 deviations + 12, beyond which no double u can point.
    """
    top = F.ceil(rate + TAIL * F.sqrt(rate) + TAIL).cast("int")
    none = F.exp(-rate)
    zero = F.struct(F.lit(0).cast("long").alias("k"), none.alias("term"), none.alias("cdf"))
    step = F.aggregate(
        F.sequence(F.lit(1), top), zero,
        lambda s, i: F.struct(
            (s["k"] + F.when(s["cdf"] <= u, 1).otherwise(0)).alias("k"),
            (s["term"] * rate / i).alias("term"),
            (s["cdf"] + s["term"] * rate / i).alias("cdf")))
    return step["k"]


def draw_copies(seed: int, rate, doc_id):
    """Copies of a doc_id: a sum of draws with means up to LARGEST_MEAN."""
    parts = F.ceil(rate / LARGEST_MEAN).cast("int")
    one = poisson_quantile(_uniform(F.lit(seed), doc_id), rate)
    many = F.aggregate(
        F.sequence(F.lit(1), F.greatest(parts, F.lit(1))), F.lit(0).cast("long"),
        lambda n, i: n + poisson_quantile(_uniform(F.lit(seed), doc_id, i), rate / parts))
    return F.when(parts > 1, many).when(rate > 0, one).otherwise(F.lit(0).cast("long"))


def mix_sources(docs: DataFrame, weights: dict | None = None, power: float = 0.5,
                budget: float = 1.0, seed: int = 17, added: bool = True) -> DataFrame:
    """Every row of docs as often as drawn, in a global random order.

    docs: doc_id, text, source; further columns pass through, but columns named
    copy, copies, rate or shuffle_key are replaced.  Adds rate, copies (drawn
    for the row), copy (from 1) and shuffle_key, by which rows are range
    partitioned and sorted; with ``added`` false just docs' own columns return, whatever
    their names.  Rows that repeat a doc_id draw the same number.
    A null doc_id draws as the text "?"; a null text has size 1.  A source
    without weight gives no rows; no rows give no rows.
    """
    kept = [c for c in docs.columns if not added or c not in ("copy", "copies", "rate", "shuffle_key")]
    # the caller's columns travel in one struct, so none of their names meets one used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    rates = source_rates(docs, weights, power, budget).select(F.col("source").alias("of"), "rate")
    drawn = (rows.join(rates, F.col("row.source").eqNullSafe(F.col("of")))
             .withColumn("copies", draw_copies(seed, F.col("rate"), F.col("row.doc_id"))).filter("copies > 0")
             .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
             .withColumn("shuffle_key", _uniform(F.lit(seed + 1), F.col("row.doc_id"), F.col("copy"))))
    more = ["rate", "copies", "copy", "shuffle_key"] if added else []
    return (drawn.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key")
            .select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *more))


MIX_SQL = """
WITH sized AS (
  SELECT *, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) + 1 AS bytes FROM {docs}),
by_source AS (SELECT source AS s, CAST(sum(bytes) AS BIGINT) AS size FROM sized GROUP BY source),
rated AS (
  SELECT s, round(sqrt(CAST(size AS DOUBLE)) / sum(sqrt(CAST(size AS DOUBLE))) OVER ()
                  * 1.0 * CAST(sum(size) OVER () AS BIGINT) / size, 6) AS rate FROM by_source),
terms AS (
  SELECT s, rate, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER
         (PARTITION BY s ORDER BY k) AS cdf
  FROM (SELECT s, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 12) AS BIGINT))) AS k FROM rated)),
thresholds AS (SELECT s, any_value(rate) AS rate, list(cdf ORDER BY k) AS cdfs FROM terms GROUP BY s),
drawn AS (
  SELECT d.* EXCLUDE (bytes), t.rate, len(list_filter(t.cdfs, lambda c: c <=
         CAST(('0x' || substr(md5('17|' || coalesce(CAST(d.doc_id AS VARCHAR), '?')), 1, 13)) AS BIGINT)
         / 4503599627370496.0)) AS copies
  FROM sized d JOIN thresholds t ON d.source IS NOT DISTINCT FROM t.s)
SELECT {columns} FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM drawn)"""
