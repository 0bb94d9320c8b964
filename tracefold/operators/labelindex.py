"""Stored index of labels: near, containing and starting labels by equi joins.

It is built once with a graph and keeps what follows the labels: their strings by length in a
bucketed table, whose side needs no exchange when it is looked up, and counts of grams.  Pieces
are many times the labels, so they are cut when terms ask for them: only from strings of a
length that a term can reach, in only as many pieces as its bound asks for, and those under no
asked key are dropped where they are made, as are keys of terms that no piece has: a map of
hashed keys, of one size however many keys there are, is sent to either side.

*Pieces.*  A string of m characters is cut into P near-equal pieces, and each piece is
stored whole and with one character taken out.  If a term turns into the string by
at most k <= 2P - 1 edits, look at the first piece j up to whose end there are at most
2j + 1 edits: there is one, it holds at most one edit, and 2j or 2j + 1 edits lie before it
(none before the first).  So a window of the term, shifted by no more than that many
places, equals the piece, or both agree once a character is taken out of either: that
is the join key, with m, P and j.  Short strings are stored as a whole with up to two
characters taken out, for at most two edits.  For one edit all strings are, with up to one taken out.

*Suffixes.*  Inflected forms that add a suffix are not stored.  A term near such a form has an
end near the suffix, and its head is near the label within the edits that are left;
ends that only cost what they are long are covered by the next longer head.

*Grams.*  A term that a label contains is looked up by the rarest of its three-character
grams; terms too short for one go through the dictionary of grams.

Both joins lose nothing; the real test follows on whole strings.  Lengths that many labels share are
spread over salts, as many as their count asks for.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.strings import inflection_slots, inflections
from ..sources.scratch import materialize, materialize_buckets

HOT = 20_000             # strings under one length and salt
KEYS = 500_000           # most grams of terms that are sent to the labels; more are met in a shuffle
WORDS = 1 << 18          # words of 64 bits in a map of hashed keys, however many keys there are
LABELS_A_BUCKET = 50_000
SUFFIX = 4               # characters that an inflected form adds at most
SUFFIXES = ["s", "es", "ian", "ians", "an"]
#: Letters by which an inflected form may differ from the label.
FORM_LETTERS = sum(1 << ord(c) % 61 for c in "seiany")
SHORT = 10               # longest string that is stored whole, for two edits


#: Ways to cut a string besides numbers of pieces: whole, less up to two characters, or up to one.
LESS_TWO, LESS_ONE = 0, -1


class LabelIndex(NamedTuple):
    labels: DataFrame        # label
    sizes: DataFrame         # m, salts; lengths that occur
    strings: DataFrame       # m, salt, label, string (the label or a form of it), letters
    gram_counts: DataFrame   # gram, n


def edit_bound(term: Column) -> Column:
    return F.greatest(F.lit(2), (F.length(term) / 3).cast("int"))


def _letters(text: Column) -> Column:
    """Bit set of the characters of a string."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda a, c: a.bitwiseOR(
        F.when(c == "", F.lit(0).cast("long")).otherwise(F.call_function(
            "shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(61))))))


def _counts(m: Column) -> Column:
    """Numbers of pieces a string of m characters is cut into, from usual bounds to the loosest."""
    usual = F.floor(F.greatest(F.lit(2), F.floor(m / 3)) / 2) + 1
    loosest = F.floor(F.greatest(F.lit(2), F.floor((m + SUFFIX) / 2) + 1) / 2) + 1
    return F.array_distinct(F.array(usual.cast("int"), F.least(usual + 1, loosest).cast("int"), loosest.cast("int")))


def _start(m, p, j):
    return F.floor(j * m / p).cast("int")


def _less_one(text: Column) -> Column:
    """The string with each of its characters taken out."""
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(
        F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n)))).otherwise(F.array().cast("array<string>"))


def _less_two(text: Column) -> Column:
    """The string, and it with one and with two of its characters taken out."""
    one = _less_one(text)
    return F.array_distinct(F.concat(F.array(text), one, F.flatten(F.transform(one, _less_one))))


def piece_rows(strings: DataFrame) -> DataFrame:
    """(key, label, string, letters) of (label, string, letters, m, ways)."""
    cut = strings.select("label", "string", "letters", "m", F.explode("ways").alias("p"))
    cut = cut.select("label", "string", "letters", "m", "p",
                     F.explode(F.sequence(F.lit(0), F.greatest(F.col("p") - 1, F.lit(0)))).alias("j"))
    low, high = _start(F.col("m"), F.col("p"), F.col("j")), _start(F.col("m"), F.col("p"), F.col("j") + 1)
    p = F.col("p")
    cut = cut.withColumn("piece", F.when(p > 0, F.substring("string", low + 1, high - low)).otherwise(F.col("string")))
    parts = F.when(p == LESS_TWO, _less_two(F.col("piece"))).otherwise(
        F.array_distinct(F.concat(F.array("piece"), _less_one(F.col("piece")))))
    keys = F.transform(parts, lambda x: F.when(p > 0, F.xxhash64("m", "p", "j", x)).otherwise(F.xxhash64(x)))
    return cut.select(F.explode(keys).alias("key"), "label", "string", "letters")


def _plain(terms: DataFrame, bound) -> DataFrame:
    """(term, k, term_letters, head, left): terms as they are."""
    return terms.select("term").distinct().select(
        "term", bound(F.col("term")).alias("k"), _letters(F.col("term")).alias("term_letters"),
        F.col("term").alias("head"), bound(F.col("term")).alias("left"))


def _heads(terms: DataFrame, within: int = None) -> DataFrame:
    """(term, k, term_letters, head, left): terms, and their heads before what may be a suffix.

    ``within``: edits that are looked for, where they are fewer than the bound.
    """
    asked = _plain(terms, edit_bound)
    n, k = F.length("term"), F.col("k") if within is None else F.least("k", F.lit(within))
    suffixes = F.array(*map(F.lit, SUFFIXES))
    # cost of taking the last x characters for a suffix
    cost = F.transform(F.sequence(F.lit(0), F.least(n, k + SUFFIX)), lambda x: F.when(x == 0, 0).otherwise(
        F.array_min(F.transform(suffixes, lambda s: F.levenshtein(F.substring(F.col("term"), n - x + 1, x), s)))))
    asked = asked.withColumn("cost", cost).withColumn("x", F.explode(F.sequence(F.lit(0), F.size("cost") - 1)))
    here, before = F.get("cost", F.col("x")), F.get("cost", F.col("x") - 1)
    return (asked.filter((F.col("x") == 0) | (here <= before) & (here <= k))
            .select("term", "k", "term_letters", F.substring("term", F.lit(1), n - F.col("x")).alias("head"),
                    (k - here).alias("left")))


def _ways(heads: DataFrame, sizes: DataFrame, within: int = None) -> DataFrame:
    """Heads with their length n, each length m that is in reach and the way p to cut strings of it."""
    n, k, m = F.length("head"), F.col("left"), F.col("m")
    reached = heads.withColumn("n", n).withColumn(
        "m", F.explode(F.sequence(F.greatest(F.lit(0), n - k), n + k))).join(sizes.select("m"), "m")
    # fewer pieces are longer and tell more
    pieces = F.array_min(F.filter(_counts(m), lambda p: 2 * p - 1 >= k))
    whole = F.lit(LESS_ONE) if within == 1 else F.when((k <= 2) & (m <= SHORT), LESS_TWO).otherwise(pieces)
    return reached.withColumn("p", whole)


def probe_rows(ways: DataFrame) -> DataFrame:
    """(key, term, k, head, left, term_letters): keys under which a string within ``left`` edits of the head may be cut."""
    n, k, asks = F.col("n"), F.col("left"), ["term", "k", "head", "left", "term_letters"]
    head = F.col("head")
    few = ways.filter("p <= 0").select("p", *asks).distinct().select(F.explode(
        F.when(F.col("p") == LESS_TWO, _less_two(head))
        .otherwise(F.array_distinct(F.concat(F.array(head), _less_one(head))))).alias("part"), *asks)
    few = few.select(F.xxhash64("part").alias("key"), *asks)
    asked = ways.filter("p > 0")
    asked = asked.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    asked = asked.withColumns({"low": _start(F.col("m"), F.col("p"), F.col("j")),
                               "width": _start(F.col("m"), F.col("p"), F.col("j") + 1) - _start(F.col("m"), F.col("p"), F.col("j")),
                               "after": k - 2 * F.col("j")}).filter("after >= 0")

    def windows(more: int, most_before, after):
        """Windows ``more`` characters longer than the piece, where at most ``after`` edits lie behind."""
        width = F.col("width") + more
        rest = n - width - (F.col("m") - F.col("low") - F.col("width"))
        first = F.greatest(F.lit(0), F.col("low") - most_before, rest - after)
        last = F.least(n - width, F.col("low") + most_before, rest + after)
        return F.when((width >= 0) & (last >= first), F.transform(
            F.sequence(first, last), lambda q: F.substring(F.col("head"), q + 1, width))).otherwise(F.array().cast("array<string>"))
    whole, edited = (F.when(F.col("j") == 0, 0).otherwise(2 * F.col("j") + x) for x in (1, 0))
    less = lambda texts: F.flatten(F.transform(texts, _less_one))
    after = F.col("after")
    parts = F.concat(windows(0, whole, after), less(windows(0, edited, after - 1)), windows(-1, edited, after - 1),
                     less(windows(1, edited, after - 1)))
    return asked.select(F.explode(F.array_distinct(parts)).alias("part"), "m", "p", "j", *asks).select(
        F.xxhash64("m", "p", "j", "part").alias("key"), *asks).unionByName(few)


def _grams(text: Column) -> Column:
    """Distinct three-character substrings; a shorter text is one."""
    last = F.length(text) - 2
    return F.when(last >= 1, F.array_distinct(F.transform(
        F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array(text))


def _measured(strings: DataFrame) -> DataFrame:
    """(label, string) with its letters and length m."""
    return strings.select("label", "string", _letters(F.col("string")).alias("letters"), F.length("string").alias("m"))


def _asked(ways: DataFrame) -> DataFrame:
    """(m, ways): how strings of each length are to be cut."""
    return ways.groupBy("m").agg(F.collect_set("p").alias("ways"))


def _place():
    """Word and bit of a key in the map of hashed keys."""
    return F.pmod(F.shiftright("key", 6), F.lit(WORDS)).alias("word"), F.pmod("key", F.lit(64)).cast("int").alias("bit")


def _key_map(rows: DataFrame) -> DataFrame:
    """(word, bits): a map with the bit of every key of the rows set."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    return materialize(rows.select(*_place()).groupBy("word").agg(F.bit_or(bit).alias("bits")), "key-map")


def _mapped(rows: DataFrame, key_map: DataFrame) -> DataFrame:
    """The rows whose key has its bit in the map, and a few more of equal place."""
    return (rows.select("*", *_place()).join(F.broadcast(key_map), "word").filter("getbit(bits, bit) = 1")
            .drop("word", "bit", "bits"))


def _met(strings: DataFrame, ways: DataFrame) -> DataFrame:
    """Pairs of strings (with ways) and heads under one key.

    Both sides are many times what they are cut from, and few of their keys are on the other: they
    are cut again rather than written, and leave their tasks only under keys that the other may have.
    """
    probes = probe_rows(ways)
    pieces = _mapped(piece_rows(strings), _key_map(probes))
    probes = _mapped(probes, _key_map(pieces))
    return pieces.join(probes.hint("merge"), "key").filter(_alike(F.col("k")))


def build_index(nodes: DataFrame) -> LabelIndex:
    """Index of the distinct, non-empty labels of ``nodes``."""
    labels = materialize(nodes.select("label").filter("label <> ''").distinct(), "labels")
    # forms that keep the label whole and add to it are met by heads of terms
    forms = labels.select("label", F.explode(F.array_distinct(F.concat(F.array("label"), F.filter(
        inflections(F.col("label")), lambda f: ~F.startswith(f, F.col("label")))))).alias("string"))
    sizes = materialize(forms.groupBy(F.length("string").alias("m")).agg(
        F.ceil(F.count("*") / HOT).cast("int").alias("salts")), "sizes")
    salted = _measured(forms).join(sizes, "m").withColumn(
        "salt", F.pmod(F.xxhash64("string"), F.col("salts")).cast("int")).drop("salts")
    grams = labels.select(F.explode(_grams(F.col("label"))).alias("gram"))
    buckets = 8 + labels.count() // LABELS_A_BUCKET
    return LabelIndex(
        labels, sizes, materialize_buckets(salted, "label-strings", ["m", "salt"], buckets),
        materialize(grams.groupBy("gram").agg(F.count("*").alias("n")), "gram-counts"))


def index_of(nodes) -> LabelIndex:
    """An index as it is; nodes are indexed first."""
    return nodes if isinstance(nodes, LabelIndex) else build_index(nodes)


def _alike(k):
    """Neither side has more than k letters the other lacks, but for those of inflected forms."""
    label, term, free = F.col("letters"), F.col("term_letters"), ~FORM_LETTERS
    return ((F.bit_count(term.bitwiseAND(F.bitwise_not(label)).bitwiseAND(F.lit(free))) <= k)
            & (F.bit_count(label.bitwiseAND(F.bitwise_not(term)).bitwiseAND(F.lit(free))) <= k))


def near_labels(terms: DataFrame, index: LabelIndex, within: int = None) -> DataFrame:
    """(term, label, distance): labels of which some form is within the edit bound of the term.

    Forms are the label and its inflections; the first in this order that is near counts.
    ``within`` returns only distances up to it, and looks no further.
    """
    ways = materialize(_ways(_heads(terms, within), index.sizes, within), "ways")
    asked = _asked(ways).join(index.sizes, "m").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    found = _met(index.strings.join(asked, ["m", "salt"]), ways)
    # near forms have a head near the string; a suffix on a form that was cut already is none
    found = found.filter(F.call_function("levenshtein", F.col("head"), F.col("string"), F.col("left")) >= 0)
    distances = [F.nullif(F.call_function("levenshtein", F.col("term"), form, F.col("k")), F.lit(-1))
                 for form in (F.col("label"), *inflection_slots(F.col("label")))]
    near = (found.select("term", "label", "k").distinct()
            .select("term", "label", F.coalesce(*distances).alias("distance")).filter("distance IS NOT NULL"))
    return near if within is None else near.filter(F.col("distance") <= within)


def containing_labels(terms: DataFrame, index: LabelIndex) -> DataFrame:
    """(term, label) of labels that contain the term, which must not be empty."""
    terms = terms.select("term").filter("term <> ''").distinct()
    long, short = terms.filter(F.length("term") >= 3), terms.filter(F.length("term") < 3)
    rarest = (long.select("term", F.explode(_grams(F.col("term"))).alias("gram")).join(index.gram_counts, "gram")
              .groupBy("term", F.size(_grams(F.col("term"))).alias("wanted")).agg(
                  F.count("*").alias("known"), F.min(F.struct("n", "gram")).alias("g"))
              .filter("known = wanted").select("term", "g.gram"))
    places = F.sequence(F.lit(1), F.length("gram"))
    parts = index.gram_counts.select("gram", F.explode(F.array_distinct(F.concat(
        F.transform(places, lambda i: F.substring("gram", i, F.lit(1))),
        F.transform(places, lambda i: F.substring("gram", i, F.lit(2)))))).alias("term"))
    keys = materialize(rarest.unionByName(short.join(parts, "term").select("term", "gram")), "term-grams")
    grams = index.labels.select("label", F.explode(_grams(F.col("label"))).alias("gram"))
    asked = keys.select("gram").distinct()
    if asked.count() <= KEYS:
        grams = grams.join(F.broadcast(asked), "gram", "left_semi")
    found = grams.join(keys.hint("merge"), "gram").filter(F.contains("label", F.col("term")))
    return found.select("term", "label").distinct()


def close_strings(terms: DataFrame, strings: DataFrame, bound=edit_bound) -> DataFrame:
    """(term, string, distance) of all pairs within the term's bound, which is at most edit_bound."""
    strings = strings.select(F.col("string").alias("label"), "string").distinct()
    sizes = strings.select(F.length("string").alias("m")).distinct()
    ways = materialize(_ways(_plain(terms, bound), sizes), "ways")
    found = _met(_measured(strings).join(_asked(ways), "m"), ways)
    d = F.call_function("levenshtein", F.col("term"), F.col("label"), F.col("k"))
    return (found.select("term", F.col("label").alias("string"), d.alias("distance"))
            .filter("distance >= 0").distinct())
