"""Spelling variants: words a single edit apart, grouped under their most frequent form.

Two words with the longer of m code points are near if and only if their common
prefix and their common suffix together reach m - 1.  Words are compared as
padded code-point matrices, block against block: one matrix holds the words from
the left, one from the right, and a tile counts both runs column by column for
all its pairs at once.

Which blocks meet: the first difference of a near pair stands at one place p of
0 .. m - 1, and all before p and all after it is shared.  The places are cut into
windows [lo, m - hi); words that share their first lo and their last hi code
points form the group of a window, and the pair is found in the one group whose
window holds p, once.  Windows start as halves of the word.  The window of a group
with more than GROUP words is halved again, so that its words are dealt anew by
longer shared parts; at a window of one place a group holds at most two words
more than the alphabet has letters.  No group grows with the vocabulary, no pair
but the near ones leaves a task, and none is skipped.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import materialize

GROUP = 2048             # words of a group that meet in one task
TILE = 128               # rows of a tile
KEY = ["m", "lo", "hi", "head", "tail"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of planted deletions: one run in so many loses a code point.
DELETE_EVERY = 31

_LINKS = "word string, n long, near string, near_n long"


def typed_words(docs: DataFrame, least: int = 7) -> DataFrame:
    """(word, n): letter runs of whole texts, some with a code point taken out, and their counts.

    A run whose crc32 of ``doc_id:run`` is divisible by DELETE_EVERY loses the
    code point that the crc32 points to.  Words of fewer than ``least`` code
    points and words that occur once are left out.  Null texts hold no words; a
    null doc_id counts as an empty one.
    """
    # a run of fewer letters can't give a word; runs are maximal as the quantifier is greedy
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col("text").cast("string"),
                                       F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{least},}})"), F.lit(1))).alias("run"))
    runs = runs.select(F.translate("run", UPPER, LOWER).alias("run"), "id")
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    place = F.pmod(F.col("h"), F.length("run")).cast("int")
    words = runs.select(F.when(F.col("h") % DELETE_EVERY == 0, F.concat(
        F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))).otherwise(F.col("run"))
        .alias("word"))
    return (words.filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))
            .filter("n > 1"))


def _halved(rows: DataFrame) -> DataFrame:
    """Each (m, lo, hi, word, n) once for either half of its window, with the parts shared there."""
    half = F.floor((F.col("m") - F.col("lo") - F.col("hi")) / 2).cast("int")
    left = F.struct((F.col("lo") + half).alias("lo"), F.col("hi").alias("hi"))
    right = F.struct(F.col("lo").alias("lo"), (F.col("m") - F.col("lo") - half).alias("hi"))
    rows = rows.select("m", "word", "n", F.inline(F.array(left, right)))
    return rows.select("m", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")).alias("head"),
                       F.substring("word", F.length("word") - F.col("hi") + 1, F.col("hi")).alias("tail"),
                       "word", "n")


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points, padded with zeros to ``width``, a row a word."""
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)


def _run_length(a: np.ndarray, b: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Length of the common start of every row of a with every row of b, where ``run`` is set."""
    run, out = run.copy(), np.zeros(run.shape, np.int32)
    for j in range(a.shape[1]):
        run &= a[:, j, None] == b[None, :, j]
        if not run.any():
            break
        out += run
    return out


def near_in_tile(words, m, group, end, rows, cols):
    """(i, j) of near pairs between two blocks of one or more groups, i before j.

    words: of all rows; m: length of the longer word; group: number of the group;
    end: where the group's window ends.  rows, cols: slices of the two blocks.
    """
    i, j = np.arange(len(words))[rows], np.arange(len(words))[cols]
    size = np.array([len(w) for w in words])
    pairs = (group[i][:, None] == group[j][None, :]) & (i[:, None] < j[None, :])
    pairs &= np.maximum(size[i][:, None], size[j][None, :]) == m[i][:, None]
    if not pairs.any():
        return i[:0], j[:0]
    width = int(size.max())
    turned = [w[::-1] for w in words]
    start = _run_length(_codes(words[rows], width), _codes(words[cols], width), pairs)
    tail = _run_length(_codes(turned[rows], width), _codes(turned[cols], width), pairs)
    # zero padding also agrees, but only between two words shorter than m, which are no pair here
    pairs &= (start + tail >= m[i][:, None] - 1) & (start < end[i][:, None])
    x, y = np.nonzero(pairs)
    return i[x], j[y]


def _solve(batches):
    """Near pairs of sorted groups, both ways; whole groups are packed into tiles."""
    rows, number, last = [], [], None

    def flush():
        words, n = [r[5] for r in rows], np.array([r[6] for r in rows], np.int64)
        m, hi = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
        group = np.array(number)
        a, b = [], []
        for lo in range(0, len(rows), TILE):
            # groups lie together, so a block meets the rows up to the end of its last group
            stop = int(np.searchsorted(group, group[min(lo + TILE, len(rows)) - 1], "right"))
            for at in range(lo, stop, 8 * TILE):
                i, j = near_in_tile(words[lo:stop], m[lo:stop], group[lo:stop], (m - hi)[lo:stop],
                                    slice(0, TILE), slice(at - lo, min(at + 8 * TILE, stop) - lo))
                a.append(i + lo)
                b.append(j + lo)
        a, b = np.concatenate(a), np.concatenate(b)
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        w = pa.array(words, pa.string())
        return pa.RecordBatch.from_arrays([w.take(pa.array(a)), pa.array(n[a]), w.take(pa.array(b)), pa.array(n[b])],
                                          ["word", "n", "near", "near_n"])
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in [*KEY, "word", "n"])):
            if row[:5] != last:
                if len(rows) >= TILE:
                    yield flush()
                    rows, number = [], []
                last = row[:5]
                number.append(number[-1] + 1 if number else 0)
            else:
                number.append(number[-1])
            rows.append(row)
    if rows:
        yield flush()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n), both ways, of distinct words that differ by one edit.

    words: word string, n long; words are distinct and not null.
    """
    size = F.length("word")
    todo = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("m"),
                        F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    done = None
    todo = materialize(_halved(todo), "windows")
    while True:
        hot = materialize(todo.groupBy(*KEY).agg(F.count("*").alias("members"))
                          .filter((F.col("members") > GROUP) & (F.col("m") - F.col("lo") - F.col("hi") > 1)), "hot")
        if hot.isEmpty():
            done = todo if done is None else done.union(todo)
            break
        marked = todo.join(hot, KEY, "left")
        cold = marked.filter("members IS NULL").select(*todo.columns)
        done = cold if done is None else done.union(cold)
        todo = materialize(_halved(marked.filter("members IS NOT NULL").select("m", "lo", "hi", "word", "n")), "windows")
    return done.repartition(*KEY).sortWithinPartitions(*KEY, "word").mapInArrow(_solve, _LINKS)


def group_variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """word, n, form, form_n, n_near, root of every word.

    words: word string, n long, further columns are ignored.  Two words are near if they
    differ by exactly one inserted, deleted or replaced code point.  form: the near word of
    greatest n (ties: the smallest), if that is at least ``factor`` (2 or more) times the
    word's own; else null.  root: the word at the end of the forms.  Null words give no row;
    rows that repeat a word count as one with their n added.  No rows give no rows.
    """
    words = materialize(words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n"))
                        .filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "words")
    best = near_words(words).groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    chosen = F.when(-F.col("best.less") >= factor * F.col("n"), F.col("best.near"))
    best = materialize(best.select("word", "n_near", chosen.alias("form"),
                                   F.when(chosen.isNotNull(), -F.col("best.less")).alias("form_n")), "near")
    # n grows by the factor along forms, so chains are short; each round doubles the steps taken
    most = words.agg(F.max("n")).first()[0] or 1
    longest = 1 + math.floor(math.log(max(most, 1)) / math.log(factor))
    steps = best.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        steps = materialize(steps.join(onward, "root", "left")
                            .select("word", F.coalesce("onward", "root").alias("root")), "roots")
    return (words.join(best, "word", "left").join(steps, "word", "left")
            .select("word", "n", "form", "form_n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                    F.coalesce("root", "word").alias("root")))
