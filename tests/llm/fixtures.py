"""Small tables with nulls, empty and long texts, repeats and clashing columns."""

import random


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def documents(spark, rows, extra=True):
    """(doc_id, text, source) rows; further columns carry names the operators use inside."""
    rows = [(i, t, s, "x", 1, 2, 3.0, [1]) for i, t, s in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, id string, shard int, copies int, "
                                     "size double, bands array<int>")
    return df if extra else df.select("doc_id", "text", "source")


EDGES = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (4, "one", "b"), (None, "no id", "b"),
         (5, "long " * 50_000, "a"), (6, " ünïcode  wörds \U0001f600", "a")]
