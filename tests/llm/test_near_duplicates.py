import itertools
import random

import numpy as np
import pytest

from tests.llm.fixtures import EDGES, documents, words
from tracefold.llm import minhash
from tracefold.llm.components import components


def brute(rows, width, percent):
    """doc_id -> (shingles, component) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = minhash.ascii_words(t)
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def copies(seed, groups, each, n):
    r, rows = random.Random(seed), []
    for g in range(groups):
        base = words(seed * 100 + g, n)
        for _ in range(each):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
                w[r.randrange(len(w))] = f"new{r.randrange(9999)}"
            rows.append(" ".join(w))
    r.shuffle(rows)
    return list(enumerate(rows, 1))


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_matches_all_pairs(spark, width, percent):
    rows = copies(3, 8, 12, 120) + [(1000 + i, t) for i, t in copies(4, 30, 3, 7)]
    df = documents(spark, [(i, t, "s") for i, t in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_large_bucket_is_compared_in_full(spark):
    """One hot group: members that the first one isn't linked to still find their links."""
    rows = copies(9, 1, 150, 150)
    df = documents(spark, [(i, t, "s") for i, t in rows])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 3, 85).collect()}
    want = {i: c for i, (_, c) in brute(rows, 3, 85).items()}
    assert len(set(want.values())) > 3
    assert got == want


@pytest.mark.parametrize("bound, value", [("BLOCK_SHINGLES", 3000), ("BLOCK_ROWS", 20)])
def test_blocks_of_a_large_bucket(spark, monkeypatch, bound, value):
    monkeypatch.setattr(minhash, bound, value)
    rows = copies(9, 1, 150, 150)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(
        documents(spark, [(i, t, "s") for i, t in rows]), 3, 85).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 3, 85).items()}


def test_edges(spark):
    got = minhash.near_duplicates(documents(spark, EDGES), 3, 85)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in got.collect())
    assert len(rows) == len(EDGES)
    assert (1, 0, 1, True) in rows and (2, 0, 2, True) in rows and (3, 0, 3, True) in rows
    assert rows.count((4, 1, 4, True)) == 2
    assert (0, 1, None, True) in rows
    assert (5, 1, 5, True) in rows


def test_empty_table(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    assert minhash.keep_one_of_each(documents(spark, [])).count() == 0


def test_one_of_each_stays(spark):
    rows = [(1, "a b c d e f g", "x"), (2, "a b c d e f g", "x"), (2, "a b c d e f g", "x"), (9, "other words here", "y"),
            (9, "other words here", "y"), (None, "n", "y"), (None, "n", "y")]
    df = documents(spark, rows)
    kept = minhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 9]


def test_sketch_fills_and_estimates():
    r = np.random.default_rng(5)
    for n in (1, 3, 40, 3000):
        common = r.integers(1, 2**62, n, dtype=np.uint64)
        a = np.concatenate([common, r.integers(1, 2**62, n // 4, dtype=np.uint64)])
        b = np.concatenate([common, r.integers(1, 2**62, n // 4, dtype=np.uint64)])
        s = minhash.sketch([a, np.zeros(0, np.uint64), b])
        assert (s[[0, 2]] != minhash.EMPTY).all() and (s[1] == minhash.EMPTY).all()
        true = n / (n + 2 * (n // 4))
        assert abs((s[0] == s[2]).mean() - true) < 0.2


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
