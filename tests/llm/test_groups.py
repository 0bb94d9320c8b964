"""Spelling variants, prefix trie and near vectors against plain versions."""

from collections import Counter, defaultdict
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tracefold.llm import gridjoin, prefixtrie, variants


# ---- spelling variants

def typed(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c > 1}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def forms(n, factor=10):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w
    return {w: (n[w], form[w], n.get(form[w]), len(near[w]), root(w)) for w in n}


def got_forms(df):
    return {r.word: (r.n, r.form, r.form_n, r.n_near, r.root) for r in df.collect()}


@pytest.mark.parametrize("group, tile", [(2048, 128), (6, 4)])
def test_variants(spark, monkeypatch, group, tile):
    """Small groups force windows to be halved again, small tiles force groups over several tiles."""
    monkeypatch.setattr(variants, "GROUP", group)
    monkeypatch.setattr(variants, "TILE", tile)
    r = random.Random(3)
    n = {}
    for _ in range(60):
        w = "".join(r.choice("abé") for _ in range(r.randrange(1, 11)))
        n[w] = r.choice([2, 3, 30, 400])
        for _ in range(6):
            v, i = list(w), r.randrange(len(w))
            v[i:i + r.randrange(2)] = r.choice(["", "a", "b", "z", "\U0001f600"])
            n.setdefault("".join(v), r.choice([1, 2, 20, 300]))
    n |= {"aaaaaaa": 1, "aaaaaaaa": 10, "aaaaaaaaa": 100, "x" * 3000: 2, "x" * 3001: 20, "": 5}
    n = {w: c for w, c in n.items()}
    df = spark.createDataFrame([(w, c, "x") for w, c in n.items()], "word string, n long, near string")
    assert got_forms(variants.group_variants(df)) == forms(n)


def test_variants_of_documents(spark):
    rows = [(i, f"Wonderful{i % 3} wonderfull wonderful Straße-Éclairs éclairs übermorgen übermorgan") for i in range(90)]
    rows += [(None, "Wonderful wonderfux"), (7, None), (8, ""), (9, " \n"), (9, "wonderful " * 20_000), (9, "unique once")]
    df = spark.createDataFrame([(i, t, 1, "h") for i, t in rows], "doc_id long, text string, n int, run string")
    n = typed(rows)
    words = variants.typed_words(df)
    assert {r.word: r.n for r in words.collect()} == n
    assert got_forms(variants.group_variants(words)) == forms(n)


def test_no_words(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert variants.group_variants(variants.typed_words(df)).count() == 0
    none = spark.createDataFrame([(None, 3), ("same", 2), ("same", 5)], "word string, n long")
    assert got_forms(variants.group_variants(none)) == {"same": (7, None, None, 0, "same")}


# ---- prefix trie

def rebuild(rows):
    conv = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            conv[c].append(((t is not None, t or 0, role or "", text or ""), (role or "", text or "")))
    conv = {c: [v for _, v in sorted(x)] for c, x in conv.items()}
    out = {}
    for c in conv:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = conv.get(c - c % 100, [])[:h] + conv[c][h:]
    return out


def trie(paths):
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
        ends[tuple(p)].append(c)
    kids, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += k not in kids
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items())


def got_trie(df):
    return Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                   for r in df.collect())


def conversation_rows():
    r = random.Random(5)
    rows = []
    for c in range(400):
        length = r.choice([1, 1, 2, 3, 5, 9])
        common = r.random() < 0.4                           # a hot first turn, hot copies
        for t in range(length):
            text = f"t{t}" if common else r.choice(["a", "bb", "\U0001f600é", ""]) + f"{r.randrange(3)}" \
                if r.random() < 0.8 else None
            rows.append((c, t, r.choice(["user", "assistant", None]) if not common else "user", text))
    rows += [(1000, t, "user", "long") for t in range(700)] + [(1001, t, "user", "long") for t in range(701)]
    rows += [(2050, None, None, None), (2051, 3, "user", "x"), (2051, None, "user", "first"), (None, 1, "user", "lost")]
    rows += [(2052, 1, "user", "twice"), (2052, 1, "user", "twice"), (2053, 1, "", "long " * 30_000)]
    return rows


@pytest.mark.parametrize("turns, ids", [(10_000, 4096), (60, 3), (7, 1)])
def test_trie(spark, monkeypatch, turns, ids):
    """Small shards put most inner nodes on the skeleton, small id lists split hot paths."""
    monkeypatch.setattr(prefixtrie, "SHARD_TURNS", turns)
    monkeypatch.setattr(prefixtrie, "ID_LIST", ids)
    rows = conversation_rows()
    df = spark.createDataFrame([(*x, "y", 1) for x in rows],
                               "conv_id long, turn long, role string, text string, path string, shard int")
    want = rebuild(rows)
    assert any(not p for p in want.values())
    assert got_trie(prefixtrie.prefix_trie(*prefixtrie.with_borrowed_starts(df))) == trie(want)


def test_trie_without_turns(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixtrie.prefix_trie(*prefixtrie.with_borrowed_starts(df)).count() == 0
    ids = spark.createDataFrame([(3,), (1,)], "conv_id long")
    assert got_trie(prefixtrie.prefix_trie(df, ids)) == trie({3: [], 1: []})


def test_splitters_cut_between_paths():
    a, b = "a" * 64, "b" * 64
    assert prefixtrie._common(a + b, a + a) == 1 and prefixtrie._common("", a) == 0
    assert prefixtrie.skeleton_of([a + b + a]) == ["", a, a + b]


# ---- near vectors

def plain_links(rows, least=0.95):
    """Pairwise cosines, without blocks or bounds."""
    ok = [i is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in rows]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, (a, v) in enumerate(rows):
        if not ok[i]:
            continue
        for k in range(i):
            if ok[k] and len(rows[k][1]) == len(v) and gridjoin.exact_cosine(np.array(rows[k][1]), np.array(v)) >= least:
                n[i], n[k] = n[i] + 1, n[k] + 1
                parent[root(i)] = root(k)
    low = {}
    for i, (a, _) in enumerate(rows):
        if ok[i]:
            low[root(i)] = min(low.get(root(i), a), a)
    return sorted((str(a), n[i], str(low[root(i)] if ok[i] else a), a is None or not ok[i] or a == low[root(i)])
                  for i, (a, _) in enumerate(rows))


def vector_rows():
    g = np.random.default_rng(2)
    rows, at = [], 0
    for size, noise in ((40, 0.02), (25, 0.1), (60, 0.045), (3, 0.0), (1, 0), (1, 0), (1, 0)):
        centre = g.normal(size=12)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            rows.append((at, [float(x) for x in (centre + noise * g.normal(size=12)) * g.choice([1e-3, 1, 1e9])]))
            at += 1
    rows += [(at + i, [float(x) for x in g.normal(size=12)]) for i in range(60)]
    e = [0.0] * 12
    unit = e[:]
    unit[0] = 1.0
    rows += [(900, None), (901, e), (902, [1.0, None] + e[2:]), (903, [float("nan")] + e[1:]), (904, [float("inf")] + e[1:]),
             (905, []), (None, unit), (906, unit), (907, [-0.0] + e[1:]), (908, [5e-324] + e[1:]), (909, [1e300] + e[1:]),
             (910, [1.0, 0.0]), (911, [3.0, 0.1]), (912, [19.0, (361 / 0.9025 - 361) ** 0.5]), (913, unit), (913, unit[::-1])]
    return rows


@pytest.mark.parametrize("block, leaf, fan", [(4096, 64, 8), (16, 4, 2)])
def test_vectors(spark, monkeypatch, block, leaf, fan):
    for name, value in (("BLOCK", block), ("LEAF", leaf), ("FAN", fan)):
        monkeypatch.setattr(gridjoin, name, value)
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows],
                               "vec_id long, embedding array<double>, block int, id string, n int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in gridjoin.near_vectors(df).collect())
    assert got == plain_links(rows)


def test_distant_blocks_never_meet(spark, monkeypatch):
    """Two far clusters: the recursion drops the pairs of blocks between them."""
    monkeypatch.setattr(gridjoin, "BLOCK", 10)
    g = np.random.default_rng(1)
    rows = [(i, [float(x) for x in (np.eye(8)[i % 2] + 0.01 * g.normal(size=8))]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    epsilon = (2 - 2 * 0.95) ** 0.5
    vectors = gridjoin.materialize(gridjoin.sound_vectors(df), "vectors")
    blocks = gridjoin.materialize(gridjoin.ordered_blocks(vectors, epsilon), "blocks")
    n = blocks.select("block").distinct().count()
    # only a block that holds the end of one cluster and the start of the other meets both
    assert gridjoin.near_intervals(blocks, epsilon).count() < 0.7 * n * (n + 1) / 2
    assert all(r.n_links == 99 for r in gridjoin.near_vectors(df).collect())


def test_no_vectors(spark):
    assert gridjoin.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    bad = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, gridjoin.near_vectors(bad).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
