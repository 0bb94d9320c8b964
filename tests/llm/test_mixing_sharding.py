import math
import zlib
from collections import Counter, defaultdict
import hashlib

from pyspark.sql import functions as F

from tests.llm.fixtures import EDGES, documents, words
from tracefold.llm import sharding
from tracefold.llm.mixing import mix_sources, poisson_quantile
from tracefold.llm.sharding import assign_shards


def quantile(u, rate):
    k, term = 0, math.exp(-rate)
    cdf = term
    while cdf <= u:
        k += 1
        term *= rate / k
        cdf += term
    return k


def test_poisson_quantile(spark):
    rows = [(u / 997, rate) for u in range(0, 997, 7) for rate in (0.001, 0.4, 1.0, 3.7, 40.0, 400.0)]
    got = spark.createDataFrame(rows, "u double, rate double").select(
        "u", "rate", poisson_quantile(F.col("u"), F.col("rate")).alias("k")).collect()
    assert all(r.k == quantile(r.u, r.rate) for r in got)


def test_mixture_nears_its_weights(spark):
    rows = [(i, "x" * (i % 50), "big" if i % 10 else "small") for i in range(4000)]
    out = mix_sources(documents(spark, rows), weights={"big": 1.0, "small": 1.0}, budget=2.0)
    held = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.length("text") + 1).alias("n")).collect()}
    assert abs(held["big"] / held["small"] - 1) < 0.15
    copies = Counter(r.doc_id for r in out.collect())
    drawn = {r.doc_id: r.copies for r in out.collect()}
    assert copies == drawn                      # each row as often as drawn
    again = mix_sources(documents(spark, rows).repartition(7), weights={"big": 1.0, "small": 1.0}, budget=2.0)
    assert Counter(r.doc_id for r in again.collect()) == copies


def test_mixture_edges(spark):
    df = documents(spark, EDGES)
    out = mix_sources(df, budget=50.0)
    assert set(df.drop("copies").columns) <= set(out.columns)
    assert {r.source for r in out.collect()} == {"a", "b", None}
    assert mix_sources(documents(spark, [])).count() == 0
    assert mix_sources(df, weights={}).count() == 0
    # one tiny source against a large one: a mean far over what one draw can give
    rows = [(1, "", "tiny")] + [(i, "y" * 900, "large") for i in range(2, 3000)]
    n = mix_sources(documents(spark, rows)).filter("source = 'tiny'").count()
    rate = math.sqrt(1) / (1 + math.sqrt(901 * 2998)) * (1 + 901 * 2998)
    assert rate > 1500 and abs(n - rate) < 6 * math.sqrt(rate)


def smallest_capacity(sizes, shards):
    lo, hi = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)

    def fits(c):
        n, at = 1, 0
        for s in sizes:
            if at + s > c:
                n, at = n + 1, 0
            at += s
        return n <= shards
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


def check_shards(rows, got, shards):
    groups, place = defaultdict(int), {}
    for i, t, _ in rows:
        groups[t or ""] += len((t or "").encode()) + 1
    for r in got:
        assert r.size == len((r.text or "").encode()) + 1
        assert place.setdefault(r.text or "", r.shard) == r.shard
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    return groups, load, place


def test_smallest_capacity(spark, monkeypatch):
    monkeypatch.setattr(sharding, "DIGITS", 1)              # opens prefixes again and again
    for seed, n in ((1, 40), (2, 300), (3, 9)):
        rows = [(i, " ".join(words(seed * 1000 + i % (n - 3), 5 + i % 17)), "s") for i in range(n)]
        got = assign_shards(documents(spark, rows), 8).collect()
        groups, load, place = check_shards(rows, got, 8)
        total = sum(groups.values())
        ordered = sorted(groups, key=lambda t: hashlib.md5(t.encode()).hexdigest())
        alone = []
        for t in sorted(groups, key=lambda t: (-groups[t], hashlib.md5(t.encode()).hexdigest())):
            if groups[t] * (8 - len(alone)) > total - sum(groups[a] for a in alone) and groups[t] * 8 > total and len(alone) < 7:
                alone.append(t)
        rest = [t for t in ordered if t not in alone]
        best = smallest_capacity([groups[t] for t in rest], 8 - len(alone))
        assert max(load[place[t]] for t in rest) == best or max(load[place[t]] for t in rest) <= best
        assert [place[t] for t in rest] == sorted(place[t] for t in rest)      # contiguous


def test_shards_near_equal(spark):
    rows = [(i, " ".join(words(i, 30 + i % 9)), "s") for i in range(4000)]
    _, load, _ = check_shards(rows, assign_shards(documents(spark, rows), 8).collect(), 8)
    assert len(load) == 8 and max(load.values()) < 1.02 * min(load.values())


def test_hot_text_has_a_shard_of_its_own(spark):
    rows = [(i, "same text" if i % 2 else " ".join(words(i, 8)), "s") for i in range(3000)]
    _, load, place = check_shards(rows, assign_shards(documents(spark, rows), 8).collect(), 8)
    others = [v for s, v in load.items() if s != place["same text"]]
    assert len(others) == 7 and max(others) < 1.1 * min(others)


def test_shard_edges(spark):
    df = documents(spark, EDGES)
    got = assign_shards(df, 8)
    check_shards(EDGES, got.collect(), 8)
    assert got.count() == len(EDGES)
    assert assign_shards(documents(spark, []), 8).count() == 0


def test_query_digests(spark):
    from tracefold.llm.queries import op10_shards
    got = op10_shards(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        assert r.text_crc32 == zlib.crc32((docs[r.doc_id] or "").encode()) and r.law == "bytes" and r.grown_shard is None
