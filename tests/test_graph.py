"""Evidence, traversal, lookup and similarity on hand-checked graphs."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import edge, fact_rows, graph_of, labels
from tracefold.functions import measures
from tracefold.operators import (associations, coverage, evidence, labelindex, lookup, matching, observe, quality,
                                 resolve, similar, waves)
from tracefold.sources import scratch

FRUIT = ["apples are red", "apples are round", "circles are round"]
TEN = ["bananas are yellow", "bananas are sweet", "lemons are yellow", "lemons are sour",
       "apples are red", "apples are sweet", "apples are round", "circles are round",
       "cherries are red", "cherries are sweet"]


def test_edge_measures(spark):
    rows = spark.createDataFrame(
        [(0, 0), (1, 3), (0, 5), (5, 5), (100, 0), (0, 100), (100, 100)],
        "traversals long, refutations long")
    got = measures.with_edge_measures(rows.withColumn(
        "strength", measures.strength(F.col("traversals"), F.col("refutations")))).collect()
    assert [r.state for r in got] == ["unknown", "refuted", "refuted", "contested", "believed",
                                      "refuted", "contested"]
    assert [round(r.strength, 4) for r in got[:4]] == [1.0, 0.3069, -0.7918, 1.0]
    assert [r.is_refuted for r in got] == [False, True, True, False, False, True, False]


@pytest.mark.parametrize("teach, refute, t, r", [(2, 3, 1, 3), (0, 5, 0, 5), (6, 5, 5, 5)])
def test_counters(spark, teach, refute, t, r):
    said = [("apples are red", "teach", None)] * teach + [("apples are red", "refute", None)] * refute
    g = graph_of(spark, said)
    for e in (edge(g, "red", "apple_color"), edge(g, "apple_color", "apple")):
        assert (e.traversals, e.refutations) == (t, r)
        assert math.isclose(e.strength, 1 + math.log1p(t) - math.log1p(r))


def test_tentative_needs_a_second_source(spark):
    one = graph_of(spark, [("apples are red", "teach", "s1")] * 2, "tentative")
    e = edge(one, "red", "apple_color")
    assert (e.traversals, e.witnesses, e.strength) == (0, 1, 0.4)
    two = graph_of(spark, [("apples are red", "teach", s) for s in ("s1", "s1", "s2")], "tentative")
    e = edge(two, "red", "apple_color")
    assert (e.traversals, e.witnesses, round(e.strength, 4)) == (1, 2, 1.6931)


def test_blank_source_never_strengthens_but_absent_does(spark):
    blank = graph_of(spark, [("apples are red", "teach", s) for s in ("  ", " ", "")])
    assert edge(blank, "red", "apple_color").traversals == 0
    absent = graph_of(spark, ["apples are red"] * 3)
    assert edge(absent, "red", "apple_color").traversals == 2


def test_error_teaching_starts_high_and_drops(spark):
    once = graph_of(spark, ["apples are red"], "error")
    assert edge(once, "red", "apple_color").strength == 2.0


def _replay(events):
    """Plain replay of one edge's events: the rule the fold must reproduce."""
    t = r = 0
    seen, created = set(), False
    for kind, source in events:
        fresh = False
        if source is not None and source.strip() and source.strip() not in seen:
            seen.add(source.strip())
            fresh = True
        if kind == "refute":
            r += 1
        elif created and (source is None or fresh):
            t += 1
        created = True
    return t, r, len(seen)


def test_fold_equals_replay_in_any_order(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for k in range(60):
        events = [(rng.choice(["teach", "teach", "refute"]),
                   rng.choice([None, "", " ", "a", "b", "c"])) for _ in range(rng.randint(1, 9))]
        want[f"e{k}"] = _replay(events)
        rows += [("main", f"e{k}", "x", "r", kind, s, i) for i, (kind, s) in enumerate(events)]
    rng.shuffle(rows)
    log = evidence.links(spark.createDataFrame(
        rows, "region string, src string, dst string, relation string, kind string, "
        "source_label string, seq long").withColumns({
            "src_type": F.lit("property"), "dst_type": F.lit("relation"),
            "source_label": F.trim("source_label")}).repartition(5))
    got = {e.src: (e.traversals, e.refutations, e.witnesses)
           for e in evidence.fold_evidence(log).collect()}
    assert got == want
    last = evidence.running_strength(log).groupBy("src").agg(
        F.max_by("traversals", "nth").alias("t"), F.max_by("refutations", "nth").alias("r"))
    assert {e.src: (e.t, e.r) for e in last.collect()} == {k: v[:2] for k, v in want.items()}


def test_counts_after_two_statements(spark):
    g = graph_of(spark, FRUIT[:2])
    assert (g.nodes.count(), g.edges.count(), g.paths.count()) == (5, 4, 2)
    assert {r.label for r in g.nodes.collect()} == {"red", "round", "apple", "apple_color",
                                                    "apple_shape"}
    s = coverage.stats(g.nodes, g.edges, g.paths).collect()[0]
    assert (s.nodes, s.edges, s.paths) == (5, 4, 2)


def test_sub_concept_links(spark):
    g = graph_of(spark, ["tteh edubba was a sumerian school"] * 2)
    e = edge(g, "sumerian", "sumerian school")
    assert (e.relation, e.traversals) == ("part_of", 1)


def test_refutation_marker_and_second_path(spark):
    g = graph_of(spark, [("apples are red", "refute", None)])
    assert evidence.refuted_nodes(g.edges).collect()[0].label == "apple"
    assert g.paths.count() == 2
    assert edge(g, "apple", "apple_refuted").refutations == 0


def _inputs(spark, groups):
    return spark.createDataFrame([("main", g, x) for g, xs in groups.items() for x in xs],
                                 "region string, group_id string, label string")


def test_recognize(spark):
    g = graph_of(spark, FRUIT)
    got = {r.node: (r.confidence, r.signed_confidence) for r in waves.recognize(
        _inputs(spark, {"q": ["red", "round", "red"]}), g.edges).collect()}
    assert got["apple"] == (2, 2.0)
    assert {k for k, v in got.items() if v[0] == 1} == {"apple_color", "apple_shape", "circle",
                                                        "circle_shape"}


def test_recognize_many_groups_at_once(spark):
    g = graph_of(spark, TEN)
    rows = waves.recognize(_inputs(spark, {"b": ["yellow", "sweet"], "l": ["yellow", "sour"]}),
                           g.edges, min_seeds=2).collect()
    assert {(r.group_id, r.node, r.confidence) for r in rows} == {("b", "banana", 2),
                                                                 ("l", "lemon", 2)}


def test_why_and_trace(spark):
    g = graph_of(spark, FRUIT)
    why = lookup.why(labels(spark, ["apple"]), g.paths, g.edges).collect()
    assert {r.source_text for r in why} == {"apples are red", "apples are round"}
    trace = waves.trace(labels(spark, ["red"]), g.edges).collect()
    assert {tuple(r.path) for r in trace} == {("red", "apple_color"),
                                              ("red", "apple_color", "apple")}


def test_why_threshold(spark):
    g = graph_of(spark, [("apples are red", "refute", None)] * 5)
    asked = labels(spark, ["apple"])
    assert lookup.why(asked, g.paths, g.edges).count() == 0
    kept = lookup.why(asked, g.paths, g.edges, min_strength=None)
    assert all(round(r.weight, 2) == -0.79 for r in kept.collect())
    assert lookup.refuted_answers(kept).collect()[0].standing == "refuted"


def test_similarity(spark):
    g = graph_of(spark, FRUIT[:2])
    (row,) = similar.similarity(g.nodes, g.edges).collect()
    assert (row.a, row.b, row.shared, round(row.overlap, 6)) == ("red", "round", 1, 0.333333)
    apart = graph_of(spark, ["apples are red", "circles are round"])
    assert similar.similarity(apart.nodes, apart.edges).count() == 0


def test_similarity_of_a_hot_node_is_whole(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 3)
    g = graph_of(spark, [f"apples are p{i}" for i in range(12)])
    rows = similar.similarity(g.nodes, g.edges).collect()
    assert len(rows) == 66 and all(r.shared == 2 for r in rows)


def test_cluster(spark):
    g = graph_of(spark, ["apples are red", "apples are sweet", "apples are round"])
    rows = waves.cluster(labels(spark, ["apple"]), g.edges).orderBy("rank").collect()
    assert [(r.hops, r.connections, r.direction) for r in rows] == \
        [(1, 1, "outgoing")] * 3 + [(2, 1, "outgoing")] * 3
    assert {r.node for r in rows[:3]} == {"apple_color", "apple_taste", "apple_shape"}


def _random_edges(spark, seed, n=30, m=90):
    rng = random.Random(seed)
    rows = {}
    for _ in range(m):
        a, b, rel = f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice(["r", "q"])
        rows[("main", a, b, rel)] = rng.choice([0.2, 0.6, 1.0, 1.0, 1.7])
    df = spark.createDataFrame([(*k, v) for k, v in rows.items()],
                               "region string, src string, dst string, relation string, "
                               "strength double")
    return rows, df


def _queue_wave(rows, seed, depth, floor, both):
    """Queue-order breadth-first wave written from its description."""
    out, inn, best = {}, {}, {}
    for (_, a, b, rel), s in rows.items():
        out.setdefault(a, []).append((-s, b, rel))
        inn.setdefault(b, []).append((-s, a, rel))
        best[(a, b)] = max(s, best.get((a, b), -9))
    seen, queue, found = {seed}, [[seed]], {}
    for _ in range(depth):
        nxt = []
        for path in queue:
            steps = sorted(out.get(path[-1], []))
            steps = steps + (sorted(inn.get(path[-1], [])) if both else [])
            for neg, b, _rel in steps:
                if -neg >= floor and b not in seen:
                    seen.add(b)
                    nxt.append(path + [b])
                    found[b] = path + [b]
        queue = nxt
    return {b: (p, sum(w) / len(w) if (w := [best[h] for h in zip(p, p[1:]) if h in best]) else 0.0)
            for b, p in found.items()}


@pytest.mark.parametrize("both", [False, True])
def test_wave_equals_queue_order(spark, both):
    rows, edges = _random_edges(spark, 3)
    seeds = [f"n{i}" for i in range(0, 30, 3)]
    got = {}
    for r in waves.propagate(
            labels(spark, seeds, "seed").withColumn("min_strength", F.lit(0.5)),
            waves.adjacency(edges, both), 3).collect():
        got.setdefault(r.seed, {})[r.node] = (list(r.path), round(r.weight, 9))
    for s in seeds:
        want = {k: (p, round(w, 9)) for k, (p, w) in _queue_wave(rows, s, 3, 0.5, both).items()}
        assert got.get(s, {}) == want


def test_echo_equals_loop(spark):
    rows, edges = _random_edges(spark, 8, n=25, m=45)
    events = {"a": ["n1", "n2"], "b": ["n3"]}
    want = {}
    for event, start in events.items():
        used, current, conv = set(start), list(start), {}
        for _ in range(3):
            fresh = []
            for s in current:
                for node, (_, w) in _queue_wave(rows, s, 3, 0.5, True).items():
                    tot, cnt = conv.get(node, (0.0, 0))
                    conv[node] = (tot + w, cnt + 1)
                    if node not in used:
                        used.add(node)
                        fresh.append(node)
            if not fresh:
                break
            current = fresh
        want.update({(event, n): (round(w, 6), c) for n, (w, c) in conv.items()})
    seeds = spark.createDataFrame([("main", e, x, 0.5) for e, xs in events.items() for x in xs],
                                  "region string, event_id string, label string, "
                                  "min_strength double")
    got = waves.echo(seeds, waves.adjacency(edges, True)).collect()
    assert {(r.event_id, r.node): (round(r.weight, 6), r.sources) for r in got} == want


def test_multi_echo_blends_levels(spark):
    _, edges = _random_edges(spark, 8, n=25, m=45)
    seeds = spark.createDataFrame([("main", "a", "n1")],
                                  "region string, event_id string, label string")
    got = {r.node: r.activation for r in waves.multi_echo(seeds, edges, min_label=1).collect()}
    want = {}
    for floor, mult in [(0.5, 3.0), (0.3, 2.0), (0.1, 1.0)]:
        one = waves.echo(seeds.withColumn("min_strength", F.lit(floor)),
                         waves.adjacency(edges, True), max_rounds=2)
        for r in one.collect():
            want[r.node] = want.get(r.node, 0.0) + mult * r.weight
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}


def test_reach_is_bounded_and_handles_cycles(spark):
    edges = spark.createDataFrame([("main", f"n{i}", f"n{(i + 1) % 14}", "r", 1.0)
                                   for i in range(14)],
                                  "region string, src string, dst string, relation string, "
                                  "strength double")
    got = {r.node: r.hops for r in waves.reach(labels(spark, ["n0"]), edges).collect()}
    assert got == {f"n{i}": i for i in range(1, 11)}


@pytest.mark.parametrize("seed", [2])
def test_reach_over_kinds_is_that_of_every_node(spark, seed):
    rng = random.Random(seed)
    # a few seeds, layers of nodes with few different in-neighbours, and random edges that close cycles
    pairs = {(f"p{rng.randrange(4)}", f"a{i}") for i in range(12)} | {("p0", "p1"), ("a1", "p2"), ("lone", "p3")}
    pairs |= {(f"a{rng.randrange(12)}", f"b{i}") for i in range(14) for _ in range(2)}
    pairs |= {(f"b{rng.randrange(14)}", f"a{rng.randrange(12)}") for _ in range(seed)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    want = set()
    for start in (f"p{i}" for i in range(4)):
        seen, front = {start}, {start}
        for hops in (1, 2, 3, 4):
            front = {y for x in front for y in near.get(x, ())} - seen
            seen |= front
            want |= {(start, y, hops) for y in front}
    edges = spark.createDataFrame([("main", a, b) for a, b in pairs], "region string, src string, dst string")
    seeds = labels(spark, [f"p{i}" for i in range(4)])
    got = [(r.seed, r.node, r.hops) for r in waves.reach(seeds, edges, 4).collect()]
    assert sorted(got) == sorted(want)
    reached, members = waves.reach_kinds(seeds, edges, 4)
    starts = {}
    for _, node, _ in want:
        starts[node] = starts.get(node, 0) + 1
    met = {r.node: r.starts for r in waves.reach_intersections(reached, members).collect()}
    assert met == {k: n for k, n in starts.items() if n > 1}


def test_groups_and_events_are_added_up_where_their_nodes_are(spark):
    edges = spark.createDataFrame([("main", "red", "a", 1.0), ("main", "round", "a", 1.0)],
                                  "region string, src string, dst string, strength double")
    asked = labels(spark, ["red", "round"])
    for found, column in ((waves.recognize(asked.withColumn("group_id", F.lit("g")), edges), "group_id"),
                          (waves.converge(asked.withColumn("event_id", F.lit("e")), edges), "event_id")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        moved = [x for x in plan.split("\n") if "hashpartitioning" in x and column in x.split("hashpartitioning")[1]]
        assert not moved


def test_equal_nodes_are_reached_once(spark):
    def rows(n):
        g = graph_of(spark, [f"item{i} are {p}" for i in range(n) for p in ("red", "round")])
        seeds = g.nodes.filter("node_type = 'property'")
        return waves.reach_kinds(seeds, g.edges)[0].count(), similar.similarity(g.nodes, g.edges).collect()[0].shared
    assert rows(3)[0] == rows(30)[0] and rows(30)[1] == 30


def test_reinforce_adds_one_per_edge(spark):
    rows = fact_rows(spark, FRUIT)
    log = evidence.teach(rows)
    edges = evidence.fold_evidence(log)
    wave = waves.trace(labels(spark, ["red", "round"]), edges)
    more = evidence.fold_evidence(log.unionByName(waves.reinforce(wave, edges, 100)))
    assert {r.traversals for r in more.collect()} == {1}


def test_curiosity(spark):
    g = graph_of(spark, ["apples are red", "apples are round", "apples are sweet"])
    (row,) = coverage.curiosity(labels(spark, ["apple"], "topic"), g.paths, g.edges).collect()
    assert (row.depth, row.neighbors, row.tier, row.has_depth) == (3, 3, "growing", True)


def test_resolve_tiers(spark):
    g = graph_of(spark, ["sumerians are old", "children are happy", "ancient ziggurats are tall"])
    terms = labels(spark, ["children", "sumerians", "sumer", "iggur", "childen", "qqqqqqqq"], "term")
    got = {r.term: (r.label, r.method, r.distance)
           for r in resolve.resolve(terms, g.nodes).filter("rank = 1").collect()}
    assert got["children"] == ("children", "exact", 0)
    assert got["sumerians"][:2] == ("sumerian", "inflect")
    assert got["sumer"][:2] == ("sumerian", "inflect")
    assert got["iggur"][:2] == ("ziggurat", "contains")
    assert got["childen"] == ("children", "fuzzy", 1)
    assert "qqqqqqqq" not in got


def _edit(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_close_strings_equals_brute_force(spark):
    rng = random.Random(11)
    words = list({"".join(rng.choice("abc") for _ in range(rng.randint(1, 11)))
                  for _ in range(140)})
    terms, stored = words[:60], words[60:]
    want = {(a, b, _edit(a, b)) for a, b in itertools.product(terms, stored)
            if _edit(a, b) <= max(2, len(a) // 3)}
    got = labelindex.close_strings(labels(spark, terms, "term"), labels(spark, stored, "string"))
    assert {tuple(r) for r in got.select("term", "string", "distance").collect()} == want


def _forms(label):
    """Inflected forms in lookup order."""
    first = second = last = None
    if label.endswith("ians"):
        first, second = label[:-4], label[:-1]
    elif label.endswith("ian"):
        first, second = label[:-3], label + "s"
    elif label.endswith("ans"):
        first, second = label[:-3], label[:-1]
    elif label.endswith("an"):
        first = label[:-2]
    if label.endswith("ies"):
        last = label[:-3] + "y"
    elif label.endswith("es"):
        last = label[:-2]
    elif label.endswith("s") and not label.endswith("ss"):
        last = label[:-1]
    return [label, *(label + x for x in ("s", "es", "ian", "ians", "an")), *(f for f in (first, second, last) if f is not None)]


@pytest.mark.parametrize("hot, letters, longest", [(20_000, "abé", 9), (2, "ains", 24)])
def test_label_index_equals_brute_force(spark, monkeypatch, hot, letters, longest):
    """Near and containing labels of terms of every length, with and without salted keys."""
    monkeypatch.setattr(labelindex, "HOT", hot)
    rng = random.Random(longest)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(70)}
    for w in list(words):
        for _ in range(2):
            v = list(w + rng.choice(["", "", "ians", "s"]))
            for _ in range(rng.randint(0, max(2, len(w) // 3))):
                i = rng.randrange(len(v) + 1)
                v[i:i + rng.randrange(2)] = rng.choice([[], list(rng.choice(letters))])
            words.add("".join(v))
    words = sorted(words - {""})
    rng.shuffle(words)
    terms, stored = words[:len(words) // 2] + ["", "zzzzzz"], words[len(words) // 2:] + ["flies", "a b's \\E"]
    index = labelindex.build_index(labels(spark, stored))
    want = set()
    for t, s in itertools.product(terms, stored):
        near = [d for d in (_edit(t, f) for f in _forms(s)) if d <= max(2, len(t) // 3)]
        if near:
            want.add((t, s, near[0]))
    df = labels(spark, terms, "term")
    assert {tuple(r) for r in labelindex.near_labels(df, index).collect()} == want
    assert {tuple(r) for r in labelindex.containing_labels(df, index).collect()} == {
        (t, s) for t, s in itertools.product(terms, stored) if t and t in s}


def test_label_index_is_read_without_an_exchange(spark):
    """Even where nothing is broadcast, only the terms' side is dealt out."""
    index = labelindex.build_index(labels(spark, [f"label number {i}" for i in range(50)]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = labelindex.near_labels(labels(spark, ["labell nomber"], "term"), index)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = [i for i, line in enumerate(plan.split("\n")) if "tracefold_" in line and "Scan" in line]
    above = "\n".join(plan.split("\n")[scan[0] - 3:scan[0]])
    assert len(scan) == 1 and "Bucketed: true" in plan and "Exchange" not in above


def test_label_index_follows_its_labels(spark, monkeypatch):
    """It stores no piece of a label; best results are those of the whole search, whatever keys are sent."""
    stored = [f"part#{i}" for i in range(300)] + [f"part#{i}_type" for i in range(40)] + ["cities", "city", "large ring"]
    index = labelindex.build_index(labels(spark, stored))
    assert index.strings.count() <= 2 * len(stored)
    terms = labels(spark, [f"pert#{i}" for i in range(0, 300, 7)] + ["pxrt#17_tyqe", "citiex", "lerge rung", "zzz"], "term")
    want = sorted(map(tuple, resolve.resolve(terms, index).filter("rank <= 2").collect()))
    assert len({r[0] for r in want}) == terms.count() - 1
    assert sorted(map(tuple, resolve.resolve(terms, index, 2).collect())) == want
    monkeypatch.setattr(labelindex, "KEYS", 0)
    assert sorted(map(tuple, resolve.resolve(terms, index, 2).collect())) == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_topics_are_not_sent_whole(spark):
    """However small the file of the topics, their joins gather no side in the driver."""
    statements = spark.createDataFrame([(1, "teach", "s1", None, 5), (1, "refute", "s2", None, 7), (2, "teach", None, None, 9)],
                                       "topic long, kind string, source_label string, initial_strength double, seq long")
    topics = spark.createDataFrame([(t, "r", f"p{t}", "has_x", "red", "x", f"p{t} has_x red") for t in (1, 2)],
                                   "topic long, region string, subject string, relation string, obj string, ptype string, source_text string")
    said = evidence.Said(statements, topics)
    counters = evidence.topic_counters(said)
    for df in (evidence.topic_log(said, counters), evidence.counted_facts(said, counters)):
        assert "BroadcastHashJoin" not in _plan(df) and df.count() > 0


def test_topic_witnesses_are_those_of_the_log(spark):
    rows = [(1, "teach", " s1", None, 5), (1, "refute", "s1", None, 3), (1, "teach", "", None, 1), (2, "teach", "s1", None, 2),
            (2, "teach", None, None, 9), (3, "teach", "s3", None, 4)]
    statements = spark.createDataFrame(rows, "topic long, kind string, source_label string, initial_strength double, seq long")
    # topics 1 and 3 say the same
    topics = spark.createDataFrame([(t, "r", s, "has_x", "dark red", "x", "") for t, s in ((1, "p1"), (2, "p2"), (3, "p1"))],
                                   "topic long, region string, subject string, relation string, obj string, ptype string, source_text string")
    asked = spark.createDataFrame([("r", "dark red", "p1_x", "has_x"), ("r", "p2_x", "p2", "describes")],
                                  "region string, src string, dst string, relation string")
    log = evidence.teach(evidence.facts(statements.join(topics, "topic")))
    want = evidence.witnesses(log).join(asked, evidence.EDGE_KEY, "left_semi").select(*evidence.EDGE_KEY, "source", "first_seq")
    got = evidence.topic_witnesses(evidence.Said(statements, topics), asked).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 3


def test_text_joins_send_no_tokens(spark, monkeypatch):
    """A side is sent whole only if it is few rows by count; nothing is where no rows are."""
    texts = spark.createDataFrame([(1, "red apples are sweet"), (2, "green apples")], "text_id long, text string")
    patterns = spark.createDataFrame([("apple",), ("red apples",)], "pattern string")
    words = spark.createDataFrame([("apples",), ("red apples",)], "label string")
    want = [(1, "apple"), (1, "red apples"), (2, "apple")]
    assert sorted(map(tuple, matching.contains_join(texts, patterns).collect())) == want
    monkeypatch.setattr(scratch, "SENT", 0)
    found = matching.contains_join(texts, patterns)
    assert sorted(map(tuple, found.collect())) == want and "BroadcastHashJoin" not in _plan(found)
    found = matching.word_join(texts, words)
    assert found.count() == 3 and "BroadcastHashJoin" not in _plan(found)


def test_waves_send_no_level_of_many_rows(spark, monkeypatch):
    g = graph_of(spark, TEN)
    adj = waves.stored_adjacency(g.edges)
    seeds = labels(spark, ["red", "sweet"]).select("region", F.col("label").alias("seed"), F.lit(0.5).alias("min_strength"))
    want = sorted(map(str, waves.propagate(seeds, adj, 2).collect()))
    monkeypatch.setattr(scratch, "SENT", 0)
    found = waves.propagate(seeds, adj, 2)
    # all but the join of the seeds
    assert _plan(found).count("BroadcastHashJoin") <= 1 and sorted(map(str, found.collect())) == want


def test_kinds_are_not_sent_whole(spark, monkeypatch):
    g = graph_of(spark, TEN)
    seeds = labels(spark, ["red", "sweet", "yellow"])
    want = sorted(map(tuple, waves.reach(seeds, g.edges).collect()))
    sides = []
    monkeypatch.setattr(waves, "sent", lambda side: sides.append(side.columns) or side.hint("merge"))
    assert sorted(map(tuple, waves.reach(seeds, g.edges).collect())) == want
    assert ["region", "next"] in sides and ["region", "node", "kind"] in sides


def test_key_map_keeps_asked_keys(spark):
    """All asked keys stay however many there are, and hardly any other."""
    rows = spark.range(4000).select(F.xxhash64("id").alias("key"), "id")
    kept = labelindex._mapped(rows, labelindex._key_map(rows.filter("id % 4 = 0")))
    ids = {r.id for r in kept.select("id").collect()}
    assert ids >= set(range(0, 4000, 4)) and len(ids) < 1100 and kept.columns == rows.columns


def test_typos_count_edits_in_bytes(spark):
    """As SQL does: an accent that is dropped is two edits, two of them are four."""
    counts = {"gr\u00e4ser": 5, "graser": 1, "gr\u00e8ser": 2, "\u00e9l\u00e8ve": 5, "eleve": 1}
    paths = spark.createDataFrame([("m", a, "x", "a text") for a, n in counts.items() for _ in range(n)],
                                  "region string, origin string, terminus string, source_text string")
    nodes = spark.createDataFrame([("m", a) for a in counts], "region string, label string")
    got = quality.suspected_typos(nodes, paths).select("label", "canonical", "distance").collect()
    assert sorted(map(tuple, got)) == [("graser", "gr\u00e4ser", 2), ("gr\u00e8ser", "gr\u00e4ser", 1)]


def test_ambiguity_holds_statement_back(spark):
    g = graph_of(spark, ["children are loved"] * 3)
    said = spark.createDataFrame([(1, "childen", "happy"), (2, "children", "loved")],
                                 "statement_id long, subject string, obj string")
    clean, held = resolve.check_ambiguity(said, g.nodes, g.paths, ["harm"])
    assert [r.statement_id for r in clean.collect()] == [2]
    (row,) = held.collect()
    assert (row.statement_id, row.term, row.candidate, row.distance) == (1, "childen", "children", 1)


def test_associations(spark):
    rows = spark.createDataFrame([("mood", "happy", 1), ("mood", "sad", 2), ("odor", "foul", 3)],
                                 "association string, property string, seq long")
    known = spark.createDataFrame([("Mood ", "how", 1)],
                                  "association string, question_word string, seq long")
    defined = associations.define_associations(known)
    log, registered, unknown = associations.describe_associations(rows, defined)
    assert {e.strength for e in evidence.fold_evidence(log).collect()} == {0.1}
    assert [r.association for r in unknown.collect()] == ["odor"]
    from tracefold.functions.statements import parse_statements
    said = parse_statements(spark.createDataFrame([(1, "dogs are happy")], "seq long, text string"),
                            "text", properties=associations.taxonomy_from(registered))
    facts = evidence.facts(said.withColumn("source_text", F.col("original")))
    assert "dog_mood" in {r.label for r in evidence.fold_nodes(evidence.teach(facts)).collect()}
    asked = spark.createDataFrame([("main", "dog", "mood")],
                                  "region string, subject string, association string")
    got = lookup.query_association(asked, evidence.paths_of(facts),
                                   associations.association_properties(spark, registered))
    assert [r.property for r in got.collect()] == ["happy"]


def test_pollution_and_cleanup(spark):
    texts = ["when are round", "apples, are red", "teh are blue"]
    g = graph_of(spark, texts)
    found = {(r.label, r.kind) for r in
             quality.detect_pollution(g.nodes, g.edges, g.paths).collect()}
    assert ("when", "stopword_subject") in found
    assert ("apples,", "punctuation_artifact") in found and ("teh", "article_typo") in found
    bad = labels(spark, ["when"])
    refuting = quality.refute_paths_of(bad, g.paths, 1000)
    marks = quality.mark_cleaned(bad, g.edges, 1001)
    log = quality.cleaned_log(evidence.teach(g.facts), refuting, marks)
    edges = evidence.fold_evidence(log)
    again = {r.label for r in quality.detect_pollution(g.nodes, edges, g.paths).collect()}
    assert "when" not in again and "teh" in again
    assert edges.filter("src = 'round' and relation = 'has_shape'").collect()[0].refutations == 1


def test_corrections_and_verification(spark):
    seen = spark.createDataFrame([("img1", "red", 1), ("img1", "round", 2)],
                                 "item string, property string, seq long")
    fix = spark.createDataFrame([("img1", "apple", 5)], "item string, label string, seq long")
    taught = {(r.subject, r.obj) for r in observe.apply_corrections(seen, fix).collect()}
    assert taught == {("img1", "apple"), ("apple", "red"), ("apple", "round")}
    g = graph_of(spark, ["apples are red", "apples are sweet"])
    main = seen.withColumn("region", F.lit("main"))
    top = spark.createDataFrame([("main", "img1", "apple")],
                                "region string, item string, label string")
    rest = observe.verification_candidates(main.select("region", "item", "property"), top,
                                           g.paths, g.edges)
    assert [r.property for r in rest.collect()] == ["sweet"]


def test_templates(spark):
    rows = spark.createDataFrame([("main", " QMSE ", "a b c", 1)],
                                 "region string, topic string, content string, seq long")
    log = evidence.store_templates(rows)
    got = evidence.get_templates(labels(spark, ["qmse"], "topic"), log)
    assert [r.content for r in got.collect()] == ["a b c"]


def test_topics_fold_like_their_log(spark):
    """Statements counted per topic give the edges, nodes and paths of the whole log, and one row per edge and topic."""
    statements = spark.createDataFrame(
        [(t, k, s, i, n) for n, (t, k, s, i) in enumerate(
            [(1, "teach", "a", None), (1, "teach", "a", 0.4), (1, "refute", "b", None), (2, "teach", "a", None),
             (2, "teach", " ", None), (3, "refute", "a", 0.3), (3, "teach", None, None), (4, "teach", "b", None),
             (4, "teach", "c", None), (1, "teach", "c", None), (5, "teach", None, None)] * 3)],
        "topic long, kind string, source_label string, initial_strength double, seq long")
    # topics 1 and 2 share the edge m_p -> m, topic 3 says one thing twice, a word link meets a taught part_of
    topics = spark.createDataFrame(
        [(1, "m", "has", "red", "p"), (2, "m", "has", "blue", "p"), (3, "big box", "is", "old thing", "p"),
         (3, "big box", "is", "old thing", "p"), (4, "box", "part_of", "big", "x"), (4, "n", "has", "red", "p"),
         (5, "o", "has", "two words", "p"), (6, "never", "has", "said", "p")],
        "topic long, subject string, relation string, obj string, ptype string").selectExpr(
        "*", "'r' AS region", "concat_ws(' ', subject, relation, obj) AS source_text")
    said = evidence.Said(statements, topics)
    counters = evidence.topic_counters(said)
    rows = evidence.facts(statements.join(topics, "topic"))
    log = evidence.teach(rows)

    def same(got, want):
        columns = want.columns
        assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.collect()))
    same(evidence.fold_topics(said, counters), evidence.fold_evidence(log))
    same(evidence.fold_nodes(evidence.topic_log(said, counters)), evidence.fold_nodes(log))
    assert evidence.topic_log(said, counters).count() < log.count() / 3
    key = ["region", "part", "origin", "terminus", "chain", "source_text"]
    same(evidence.paths_of(evidence.counted_facts(said, counters)).groupBy(*key).agg(
             F.sum("times").alias("n"), F.min("seq").alias("first")),
         evidence.paths_of(rows).groupBy(*key).agg(F.count("*").alias("n"), F.min("seq").alias("first")))


def test_chain_ids_are_short(spark):
    """Every step of the dictionary and every path carries one."""
    g = graph_of(spark, TEN)
    ids = [r.chain for r in g.paths.select("chain").distinct().collect()]
    assert len(ids) == len(TEN) and {len(i) for i in ids} == {16}


def test_contains_join_meets_tokens(spark):
    """Every place a pattern can start or end at, blanks included, against brute force."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab  c\n.") for _ in range(rnd.randint(0, 30))) for _ in range(60)] + [None, "", " "]
    patterns = sorted({"".join(rnd.choice("ab  c") for _ in range(rnd.randint(1, 7))) for _ in range(150)} | {" ", "  ", ""})
    got = matching.contains_join(
        spark.createDataFrame(list(enumerate(texts)), "text_id int, text string"),
        spark.createDataFrame([(p,) for p in patterns], "pattern string"), min_len=1).collect()
    want = sorted((i, p) for i, t in enumerate(texts) if t is not None for p in patterns if p and p in t)
    assert sorted((r.text_id, r.pattern) for r in got) == want


def test_contains_join_candidates_follow_the_matches(spark):
    """Numbered labels meet the few tokens they begin, not all that share three characters."""
    names = [f"customer#{i}" for i in range(3000)]
    frame = spark.createDataFrame([(n,) for n in names], "token string")
    met = matching._inside(frame, frame.withColumnRenamed("token", "piece"))
    assert met.count() == sum(p in {n[:k] for k in range(len(n) + 1)} for n in names for p in
                              {n[:k] for k in range(10, len(n) + 1)} if p in set(names))


def test_converge_among_asked_pairs(spark):
    """Scores of texts come from the pairs their words name; an event doesn't meet all its seeds reach."""
    from tracefold.operators import answers
    g = graph_of(spark, [f"part {i} has name ring" for i in range(6)] + ["ring is round", "gold is round"])
    seeds = spark.createDataFrame([("main", 1, "round"), ("main", 1, "ring"), ("main", 1, "ring"), ("main", 2, "round")],
                                  "region string, event_id int, label string")
    whole = waves.converge(seeds, g.edges).select("event_id", "node", "weight", "sources")
    asked = spark.createDataFrame([(1, "ring"), (2, "ring"), (1, "gold"), (3, "gold")], "event_id int, node string")
    some = waves.converge(seeds, g.edges, among=asked).select("event_id", "node", "weight", "sources")
    assert some.count() > 0
    assert sorted(some.collect()) == sorted(whole.join(asked, ["event_id", "node"], "left_semi").collect())
    texts = spark.createDataFrame([(10, 1, "Ring or rings"), (20, 2, "a ring, not Gold"), (30, 2, "none")],
                                  "text_id int, event_id int, text string")
    plain = answers.keyword_scores(texts, whole.withColumnRenamed("node", "label"))
    rows = lambda df: sorted((r.text_id, r.event_id, round(r.weight, 9), r.hits) for r in df.collect())
    got = answers.converged_scores(texts, seeds, g.edges)
    assert rows(got) == rows(plain) and rows(plain)


def test_echo_of_equal_branches_equals_loop(spark):
    """Branches that can be exchanged are expanded once; those with seeds or other strengths stay."""
    rng, rows = random.Random(5), {}
    for i in range(9):     # on h1 and h2 branches of two nodes, on h3 leaves, one each way of another strength
        for hub in ("h1", "h2"):
            rows[("main", hub, f"{hub}_m{i}", "r")] = 0.6 if i == 3 else 1.0
            rows[("main", f"{hub}_m{i}", f"{hub}_x{i}", "r")] = 1.3 if i == 4 else 0.9
        rows[("main", f"leaf{i}", "h3", "r")] = 0.4 if i == 5 else 0.7
    for a, b in (("h1", "top"), ("h2", "top"), ("top", "h3"), ("h3", "h1"), ("h2", "side"), ("side", "h3")):
        rows[("main", a, b, "q")] = rng.choice([0.6, 1.0, 1.7])
    edges = spark.createDataFrame([(*k, v) for k, v in rows.items()],
                                  "region string, src string, dst string, relation string, strength double")
    events = {"a": ["top"], "b": ["h1_x2", "leaf1"], "c": ["h2_m6", "side"]}
    want = {}
    for event, start in events.items():
        used, current, conv = set(start), list(start), {}
        for _ in range(3):
            fresh = []
            for s in current:
                for node, (_, w) in _queue_wave(rows, s, 3, 0.5, True).items():
                    tot, cnt = conv.get(node, (0.0, 0))
                    conv[node] = (tot + w, cnt + 1)
                    if node not in used:
                        used.add(node)
                        fresh.append(node)
            current = fresh
        want.update({(event, n): (round(w, 6), c) for n, (w, c) in conv.items()})
    seeds = spark.createDataFrame([("main", e, x, 0.5) for e, xs in events.items() for x in xs],
                                  "region string, event_id string, label string, min_strength double")
    adj = waves.adjacency(edges, True)
    got = waves.echo(seeds, adj).collect()
    assert {(r.event_id, r.node): (round(r.weight, 6), r.sources) for r in got} == want and len(got) == len(want)
    left, same, many = waves.fold_branches(adj, seeds.select("region", "label"))
    # of 9 branches two of other strengths and one with a seed stay, and two of the equal six
    assert {r.node for r in left.filter("node LIKE 'h1!_m%' ESCAPE '!'").collect()} == {f"h1_m{i}" for i in (0, 2, 3, 4, 8)}
    assert same.count() == 5 * 2 + 5 * 2 + 6 and {r.times for r in many.collect()} == {5, 6}
