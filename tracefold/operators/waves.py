"""Bounded graph traversals, many seeds and many input groups per job.

A seed row is (region, seed, min_strength).  Waves do not depend on who asked
for them: every distinct seed is expanded once and its result joined back to
all groups, events or rounds that use it.
"""


from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.fixed import ECHO_LEVELS, MIN_STRENGTH
from ..sources.scratch import materialize, sent
from .resolve import resolved_labels

SEED = ["region", "seed", "min_strength"]
FAR = 1e9


def adjacency(edges: DataFrame, bidirectional: bool = False) -> DataFrame:
    """(region, node, next, fwd, bwd): strongest edge each way per node pair.

    ``fwd`` is the strongest edge node->next of any relation, ``bwd`` the
    strongest next->node (only kept for bidirectional waves).
    """
    fwd = edges.select("region", F.col("src").alias("node"), F.col("dst").alias("next"),
                       F.col("strength").alias("fwd"),
                       F.lit(None).cast("double").alias("bwd"))
    pairs = fwd
    if bidirectional:
        pairs = fwd.unionByName(edges.select(
            "region", F.col("dst").alias("node"), F.col("src").alias("next"),
            F.lit(None).cast("double").alias("fwd"), F.col("strength").alias("bwd")))
    return (pairs.filter("node <> next").groupBy("region", "node", "next")
            .agg(F.max("fwd").alias("fwd"), F.max("bwd").alias("bwd")))


def stored_adjacency(edges: DataFrame, bidirectional: bool = False) -> DataFrame:
    """Adjacency written once, so that the levels of a wave do not each fold the edges."""
    return materialize(adjacency(edges, bidirectional), "adjacency")


def propagate(seeds: DataFrame, adj: DataFrame, depth: int = 3) -> DataFrame:
    """Breadth-first wave of every seed over edges >= its min_strength.

    Returns (region, seed, min_strength, node, hops, path, weight): each node
    once per seed, by the path that discovers it first.  Discovery order is the
    order of the parent, outgoing before incoming edges, stronger edges first,
    then label.  The order key grows by one struct per hop, so no seed is ever
    ranked in a single task.  ``weight`` is the mean strength of the forward
    edges along the path.
    """
    empty_key = F.array().cast("array<struct<dir:int,rank:double,label:string>>")
    front = seeds.select(*SEED).distinct().select(
        *SEED, F.col("seed").alias("node"), F.lit(0).alias("hops"), empty_key.alias("key"),
        F.lit(0.0).alias("wsum"), F.lit(0).alias("wcnt"))
    seen = front.select(*SEED, "node")
    levels = []
    for hop in range(1, depth + 1):
        # levels written before are measured by their rows
        known = seen if hop == 1 else sent(seen)
        step = (
            (front if hop == 1 else sent(front)).join(adj, ["region", "node"])
            .withColumn("dir", F.when(F.col("fwd") >= F.col("min_strength"), 0)
                        .when(F.col("bwd") >= F.col("min_strength"), 1))
            .filter(F.col("dir").isNotNull())
            .select(*SEED, F.col("next").alias("node"),
                    F.concat("key", F.array(F.struct(
                        F.col("dir"),
                        F.round(-F.when(F.col("dir") == 0, F.col("fwd"))
                                .otherwise(F.col("bwd")), 9).alias("rank"),
                        F.col("next").alias("label")))).alias("key"),
                    (F.col("wsum") + F.coalesce("fwd", F.lit(0.0))).alias("wsum"),
                    (F.col("wcnt") + F.col("fwd").isNotNull().cast("int")).alias("wcnt")))
        best = (step.groupBy(*SEED, "node")
                .agg(F.min(F.struct("key", "wsum", "wcnt")).alias("b"))
                .join(known, SEED + ["node"], "left_anti")
                .select(*SEED, "node", F.lit(hop).alias("hops"), "b.key", "b.wsum", "b.wcnt"))
        if hop < depth:
            best = materialize(best, f"wave{hop}")
        levels.append(best)
        front = best
        seen = seen.unionByName(best.select(*SEED, "node"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select(
        *SEED, "node", "hops",
        F.concat(F.array("seed"), F.transform("key", lambda k: k["label"])).alias("path"),
        F.when(F.col("wcnt") > 0, F.col("wsum") / F.col("wcnt")).otherwise(0.0).alias("weight"))


def _seeds(inputs: DataFrame, min_strength: float) -> DataFrame:
    return inputs.select("region", F.col("label").alias("seed"),
                         F.lit(float(min_strength)).alias("min_strength")).distinct()


def _by_node(waves: DataFrame) -> DataFrame:
    """Waves dealt out by node: what joins them by a broadcast is then added up per node where it is."""
    return waves.select("region", "seed", "node", "weight").repartition("region", "node")


def recognize(inputs: DataFrame, edges: DataFrame, depth: int = 3,
              min_strength: float = MIN_STRENGTH, min_seeds: int = 1, index=None) -> DataFrame:
    """Rank what the seeds of each group reach.

    ``inputs`` is (region, group_id, label); repeated labels count once.  With ``index``, a
    LabelIndex or nodes, labels are free terms that are resolved first; without it
    they are stored labels.  Returns (region, group_id, node, confidence,
    signed_confidence); all reached nodes are kept unless ``min_seeds`` asks
    for intersections only.
    """
    if index is not None:
        inputs = materialize(resolved_labels(inputs, index), "resolved-inputs")
    waves = propagate(_seeds(inputs, min_strength), stored_adjacency(edges), depth)
    asked = materialize(inputs.select("region", "group_id", F.col("label").alias("seed")).distinct(), "asked")
    return (asked.join(_by_node(waves), ["region", "seed"])
            .groupBy("region", "group_id", "node")
            .agg(F.count("*").alias("confidence"), F.sum("weight").alias("signed_confidence"))
            .filter(F.col("confidence") >= min_seeds))


def top_per_group(df: DataFrame, group: list[str], order: list, k: int = None) -> DataFrame:
    """Rows of each group numbered in order: the best ``k`` (Spark prunes per task before the
    shuffle), or all for None."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def trace(labels: DataFrame, edges: DataFrame, depth: int = 3,
          min_strength: float = MIN_STRENGTH, index=None) -> DataFrame:
    """All outgoing paths of each label with their weights; with ``index``, labels are resolved first."""
    if index is not None:
        labels = materialize(resolved_labels(labels, index), "resolved-labels")
    return propagate(_seeds(labels, min_strength), stored_adjacency(edges), depth) \
        .select("region", F.col("seed").alias("label"), "node", "hops", "path", "weight")


def converge(seeds: DataFrame, edges: DataFrame, depth: int = 3,
             min_strength: float = MIN_STRENGTH, among: DataFrame = None) -> DataFrame:
    """Working memory of each event: weight and source count per reached node.

    ``seeds`` is (region, event_id, label); a label given n times weighs n
    times but is one source.  ``among`` (event_id, node) asks for these rows only: an event
    then meets the waves of its seeds at its own nodes, not at all that they reach.
    """
    times = (seeds.groupBy("region", "event_id", F.col("label").alias("seed"))
             .agg(F.count("*").alias("times")))
    waves = propagate(_seeds(seeds, min_strength), stored_adjacency(edges), depth)
    if among is None:
        # written first, so that its measured size decides whether it is sent to the waves
        met = materialize(times, "asked").join(_by_node(waves), ["region", "seed"])
    else:
        met = (times.join(among.select("event_id", "node").distinct(), "event_id")
               .join(waves.select("region", "seed", "node", "weight").hint("merge"), ["region", "seed", "node"]))
    return (met
            .groupBy("region", "event_id", "node")
            .agg(F.sum(F.col("weight") * F.col("times")).alias("weight"),
                 F.count("*").alias("sources")))


def intersections(convergence: DataFrame, min_sources: int = 2) -> DataFrame:
    return convergence.filter(F.col("sources") >= min_sources)


def align_score(convergence: DataFrame, candidates: DataFrame) -> DataFrame:
    """Summed weight and hit count of candidate nodes (event_id, candidate, node)."""
    return (candidates.distinct()
            .join(convergence.select("event_id", "node", "weight"), ["event_id", "node"], "left")
            .groupBy("event_id", "candidate")
            .agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("score"),
                 F.count("weight").alias("hits")))


def fold_branches(adj: DataFrame, kept: DataFrame):
    """A bidirectional adjacency with one branch of many equal ones left, and one to meet it.

    A branch is a node with one neighbour, or a node between one such node and its anchor.
    Branches on one anchor with equal strengths can be exchanged without any change to the graph,
    so waves from one of them, and to one of them, are those of all: of three or more the first
    and the last stay.  Branches with a node of ``kept`` (region, label) stay as well.

    Returns (adjacency, (region, node, first): nodes that fare as that of the first branch,
    (region, seed, times): nodes of last branches and how many but the first they stand for).
    """
    degree = adj.groupBy("region", F.col("node").alias("next")).agg(F.count("*").alias("near"))
    end = F.col("near") == 1

    def one(which):
        return F.max(F.when(which, F.struct(F.col("next").alias("node"), "fwd", "bwd")))
    around = adj.join(degree, ["region", "next"]).groupBy("region", F.col("node").alias("root")).agg(
        F.count("*").alias("near"), F.count_if(end).alias("ends"), one(~end).alias("up"), one(end).alias("down"))
    known = kept.select("region", F.col("label").alias("root"))
    text = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("up.fwd", "up.bwd", "down.fwd", "down.bwd")]
    branches = (around.filter("near - ends = 1 AND near <= 2")
                .select("region", F.col("up.node").alias("anchor"), F.concat_ws("|", *text).alias("like"), "root",
                        F.col("down.node").alias("leaf"))
                .join(known, ["region", "root"], "left_anti")
                .join(known.withColumnRenamed("root", "leaf"), ["region", "leaf"], "left_anti"))
    branches = materialize(branches, "branches")
    ends = F.struct("root", "leaf")
    equal = (branches.groupBy("region", "anchor", "like")
             .agg(F.count("*").alias("n"), F.min(ends).alias("first"), F.max(ends).alias("last")).filter("n > 2"))
    met = branches.join(equal, ["region", "anchor", "like"]).filter(F.col("root") != F.col("first.root")).select(
        "region", (F.col("root") == F.col("last.root")).alias("last"), (F.col("n") - 1).alias("times"), F.inline(F.array(
            F.struct(F.col("root").alias("node"), F.col("first.root").alias("first")),
            F.struct(F.col("leaf").alias("node"), F.col("first.leaf").alias("first")))))
    met = materialize(met.filter("node IS NOT NULL"), "branches-met")
    gone = met.filter("NOT last").select("region", "node")
    left = adj.join(gone, ["region", "node"], "left_anti").join(
        gone.withColumnRenamed("node", "next"), ["region", "next"], "left_anti")
    return (materialize(left.select(*adj.columns), "adjacency-left"), met.select("region", "node", "first"),
            met.filter("last").select("region", F.col("node").alias("seed"), "times"))


def echo(seeds: DataFrame, adj: DataFrame, max_rounds: int = 3, depth: int = 3) -> DataFrame:
    """Spreading activation: nodes reached in one round are the seeds of the next.

    ``seeds`` is (region, event_id, label, min_strength) and ``adj`` a
    bidirectional adjacency.  Returns (region, event_id, min_strength, node,
    weight, sources).  A node is expanded once for all events that reach it, and of
    equal branches (all suppliers of a nation) one is expanded for all.
    """
    event = ["region", "event_id", "min_strength"]
    adj, same, many = fold_branches(adj, seeds.select("region", "label").distinct())
    known = adj.select("region", F.col("node").alias("seed")).distinct()
    current = (seeds.select(*event, F.col("label").alias("seed")).distinct()
               .join(known, ["region", "seed"], "left_semi"))
    current = materialize(current, "echo-seeds")
    used, expanded, hits = current, None, []
    for round_no in range(max_rounds):
        need = current.select(*SEED).distinct()
        if expanded is not None:
            need = need.join(expanded.select(*SEED).distinct(), SEED, "left_anti")
        waves = materialize(propagate(need, adj, depth).select(*SEED, "node", "weight"),
                            "echo-wave")
        expanded = waves if expanded is None else expanded.unionByName(waves)
        hit = current.join(expanded, SEED)
        hits.append(hit.select(*event, "seed", "node", "weight"))
        if round_no == max_rounds - 1:
            break
        fresh = (hit.select(*event, F.col("node").alias("seed")).distinct()
                 .join(used, event + ["seed"], "left_anti"))
        fresh = materialize(fresh.select(*event, "seed"), "echo-round")
        if fresh.isEmpty():
            break
        used = used.select(*event, "seed").unionByName(fresh)
        current = fresh
    out = hits[0]
    for hit in hits[1:]:
        out = out.unionByName(hit)
    times = F.coalesce("times", F.lit(1))
    out = (out.join(many, ["region", "seed"], "left").groupBy(*event, "node")
           .agg(F.sum(F.col("weight") * times).alias("weight"), F.sum(times).cast("bigint").alias("sources")))
    out = materialize(out.join(same, ["region", "node"], "left_anti").select(*event, "node", "weight", "sources"), "echo")
    return out.unionByName(out.withColumnRenamed("node", "first").join(same, ["region", "first"]).drop("first"))


def multi_echo(seeds: DataFrame, edges: DataFrame, levels=ECHO_LEVELS, max_rounds: int = 2,
               layers: dict | None = None, min_label: int = 3) -> DataFrame:
    """Echo at several inhibition levels, blended; optionally over weighted layers.

    ``seeds`` is (event_id, label) when ``layers`` maps region -> weight, else
    (region, event_id, label).  All levels and layers run as one echo because
    the level is part of the seed and the layer is the region.  Returns
    (event_id, node, activation).
    """
    spark = edges.sparkSession
    level_rows = F.array(*[F.struct(F.lit(s).alias("min_strength")) for s, _ in levels])
    if layers is not None:
        edges = edges.filter(F.col("region").isin(list(layers)))
        seeds = seeds.select("event_id", "label", F.explode(
            F.array(*[F.lit(r) for r in layers])).alias("region"))
    adj = stored_adjacency(edges, bidirectional=True)
    each = echo(seeds.select("region", "event_id", "label", F.inline(level_rows)), adj,
                max_rounds)
    level_weight = F.lit(0.0)
    for s, mult in levels:
        level_weight = F.when(F.col("min_strength") == s, mult).otherwise(level_weight)
    layer_weight = F.lit(1.0)
    for region, mult in (layers or {}).items():
        layer_weight = F.when(F.col("region") == region, float(mult)).otherwise(layer_weight)
    return (each.filter(F.length("node") >= min_label)
            .groupBy("event_id", F.lower("node").alias("node"))
            .agg(F.sum(F.col("weight") * level_weight * layer_weight).alias("activation")))


def equal_nodes(seeds: DataFrame, adj: DataFrame, depth: int = 10):
    """Nodes that the same seeds reach by the same numbers of steps, merged before any seed is expanded.

    A seed is a kind of its own.  Another node's kind is the multiset of the kinds of its
    in-neighbours (their number and three sums of 64-bit hashes, as a digest), so nodes of one kind
    have equal walks from every seed.  Nodes take their kind once those of all their in-neighbours are
    known; what is not known after ``depth`` rounds (cycles, nodes no seed leads to) stays by itself.

    ``seeds`` is (region, label) and ``adj`` (region, node, next).  Returns
    (adjacency of kinds, (region, node, kind) of all nodes that a seed may lead to).
    """
    def own(label):
        return F.unhex(F.md5(F.concat(F.lit("="), label)))
    named = materialize(seeds.select("region", F.col("label").alias("node")).distinct()
                        .withColumn("kind", own(F.col("node"))), "kinds")
    inner = named.select("region", F.col("node").alias("next"), F.col("kind").alias("into"))
    todo = adj.join(sent(inner.drop("into")), ["region", "next"], "left_anti")
    members, fresh, links = named, named, []
    for hop in range(1, depth + 1):
        met = todo.join(sent(members if hop == 1 else fresh), ["region", "node"], "left")
        if hop > 1:
            met = met.withColumn("kind", F.coalesce("kind", "known")).drop("known")
        hashed = [F.sum(F.shiftright(F.xxhash64(F.lit(i), "kind"), 20)).alias(f"h{i}") for i in (1, 2, 3)]
        into = met.groupBy("region", "next").agg(F.count("*").alias("near"), F.count("kind").alias("known"), *hashed)
        done = into.filter("near = known").select(
            "region", F.col("next").alias("node"),
            F.unhex(F.md5(F.concat_ws("|", "near", "h1", "h2", "h3"))).alias("kind"))
        done = materialize(done, f"kinds{hop}")
        if done.isEmpty():
            break
        # what leads to a kind is what leads to one of its nodes
        one = done.groupBy("region", F.col("kind").alias("into")).agg(F.min("node").alias("next"))
        links.append(met.join(one, ["region", "next"]).select("region", "kind", "into").distinct())
        ended = sent(done.select("region", F.col("node").alias("next")))
        todo = materialize(met.join(ended, ["region", "next"], "left_anti")
                           .select("region", "node", "next", F.col("kind").alias("known")), f"unknown{hop}")
        members, fresh = members.unionByName(done), done
        if todo.isEmpty():
            break
    if not todo.isEmpty():
        alone = todo.select("region", F.explode(F.array("node", "next")).alias("node")).distinct() \
            .join(members, ["region", "node"], "left_anti")
        members = members.unionByName(materialize(alone.withColumn("kind", own(F.col("node"))), "alone"))
    ends = members.select("region", F.col("node").alias("next"), F.col("kind").alias("into"))
    rest = todo.select("region", "node", "next").join(members, ["region", "node"]).join(ends, ["region", "next"])
    to_seeds = adj.join(sent(inner), ["region", "next"]).join(members, ["region", "node"])
    out = rest.select("region", "kind", "into").unionByName(to_seeds.select("region", "kind", "into"))
    for link in links:
        out = out.unionByName(link)
    out = out.distinct().select("region", F.col("kind").alias("node"), F.col("into").alias("next"))
    return materialize(out, "kind-steps"), members


def reach_kinds(seeds: DataFrame, edges: DataFrame, depth: int = 10):
    """What each seed reaches within ``depth`` edges of any strength, by kinds of equal nodes.

    Returns ((region, seed, kind, hops), (region, node, kind)); see equal_nodes.
    """
    adj = materialize(edges.select("region", F.col("src").alias("node"), F.col("dst").alias("next"))
                      .filter("node <> next"), "steps")
    seeds = seeds.select("region", "label").distinct()
    adj, members = equal_nodes(seeds, adj, depth)
    key = ["region", "seed", "node"]
    front = seeds.withColumnRenamed("label", "seed").join(
        members.select("region", F.col("node").alias("seed"), F.col("kind").alias("node")), ["region", "seed"])
    front = materialize(front.select(*key), "reach0")
    seen, out = front, None
    for hop in range(1, depth + 1):
        front = materialize(
            front.join(adj, ["region", "node"])
            .select("region", "seed", F.col("next").alias("node")).distinct()
            .join(seen, key, "left_anti").select(*key), f"reach{hop}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        level = front.withColumn("hops", F.lit(hop))
        out = level if out is None else out.unionByName(level)
    out = out if out is not None else front.withColumn("hops", F.lit(1))
    return out.withColumnRenamed("node", "kind"), members


def reach(seeds: DataFrame, edges: DataFrame, depth: int = 10) -> DataFrame:
    """(region, seed, node, hops) reachable within ``depth`` edges of any strength."""
    reached, members = reach_kinds(seeds, edges, depth)
    return reached.join(members, ["region", "kind"]).select("region", "seed", "node", "hops")


def reach_intersections(reached: DataFrame, members: DataFrame = None) -> DataFrame:
    """Nodes reached from at least two starts; with ``members``, ``reached`` is that of reach_kinds."""
    node = "node" if members is None else "kind"
    met = reached.groupBy("region", node).agg(F.count("*").alias("starts")).filter("starts >= 2")
    return met if members is None else met.join(members, ["region", "kind"]).select("region", "node", "starts")


def walks(seeds: DataFrame, edges: DataFrame, depth: int = 10) -> DataFrame:
    """Every simple path of at most ``depth`` edges, with its arrow text."""
    adj = edges.select("region", F.col("src").alias("node"), F.col("dst").alias("next")) \
        .distinct()
    adj = materialize(adj, "steps")
    front = seeds.select("region", F.col("label").alias("seed"), F.col("label").alias("node"),
                         F.array("label").alias("path")).distinct()
    out = None
    for hop in range(1, depth + 1):
        front = materialize(
            front.join(adj, ["region", "node"])
            .filter(~F.array_contains("path", F.col("next")))
            .select("region", "seed", F.col("next").alias("node"),
                    F.array_append("path", F.col("next")).alias("path")), f"walk{hop}")
        if front.isEmpty():
            break
        level = front.select("region", "seed", "node", F.lit(hop).alias("depth"),
                             F.array_join("path", " → ").alias("path_text"))
        out = level if out is None else out.unionByName(level)
    return out if out is not None else front.select(
        "region", "seed", "node", F.lit(1).alias("depth"),
        F.array_join("path", " → ").alias("path_text"))


def cluster(labels: DataFrame, edges: DataFrame, depth: int = 2, k: int = None) -> DataFrame:
    """Neighbourhood of each label ranked by the number of connecting edges, best ``k`` or all.

    Returns (region, start, node, hops, connections, direction, rank).
    """
    both = edges.select("region", F.col("src").alias("node"), F.col("dst").alias("next"),
                        F.lit(1).alias("in"), F.lit(0).alias("out")).unionByName(
        edges.select("region", F.col("dst").alias("node"), F.col("src").alias("next"),
                     F.lit(0).alias("in"), F.lit(1).alias("out")))
    adj = both.groupBy("region", "node", "next").agg(F.sum("in").alias("in"),
                                                     F.sum("out").alias("out"))
    adj = materialize(adj, "steps")
    key = ["region", "start", "node"]
    front = labels.select("region", F.col("label").alias("start"),
                          F.col("label").alias("node")).distinct()
    hops = front.withColumn("hops", F.lit(0))
    for hop in range(1, depth):
        front = materialize(
            front.join(adj.select("region", "node", "next"), ["region", "node"])
            .select("region", "start", F.col("next").alias("node")).distinct()
            .join(hops, key, "left_anti").select(*key), f"ring{hop}")
        hops = hops.unionByName(front.withColumn("hops", F.lit(hop)))
    # every edge end met from an expanded node counts once; a node not expanded
    # itself is at the outermost ring
    met = (hops.withColumnRenamed("hops", "at").join(adj, ["region", "node"])
           .groupBy("region", "start", F.col("next").alias("node"))
           .agg(F.sum("in").alias("in"), F.sum("out").alias("out"),
                (F.min("at") + 1).alias("hops"))
           .filter("node <> start"))
    ranked = met.select(
        *key, "hops", (F.col("in") + F.col("out")).alias("connections"),
        F.when((F.col("in") > 0) & (F.col("out") > 0), "both").when(F.col("in") > 0, "incoming")
        .otherwise("outgoing").alias("direction"))
    return top_per_group(ranked, ["region", "start"],
                         [F.desc("connections"), "hops", "node"], k)


def tree(labels: DataFrame, edges: DataFrame, depth: int = 10) -> DataFrame:
    """Outgoing tree rows (region, root, depth, path, node, relation, strength)."""
    best = (edges.groupBy("region", "src", "dst")
            .agg(F.max(F.struct("strength", "relation")).alias("e")))
    rows = propagate(_seeds(labels, -FAR), stored_adjacency(edges), depth)
    parent = F.element_at("path", F.size("path") - 1)
    return (rows.withColumn("src", parent)
            .join(best.withColumnRenamed("dst", "node"), ["region", "src", "node"])
            .select("region", F.col("seed").alias("root"), F.col("hops").alias("depth"), "path",
                    "node", F.col("e.relation").alias("relation"),
                    F.col("e.strength").alias("strength")))


def reinforce(waves: DataFrame, edges: DataFrame, seq: int) -> DataFrame:
    """Evidence rows that strengthen every traversed edge once (all relations)."""
    n = F.size("path")
    pairs = waves.select("region", F.explode(F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.struct(F.element_at("path", i).alias("src"),
                           F.element_at("path", i + 1).alias("dst")))).alias("p")) \
        .select("region", "p.src", "p.dst").distinct()
    none = F.lit(None)
    return (edges.select("region", "src", "dst", "relation")
            .join(pairs, ["region", "src", "dst"], "left_semi")
            .select("region", "src", "dst", "relation", none.cast("string").alias("src_type"),
                    none.cast("string").alias("dst_type"), F.lit("teach").alias("kind"),
                    none.cast("string").alias("source_label"),
                    none.cast("double").alias("initial_strength"),
                    none.cast("string").alias("source_text"),
                    none.cast("bigint").alias("statement_id"),
                    F.lit(seq).cast("bigint").alias("seq"), F.lit(0).alias("step")))
