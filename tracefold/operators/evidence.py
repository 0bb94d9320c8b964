"""Evidence log and its folds.

Teaching, refuting, templates, associations, date links and clean-up marks are
all rows of one append-only log; nodes, edges, witnesses and paths are folds of
that log.

Fact table (one row per statement)
    region, subject, relation, obj, ptype, kind ('teach'|'refute'),
    source_label, initial_strength, source_text, statement_id, seq (bigint < 1.4e17)

Evidence log (one row per touched edge)
    region, src, dst, relation, src_type, dst_type, kind ('teach'|'refute'|'link'),
    source_label, initial_strength, source_text, statement_id, seq, step
A null source always strengthens, a blank one never does; labels are stored trimmed.

Statements that say one and the same set of facts (all order lines of a part) come as two tables:
statements (topic, kind, source_label, initial_strength, seq) and topics (topic and the fact
columns subject, relation, obj, ptype, source_text, region).  They are counted per topic before
facts, edges and paths are made, so what is moved follows the statements once, and else the topics.
Topics are many times what their file measures (several wide facts for a packed row), so they and their
counters are no side to send whole: their joins are merged by hint.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed, measures
from ..functions.strings import strip
from ..sources.scratch import materialize

EDGE_KEY = ["region", "src", "dst", "relation"]
LOG_COLUMNS = EDGE_KEY + ["src_type", "dst_type", "kind", "source_label", "initial_strength",
                          "source_text", "statement_id", "seq", "step"]


class Said(NamedTuple):
    statements: DataFrame    # topic, kind, source_label, initial_strength, seq
    topics: DataFrame        # topic, region, subject, relation, obj, ptype, source_text


def facts(df: DataFrame, **overrides) -> DataFrame:
    """Complete a (subject, relation, obj, ptype) table to the fact schema."""
    defaults = {
        "region": F.lit("main"), "kind": F.lit("teach"),
        "source_label": F.lit(None).cast("string"),
        "initial_strength": F.lit(None).cast("double"),
        "source_text": F.concat_ws(" ", "subject", "relation", "obj"),
        "statement_id": F.col("seq") if "seq" in df.columns else F.lit(0).cast("bigint"),
    }
    defaults.update(overrides)
    for name, value in defaults.items():
        if name in overrides or name not in df.columns:
            df = df.withColumn(name, value)
    return df.select("region", "subject", "relation", "obj", "ptype", "kind", "source_label",
                     "initial_strength", "source_text",
                     F.col("statement_id").cast("bigint"), F.col("seq").cast("bigint"))


def _event(src, dst, relation, src_type, dst_type, kind, source, initial, step) -> Column:
    def text(v):
        return (v if isinstance(v, Column) else F.lit(v)).cast("string")
    return F.struct(
        text(src).alias("src"), text(dst).alias("dst"), text(relation).alias("relation"),
        text(src_type).alias("src_type"), text(dst_type).alias("dst_type"),
        text(kind).alias("kind"), text(source).alias("source_label"),
        (initial if isinstance(initial, Column) else F.lit(initial)).cast("double")
        .alias("initial_strength"), (step if isinstance(step, Column) else F.lit(step))
        .cast("int").alias("step"))


def _word_links(label: Column, label_type: str, first_step: int) -> Column:
    """word -part_of-> label for every word of a multi-word label."""
    links = F.transform(F.split(label, " "), lambda w, i: _event(
        w, label, "part_of", "property", label_type, "teach", None, None, i + first_step))
    return F.when(F.contains(label, F.lit(" ")), links)


def teach(fact_rows: DataFrame, keep: tuple = ()) -> DataFrame:
    """Turn facts into evidence rows: property -> relation node -> concept.

    ``keep``: more columns of the facts that their rows carry.
    """
    subject, obj, kind = F.col("subject"), F.col("obj"), F.col("kind")
    mid = F.concat(subject, F.lit("_"), F.col("ptype"))
    mark = F.concat(subject, F.lit("_refuted"))
    source, initial = F.col("source_label"), F.col("initial_strength")
    chain = F.array(
        _event(obj, mid, F.col("relation"), "property", "relation", kind, source, initial, 0),
        _event(mid, subject, "describes", "relation", "concept", kind, source, initial, 1))
    marks = F.array(
        _event(subject, mark, "refutation_of", "concept", "relation", "link", None, None, 2),
        _event(mark, "refuted", "refutation_status", "relation", "property", "link",
               None, None, 3))
    events = F.flatten(F.array_compact(F.array(
        chain, F.when(kind == "refute", marks),
        _word_links(subject, "concept", 10), _word_links(obj, "property", 1000))))
    return (fact_rows.withColumn("source_label", strip(F.col("source_label")))
            .select("region", "source_text", "statement_id", "seq", *keep, F.inline(events))
            .select(*LOG_COLUMNS, *keep))


def with_mode(fact_rows: DataFrame, mode: str) -> DataFrame:
    """Set the initial strength (and source) of a teaching mode.

    'confident' keeps the default, 'tentative' starts below the visibility
    floor, 'error' starts above it under one fixed source label.
    """
    if mode == "tentative":
        return fact_rows.withColumn("initial_strength", F.lit(fixed.TENTATIVE))
    if mode == "error":
        return fact_rows.withColumns({"initial_strength": F.lit(fixed.FROM_ERROR),
                                      "source_label": F.lit(fixed.ERROR_SOURCE)})
    return fact_rows


def links(df: DataFrame) -> DataFrame:
    """Plain edges (created once, never strengthened) as evidence rows."""
    for name, typ in (("source_label", "string"), ("initial_strength", "double"),
                      ("source_text", "string"), ("statement_id", "bigint")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(typ))
    if "kind" not in df.columns:
        df = df.withColumn("kind", F.lit("link"))
    if "step" not in df.columns:
        df = df.withColumn("step", F.lit(0))
    return df.select(*LOG_COLUMNS)


def fold_evidence(log: DataFrame) -> DataFrame:
    """Edges from the log.

    traversals counts every teach after the creating event whose source is
    absent or new to the edge.  Two aggregations replace the per-edge replay:
    first per (edge, source), then per edge.  Both combine map-side, and the
    first spreads a hot edge over its sources, so no edge is ever one group of
    raw events.
    """
    return fold_sources(sources_of(log))


def sources_of(log: DataFrame) -> DataFrame:
    """Counters per (edge, source); those of several logs are merged by merge_sources."""
    return _sources(log, EDGE_KEY)


def _sources(log: DataFrame, key: list[str], *more) -> DataFrame:
    teach_flag = (F.col("kind") == "teach").cast("bigint")
    # creation order packed with what the fold must know about that event
    code = (F.col("seq") * 4 + F.when(F.col("kind") == "teach", 0)
            .when(F.col("kind") == "refute", 1).otherwise(2))
    return (
        log.withColumn("source_key", F.col("source_label")).withColumn("code", code)
        .groupBy(*key, "source_key")
        .agg(F.sum(teach_flag).alias("teaches"),
             F.sum((F.col("kind") == "refute").cast("bigint")).alias("refutes"),
             F.min("code").alias("code"),
             F.min_by("initial_strength", "code").alias("initial"),
             F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), *more))


def merge_sources(parts: DataFrame) -> DataFrame:
    """Counters of parts of a log added up to those of the whole."""
    return parts.groupBy(*EDGE_KEY, "source_key").agg(
        F.sum("teaches").alias("teaches"), F.sum("refutes").alias("refutes"),
        F.min_by("initial", "code").alias("initial"), F.min("code").alias("code"),
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))


def fold_sources(per_source: DataFrame) -> DataFrame:
    """Edges from the counters per (edge, source)."""
    return _edges(_added(per_source, EDGE_KEY))


def _added(per_source: DataFrame, key: list[str], *more) -> DataFrame:
    """Counters per source added up to those of the key."""
    valid = F.col("source_key") != ""
    first_is_teach = F.pmod(F.col("code"), F.lit(4)) == 0
    counted = (F.when(F.col("source_key").isNull(), F.col("teaches"))
               .when(valid & first_is_teach, 1).otherwise(0))
    # the creating teach never strengthens: take it back if it was counted
    creation = F.col("code") * 2 + (F.col("source_key") == F.lit("")).cast("int")
    creation = F.coalesce(creation, F.col("code") * 2)
    return (
        per_source.withColumn("counted", counted).withColumn("creation", creation)
        .groupBy(*key)
        .agg(F.sum("counted").alias("counted"), F.sum("refutes").alias("refutations"),
             F.min("creation").alias("creation"),
             F.min_by("initial", "creation").alias("initial"),
             F.sum(F.when(valid, 1).otherwise(0)).cast("bigint").alias("witnesses"),
             F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), *more))


def _edges(added: DataFrame) -> DataFrame:
    created_by_counted = F.pmod(F.col("creation"), F.lit(8)) == 0
    t = F.col("counted") - created_by_counted.cast("bigint")
    r = F.col("refutations")
    initial = F.coalesce(F.col("initial"), F.lit(1.0))
    return added.select(
        *EDGE_KEY, t.alias("traversals"), r.alias("refutations"), "witnesses",
        initial.alias("initial_strength"),
        F.when((t == 0) & (r == 0), initial).otherwise(measures.strength(t, r))
        .alias("strength"), "first_seq", "last_seq")


def topic_sources(said: Said) -> DataFrame:
    """Counters per (topic, source), of refuting statements also their first and last."""
    refuting = F.when(F.col("kind") == "refute", F.col("seq"))
    teaching = F.when(F.col("kind") == "teach", F.col("seq"))
    rows = said.statements.withColumn("source_label", strip(F.col("source_label")))
    return _sources(rows, ["topic"], F.min(teaching).alias("first_teach"),
                    F.min(refuting).alias("first_refute"), F.max(refuting).alias("last_refute"))


def topic_counters(said: Said) -> DataFrame:
    """Counters per topic: those of an edge that all its statements, and no others, touch."""
    return _added(topic_sources(said), ["topic"],
                  F.sum("teaches").alias("teaches"),
                  F.min("first_teach").alias("first_teach"),
                  F.min("first_refute").alias("first_refute"),
                  F.max("last_refute").alias("last_refute"),
                  F.max(F.col("source_key").isNotNull()).alias("sourced"))


_COUNTED = ["counted", "refutations", "creation", "initial", "witnesses", "first_seq", "last_seq"]


def topic_log(said: Said, counters: DataFrame) -> DataFrame:
    """The log with one row per edge that a topic touches: log columns, topic, counters and ``sourced``."""
    refuted = F.col("first_refute").isNotNull()
    facts_of = said.topics.join(counters.hint("merge"), "topic").withColumns({
        "kind": F.when(refuted, "refute").otherwise("teach"), "seq": F.col("first_seq"),
        "source_label": F.lit(None).cast("string"), "initial_strength": F.lit(None).cast("double"),
        "statement_id": F.lit(None).cast("bigint")})
    rows = teach(facts_of, keep=("topic", *_COUNTED, "teaches", "first_refute", "last_refute", "sourced"))
    chain, mark = F.col("step") < 2, F.col("step").isin(2, 3)

    def by_step(of_chain, of_mark, of_word):
        return F.when(chain, of_chain).when(mark, of_mark).otherwise(of_word)
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("double")
    first, last = (by_step(F.col(f"{at}_seq"), F.col(f"{at}_refute"), F.col(f"{at}_seq")) for at in ("first", "last"))
    return rows.withColumns({
        # links to words are taught by every statement, marks by refuting ones
        "counted": by_step(F.col("counted"), zero, F.col("teaches") + F.col("refutations")),
        "refutations": by_step(F.col("refutations"), zero, zero),
        "creation": by_step(F.col("creation"), (F.col("first_refute") * 4 + 2) * 2, F.col("first_seq") * 8),
        "initial": by_step(F.col("initial"), none, none),
        "witnesses": by_step(F.col("witnesses"), zero, zero),
        "sourced": chain & F.col("sourced"),
        "first_seq": first, "last_seq": last, "seq": first}).drop("teaches", "first_refute", "last_refute")


def fold_topics(said: Said, counters: DataFrame) -> DataFrame:
    """Edges of statements on topics; the same as fold_evidence of their log.

    Counters of topics add up wherever no source can stand in two of them: on edges touched
    by one topic only, and on links without sources.  Other edges are folded per source.
    """
    rows = topic_log(said, counters)
    added = rows.groupBy(*EDGE_KEY).agg(
        F.sum("counted").alias("counted"), F.sum("refutations").alias("refutations"),
        F.min_by("initial", "creation").alias("initial"), F.min("creation").alias("creation"),
        F.sum("witnesses").alias("witnesses"), F.min("first_seq").alias("first_seq"),
        F.max("last_seq").alias("last_seq"),
        ((F.count("*") > 1) & F.max("sourced")).alias("mixed"))
    added = materialize(added, "added")
    alone = _edges(added.filter("NOT mixed"))
    mixed = added.filter("mixed").select(*EDGE_KEY)
    if mixed.isEmpty():
        return alone
    met = materialize(rows.join(mixed, EDGE_KEY, "left_semi"), "mixed")
    per_source = met.filter("sourced").select("topic", *EDGE_KEY).join(
        topic_sources(said).drop("first_teach", "first_refute", "last_refute"), "topic").drop("topic")
    # what has no source is one counter of the null source
    plain = met.filter("NOT sourced").select(
        *EDGE_KEY, F.lit(None).cast("string").alias("source_key"), F.col("counted").alias("teaches"),
        F.col("refutations").alias("refutes"), F.floor(F.col("creation") / 2).cast("bigint").alias("code"),
        "initial", "first_seq", "last_seq")
    return alone.unionByName(fold_sources(merge_sources(per_source.unionByName(plain))))


def counted_facts(said: Said, counters: DataFrame) -> DataFrame:
    """Facts with the number of statements that say so, one row per fact and kind, at the first of them."""
    kinds = F.array(
        F.struct(F.lit("teach").alias("kind"), F.col("teaches").alias("times"), F.col("first_teach").alias("seq")),
        F.struct(F.lit("refute").alias("kind"), F.col("refutations").alias("times"), F.col("first_refute").alias("seq")))
    spoken = counters.select("topic", F.inline(kinds)).filter("times > 0")
    return said.topics.join(spoken.hint("merge"), "topic").withColumn("statement_id", F.col("seq")).drop("topic")


#: Nodes that one statement may name.
PLACES = 1_000_000


def fold_nodes(log: DataFrame) -> DataFrame:
    """One row per label; the type it was first created with wins."""
    ends = log.select(
        "region", F.inline(F.array(
            F.struct(F.col("src").alias("label"), F.col("src_type").alias("node_type"),
                     F.col("seq"), (F.col("step") * 2).alias("ord")),
            F.struct(F.col("dst").alias("label"), F.col("dst_type").alias("node_type"),
                     F.col("seq"), (F.col("step") * 2 + 1).alias("ord")))))
    types = ["concept", "property", "relation", "association"]
    rank = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("node_type"))
    # seq, place inside the statement and type in one minimum: 128 bits, which the hash aggregate
    # still updates in place, hold any seq and up to PLACES places
    whole = lambda c: c.cast("decimal(20,0)")
    order = (whole(F.col("seq")) * F.lit(5 * PLACES).cast("decimal(10,0)")
             + whole(F.col("ord").cast("long") * 5 + rank)).cast("decimal(38,0)")
    node_type = F.element_at(F.array(*[F.lit(t) for t in types]), F.pmod(F.col("o"), F.lit(5).cast("decimal(38,0)")).cast("int"))
    return (ends.groupBy("region", "label").agg(F.min(order).alias("o"))
            .select("region", "label", node_type.alias("node_type")))


def witnesses(log: DataFrame) -> DataFrame:
    """Distinct sources per edge with the time each was first seen."""
    return (log.withColumn("source", F.col("source_label")).filter("source <> ''")
            .groupBy(*EDGE_KEY, "source").agg(F.min("seq").alias("first_seq")))


def topic_witnesses(said: Said, asked: DataFrame) -> DataFrame:
    """Witnesses of the asked edges (EDGE_KEY) only, of statements on topics.

    Statements are taken together per (topic, source) before they meet the edges of their topics.
    """
    rows = said.topics.withColumns({
        "kind": F.lit("teach"), "source_label": F.lit(None).cast("string"),
        "initial_strength": F.lit(None).cast("double"), "statement_id": F.lit(None).cast("bigint"),
        "seq": F.lit(None).cast("bigint")})
    # only steps of the chain carry a source
    edges = teach(rows, keep=("topic",)).filter("step < 2").select("topic", *EDGE_KEY)
    edges = edges.join(asked.select(*EDGE_KEY).distinct().hint("merge"), EDGE_KEY, "left_semi")
    spoken = (said.statements.select("topic", strip(F.col("source_label")).alias("source"), "seq")
              .filter("source <> ''").groupBy("topic", "source").agg(F.min("seq").alias("first_seq")))
    return (edges.join(spoken.hint("merge"), "topic").groupBy(*EDGE_KEY, "source")
            .agg(F.min("first_seq").alias("first_seq")))


def chain_id(*parts):
    """Id of a chain of steps: a digest of its labels, each with its length; 16 bytes, as every step carries it."""
    return F.unhex(F.md5(F.concat_ws("|", *[F.concat_ws(":", F.length(p), p) for p in parts])))


def chains_of(paths: DataFrame) -> DataFrame:
    """Dictionary of chains: (chain, region, src, dst, relation), a row per distinct step of each."""
    return paths.select("chain", "region", F.inline("steps")).distinct()


def paths_of(fact_rows: DataFrame) -> DataFrame:
    """One recorded path per statement, plus the marker path of a refutation.

    Statements that say the same share a chain of steps, named by its id.  Of counted facts
    a path carries the number of its statements (times).
    """
    mid = F.concat_ws("_", "subject", "ptype")
    mark = F.concat(F.col("subject"), F.lit("_refuted"))

    def step(src, dst, relation):
        return F.struct(src.alias("src"), dst.alias("dst"), relation.alias("relation"))
    main = F.struct(
        F.lit(0).alias("part"), F.col("obj").alias("origin"), F.col("subject").alias("terminus"),
        F.array(step(F.col("obj"), mid, F.col("relation")),
                step(mid, F.col("subject"), F.lit("describes"))).alias("steps"),
        chain_id(F.col("region"), F.col("obj"), F.col("relation"), mid, F.col("subject")).alias("chain"))
    marker = F.struct(
        F.lit(1).alias("part"), F.col("subject").alias("origin"),
        F.lit("refuted").alias("terminus"),
        F.array(step(F.col("subject"), mark, F.lit("refutation_of")),
                step(mark, F.lit("refuted"), F.lit("refutation_status"))).alias("steps"),
        chain_id(F.col("region"), F.col("subject"), F.lit("refuted")).alias("chain"))
    both = F.when(F.col("kind") == "refute", F.array(main, marker)).otherwise(F.array(main))
    times = ["times"] if "times" in fact_rows.columns else []
    return fact_rows.select("region", "statement_id", "seq", "source_text", *times, F.inline(both))


def times(paths: DataFrame) -> Column:
    """Statements that a row of recorded paths stands for."""
    return F.col("times") if "times" in paths.columns else F.lit(1).cast("bigint")


def running_strength(log: DataFrame, rows_per_range: int = 100_000) -> DataFrame:
    """Audit view: counters and strength of an edge after each of its events.

    Running totals are cut into ranges of seq that hold about ``rows_per_range``
    rows, 64 ranges at least: totals inside a range
    come from a window over (edge, range), what went before from the per-range
    totals.  One edge holding a large share of the log is thus many groups.
    """
    log = materialize(log.select(*EDGE_KEY, "kind", "source_label", "initial_strength", "seq", "step"),
                      "audit-log")
    span = log.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count("*").alias("n")).first()
    buckets = max(64, span.n // rows_per_range)
    width = max(1, ((span.hi or 0) - (span.lo or 0)) // buckets + 1)
    rows = log.withColumn("b", F.floor((F.col("seq") - F.lit(span.lo or 0)) / F.lit(width)))
    order = [F.col("seq"), F.col("step"), F.col("kind")]
    cell = EDGE_KEY + ["b"]
    rows = rows.withColumns({
        "in_cell": F.row_number().over(W.partitionBy(*cell).orderBy(*order)),
        "in_source": F.row_number().over(W.partitionBy(*cell, "source_label").orderBy(*order))})

    def before(name):
        return F.coalesce(F.sum(name).over(W.partitionBy(*EDGE_KEY).orderBy("b").rowsBetween(
            W.unboundedPreceding, -1)), F.lit(0))
    cells = rows.groupBy(*cell).agg(F.count("*").alias("n")).select(
        *cell, before("n").alias("events_before"))
    sources = (rows.filter("source_label <> ''").groupBy(*EDGE_KEY, "source_label")
               .agg(F.min("b").alias("source_b")))
    rows = rows.join(cells, cell).join(sources, EDGE_KEY + ["source_label"], "left") \
        .withColumn("nth", F.col("events_before") + F.col("in_cell"))
    new_source = (F.col("source_b") == F.col("b")) & (F.col("in_source") == 1)
    up = (F.col("kind") == "teach") & (F.col("nth") > 1) \
        & (F.col("source_label").isNull() | F.coalesce(new_source, F.lit(False)))
    rows = rows.withColumns({"up": up.cast("bigint"),
                             "down": (F.col("kind") == "refute").cast("bigint")})
    totals = rows.groupBy(*cell).agg(F.sum("up").alias("u"), F.sum("down").alias("d")).select(
        *cell, before("u").alias("up_before"), before("d").alias("down_before"))
    starts = rows.filter("nth = 1").select(
        *EDGE_KEY, F.coalesce("initial_strength", F.lit(1.0)).alias("start"))
    so_far = W.partitionBy(*cell).orderBy("in_cell").rowsBetween(
        W.unboundedPreceding, W.currentRow)
    t = F.col("up_before") + F.sum("up").over(so_far)
    r = F.col("down_before") + F.sum("down").over(so_far)
    return (rows.join(totals, cell).join(starts, EDGE_KEY)
            .withColumns({"traversals": t, "refutations": r})
            .withColumn("strength",
                        F.when((F.col("traversals") == 0) & (F.col("refutations") == 0),
                               F.col("start"))
                        .otherwise(measures.strength(F.col("traversals"),
                                                     F.col("refutations"))))
            .select(*EDGE_KEY, "seq", "step", "nth", "kind", "source_label", "traversals",
                    "refutations", "strength"))


def refuted_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that carry a refutation marker."""
    return (edges.filter(F.col("relation") == "refutation_of")
            .select("region", F.col("src").alias("label")).distinct())


def store_templates(df: DataFrame) -> DataFrame:
    """(region, topic, content, seq) -> evidence rows topic -> {topic}_template -> template."""
    topic = F.lower(strip(F.col("topic")))
    mid = F.concat(topic, F.lit("_template"))
    pair = F.array(
        _event(topic, mid, "has_template", "concept", "relation", "link", None, None, 0),
        _event(mid, "template", "template_type", "relation", "property", "link", None, None, 1))
    return (df.select("region", F.col("content").alias("source_text"),
                      F.col("seq").alias("statement_id"), "seq", F.inline(pair))
            .select(*LOG_COLUMNS))


def get_templates(topics: DataFrame, log: DataFrame) -> DataFrame:
    """Stored template texts per (region, topic)."""
    stored = (log.filter(F.col("relation") == "has_template")
              .select("region", F.col("src").alias("topic"),
                      F.col("source_text").alias("content"), "seq"))
    return topics.select("region", "topic").distinct().join(stored, ["region", "topic"])
