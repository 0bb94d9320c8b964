"""Queries for sources, dimension tables, synthesis and streams."""

from pyspark.sql import functions as F

from ..functions import contents, fixed, measures
from ..operators import answers, associations, evidence, lookup
from ..sources import files, tables
from ..sources.scratch import scratch_path
from ..streaming import incremental
from .catalog import query
from .graphs import graph
from .sql import with_graph
from .sql_text import strip, with_documents


@query("statement_lines", f"""
SELECT {strip('l')} AS text, CAST(count(*) AS BIGINT) AS times FROM (
  SELECT unnest(string_split(text, chr(10))) AS l FROM documents)
WHERE {strip('l')} <> '' AND NOT starts_with({strip('l')}, '#')
  AND {strip('l')} NOT IN (SELECT text FROM conversations) GROUP BY ALL""")
def statement_lines(spark, sf_dir):
    lines = tables.table(spark, sf_dir, "documents").select(
        F.explode(F.split("text", "\n")).alias("value"))
    done = tables.table(spark, sf_dir, "conversations").select("text")
    return files.statement_lines(lines, done).groupBy("text").agg(F.count("*").alias("times"))


THESAURUS_SQL = """th AS (
  SELECT DISTINCT unnest([{'a': w1, 'b': w2}, {'a': w2, 'b': w1}]) AS e FROM (
    SELECT lower(p_type) AS w1, unnest(string_split(lower(p_name), ' ')) AS w2 FROM part
    UNION ALL SELECT lower(p_type), lower(p_brand) FROM part) WHERE w1 <> w2)"""


def part_thesaurus(spark, sf_dir):
    """Thesaurus lines 'type, word, word, brand' from the part table."""
    lines = tables.table(spark, sf_dir, "part").select(F.concat_ws(
        ",", "p_type", F.replace("p_name", F.lit(" "), F.lit(" , ")), "p_brand").alias("value"))
    return files.thesaurus_edges(lines)


@query("thesaurus_edges", f"WITH {THESAURUS_SQL} SELECT e.a AS src, e.b AS dst, "
       "'synonym_of' AS relation FROM th")
def thesaurus_edges(spark, sf_dir):
    return part_thesaurus(spark, sf_dir)


@query("expand_synonyms", f"""WITH {THESAURUS_SQL},
s AS (SELECT DISTINCT p_partkey AS event_id, unnest(string_split(lower(p_name), ' ')) AS label
      FROM part),
lost AS (SELECT DISTINCT label FROM s WHERE label NOT IN ('small', 'large')),
one AS (SELECT label AS asked, e.b AS label FROM lost JOIN th ON e.a = label),
two AS (SELECT asked, e.b AS label FROM one JOIN th ON e.a = one.label)
SELECT * FROM s UNION
SELECT event_id, x.label FROM s JOIN (SELECT * FROM one UNION SELECT * FROM two) x
  ON x.asked = s.label""")
def expand_synonyms(spark, sf_dir):
    seeds = tables.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("event_id"), F.explode(F.split(F.lower("p_name"), " "))
        .alias("label"))
    known = seeds.filter(F.col("label").isin("small", "large"))
    return answers.expand_synonyms(seeds, known, part_thesaurus(spark, sf_dir))


@query("dot_lines", with_graph("parts", """
SELECT CAST(ord AS BIGINT) AS ord, line FROM (
  SELECT 0 AS ord, 'strict digraph evidence {' AS line UNION ALL SELECT 3, '}'
  UNION ALL SELECT 1, '"' || label || '" [shape=' || CASE node_type WHEN 'concept' THEN 'ellipse'
    WHEN 'property' THEN 'hexagon' ELSE 'note' END || ']' FROM nodes
  UNION ALL SELECT 2, '"' || src || '" -> "' || dst || '" [tooltip="' || relation || '" weight='
    || traversals || ']' FROM edges)"""))
def dot_lines(spark, sf_dir):
    return files.dot_lines(*graph(spark, sf_dir, "parts", "nodes", "edges")).select(
        F.col("ord").cast("bigint"), "line")


@query("merge_new", with_graph("parts", """
SELECT label, node_type FROM nodes WHERE label NOT IN ('economy', 'promo')
UNION ALL SELECT label, 'concept' FROM (VALUES ('economy'), ('promo')) v(label)"""))
def merge_new(spark, sf_dir):
    """Import of the part nodes into a store that already holds two of them."""
    nodes = graph(spark, sf_dir, "parts", "nodes")
    held = nodes.filter(F.col("label").isin("economy", "promo")).withColumn(
        "node_type", F.lit("concept"))
    return files.merge_new(nodes, held, ["region", "label"]).select("label", "node_type")


@query("list_regions", f"""
SELECT region, CAST(count(*) AS BIGINT) AS nodes FROM (
  SELECT * FROM ({with_graph("market", "SELECT region, label FROM nodes")})
  UNION ALL SELECT * FROM ({with_graph("geography", "SELECT region, label FROM nodes")})
  UNION ALL SELECT * FROM ({with_graph("parts", "SELECT region, label FROM nodes")}))
GROUP BY region""")
def list_regions(spark, sf_dir):
    """Regions of a store that holds three graphs."""
    store = scratch_path(spark, "store")
    for name in ("market", "geography", "parts"):
        files.append_log(graph(spark, sf_dir, name, "nodes"), f"{store}/nodes")
    return files.list_regions(files.load_graph(spark, store, ["nodes"])["nodes"])


@query("save_and_load", with_graph("market", """
SELECT region, src, dst, relation, round(strength, 6) AS strength FROM edges"""))
def save_and_load(spark, sf_dir):
    path = scratch_path(spark, "saved")
    files.save_graph({"edges": graph(spark, sf_dir, "market", "edges")}, path)
    return files.load_graph(spark, path, ["edges"])["edges"].select(
        "region", "src", "dst", "relation", F.round("strength", 6).alias("strength"))


@query("shuffle_choices", """
WITH q AS (
  SELECT name || '/' || type AS question_id,
    ['the ' || name, 'some ' || string_split(name, ' ')[-1] || ' of ' || string_split(name, ' ')[1],
     'any ' || type, 'none of these'] AS c
  FROM (SELECT DISTINCT lower(p_name) AS name, lower(p_type) AS type FROM part)),
m AS (SELECT question_id, list_sort(list_transform(range(0, 4), lambda i: {
        'h': md5('42|' || question_id || '|' || i || '|' || c[i + 1]), 'c': c[i + 1], 'r': i = 0})) AS m
      FROM q)
SELECT question_id, array_to_string(list_transform(m, lambda x: x.c), '|') AS choices,
  CAST(list_position(list_transform(m, lambda x: x.r), true) - 1 AS BIGINT) AS answer_idx FROM m"""
)
def shuffle_choices(spark, sf_dir):
    from .quality_queries import part_questions
    return files.shuffle_choices(part_questions(spark, sf_dir)).select(
        "question_id", F.array_join("choices", "|").alias("choices"),
        F.col("answer_idx").cast("bigint"))


def _pick_sql(values, salt):
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[{_draw_sql(len(values), salt)} + 1]"


def _draw_sql(n, salt):
    return f"(CAST('0x' || left(md5('42|{salt}|' || p_partkey), 8) AS BIGINT) % {n})"


@query("synthesize_statements", f"""
SELECT p_partkey AS id, CASE WHEN d < 8 THEN {_pick_sql(fixed.OPENINGS, 2)} || s || ' ' ||
    CASE WHEN d < 6 THEN {_pick_sql(fixed.TEACHING_VERBS, 3)}
    ELSE {_pick_sql(fixed.REFUTING_VERBS, 4)} END || ' ' || o
    ELSE {_pick_sql(fixed.ASKING, 5)} || s END AS input,
  s AS subject, CASE WHEN d < 6 THEN 'is' WHEN d < 8 THEN 'is_not' ELSE '?' END AS verb, o AS obj,
  CASE WHEN d < 6 THEN 'teach' WHEN d < 8 THEN 'refute' ELSE 'question' END AS kind
FROM (SELECT p_partkey, lower(p_name) AS s, lower(p_type) AS o, {_draw_sql(10, 1)} AS d FROM part)""")
def synthesize_statements(spark, sf_dir):
    vocabulary = tables.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.lower("p_name").alias("subject"),
        F.lower("p_type").alias("obj"))
    return files.synthesize_statements(vocabulary)


# --- dimension tables ------------------------------------------------------------

def described(spark, sf_dir):
    """(association, property, seq): brands described by type names."""
    return tables.table(spark, sf_dir, "part").select(
        F.lower("p_type").alias("association"), F.lower("p_brand").alias("property"),
        F.col("p_partkey").alias("seq"))


@query("define_associations", """
SELECT lower(p_type) AS association, arg_max(lower(p_brand), p_partkey) AS question_word
FROM part GROUP BY 1""")
def define_associations(spark, sf_dir):
    return associations.define_associations(tables.table(spark, sf_dir, "part").select(
        F.col("p_type").alias("association"), F.col("p_brand").alias("question_word"),
        F.col("p_partkey").alias("seq")))


@query("describe_associations", """
SELECT lower(p_brand) AS src, lower(p_type) AS dst, 'is_a' AS relation,
       CAST(0 AS BIGINT) AS traversals, 0.1::DOUBLE AS strength
FROM part WHERE lower(p_type) <> 'promo' GROUP BY ALL""")
def describe_associations(spark, sf_dir):
    rows = described(spark, sf_dir)
    known = rows.filter("association <> 'promo'").select("association")
    log, _, _ = associations.describe_associations(rows, known)
    return evidence.fold_evidence(log).select("src", "dst", "relation", "traversals", "strength")


@query("undefined_associations", """
SELECT lower(p_type) AS association, CAST(count(*) AS BIGINT) AS rows FROM part
WHERE lower(p_type) = 'promo' GROUP BY 1""")
def undefined_associations(spark, sf_dir):
    rows = described(spark, sf_dir)
    known = rows.filter("association <> 'promo'").select("association")
    _, _, unknown = associations.describe_associations(rows, known)
    return unknown.groupBy("association").agg(F.count("*").alias("rows"))


@query("query_association", with_graph("parts", """
SELECT DISTINCT 'part#' || p_partkey AS subject, d.association, lower(p_brand) AS property
FROM part JOIN (SELECT DISTINCT lower(p_type) AS association, lower(p_brand) AS property
                FROM part) d ON d.property = lower(p_brand)
WHERE ('part#' || p_partkey, lower(p_brand)) IN (SELECT (terminus, origin) FROM paths)"""))
def query_association(spark, sf_dir):
    rows = described(spark, sf_dir)
    properties = associations.association_properties(spark, rows)
    part = tables.table(spark, sf_dir, "part").select(
        F.concat(F.lit("part#"), F.col("p_partkey")).alias("subject"),
        F.lower("p_brand").alias("property"))
    # every association that describes a property of the part is asked
    asked = (part.join(rows.select("association", "property").distinct(), "property")
             .select(F.lit("parts").alias("region"), "subject", "association").distinct())
    return lookup.query_association(asked, graph(spark, sf_dir, "parts", "said"), properties) \
        .select("subject", "association", "property")


@query("categorize", """
SELECT label, category FROM (
  SELECT w AS label, arg_max(t, k) AS category FROM (
    SELECT unnest(string_split(lower(p_name), ' ')) AS w, lower(p_type) AS t, p_partkey AS k
    FROM part) GROUP BY w)
UNION ALL
SELECT label, category FROM (VALUES """ + ", ".join(
    f"('{w}', '{c}')" for w, c in fixed.CATEGORIES.items())
    + ") v(label, category)")
def categorize(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "part").select(
        F.explode(F.split("p_name", " ")).alias("label"), F.col("p_type").alias("category"),
        F.col("p_partkey").alias("seq"))
    return associations.categorize(rows, spark)


@query("list_associations", """
SELECT association, string_agg(property, ',' ORDER BY property) AS properties FROM (
  SELECT DISTINCT lower(p_type) AS association, lower(p_brand) AS property FROM part)
GROUP BY association""")
def list_associations(spark, sf_dir):
    return associations.list_associations(described(spark, sf_dir)).select(
        "association", F.array_join("properties", ",").alias("properties"))


@query("list_categories", """
SELECT category, string_agg(label, ',' ORDER BY label) AS labels FROM (
  SELECT w AS label, arg_max(t, k) AS category FROM (
    SELECT unnest(string_split(lower(p_name), ' ')) AS w, lower(p_type) AS t, p_partkey AS k
    FROM part) GROUP BY w
  UNION ALL
  SELECT label, category FROM (VALUES """ + ", ".join(
    f"('{w}', '{c}')" for w, c in fixed.CATEGORIES.items())
    + ") v(label, category)) GROUP BY category")
def list_categories(spark, sf_dir):
    return associations.list_categories(categorize(spark, sf_dir)).select(
        "category", F.array_join("labels", ",").alias("labels"))


@query("content_labels", """
SELECT doc_id, 'doc_' || replace(lower(source), ' ', '_') || '_' || left(sha256(text), 6) AS label
FROM documents""")
def content_labels(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select(
        "doc_id", contents.content_label("doc", F.col("source"), F.col("text")).alias("label"))


@query("event_metadata", """
SELECT event_type, 'k' AS name, CAST(count(*) AS BIGINT) AS events,
       CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total,
       '{"k":"' || min(json_extract_string(props, '$.k')) || '"}' AS first_json
FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY event_type""")
def event_metadata(spark, sf_dir):
    """JSON metadata of events read as a map, aggregated, and written back."""
    rows = tables.table(spark, sf_dir, "events").select(
        "event_type", F.explode(measures.metadata_from_json(F.col("props"))).alias("name", "value"))
    return rows.groupBy("event_type", "name").agg(
        F.count("*").alias("events"), F.sum(F.col("value").cast("bigint")).alias("total"),
        F.min("value").alias("least")).select(
        "event_type", "name", "events", "total",
        measures.metadata_json(F.create_map("name", "least")).alias("first_json"))


@query("resolve_question_words", """
WITH d AS (SELECT lower(p_type) AS association, CASE WHEN lower(p_type) = 'promo' THEN 'how'
                ELSE 'which' END AS question_word FROM part GROUP BY ALL),
asked AS (SELECT unnest(['what', 'how', 'which']) AS question_word)
SELECT question_word, association FROM asked JOIN d USING (question_word)
UNION ALL SELECT 'what', unnest(['color', 'shape', 'size'])""")
def resolve_question_words(spark, sf_dir):
    types = tables.table(spark, sf_dir, "part").select(F.lower("p_type").alias("association"))
    defined = types.distinct().withColumn(
        "question_word", F.when(F.col("association") == "promo", "how").otherwise("which"))
    asked = spark.createDataFrame([("what",), ("how",), ("which",)], "question_word string")
    return associations.resolve_question_words(asked, defined)


@query("list_question_words", """
SELECT question_word, association FROM (VALUES ('what', 'color'), ('how', 'taste'),
  ('what', 'shape'), ('how', 'texture'), ('what', 'size'), ('how', 'temperature'))
  v(question_word, association)
UNION SELECT 'which', lower(p_type) FROM part""")
def list_question_words(spark, sf_dir):
    defined = tables.table(spark, sf_dir, "part").select(
        F.lit("which").alias("question_word"), F.lower("p_type").alias("association")).distinct()
    return associations.list_question_words(defined)


@query("templates", """
SELECT lower(p_name) AS topic, p_brand || ' ' || p_type AS content,
       CAST(count(*) AS BIGINT) AS times FROM part GROUP BY ALL""")
def templates(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "part").select(
        F.lit("parts").alias("region"), F.col("p_name").alias("topic"),
        F.concat_ws(" ", "p_brand", "p_type").alias("content"), F.col("p_partkey").alias("seq"))
    log = evidence.store_templates(rows)
    topics = rows.select("region", F.lower("topic").alias("topic"))
    return evidence.get_templates(topics, log).groupBy("topic", "content").agg(
        F.count("*").alias("times"))


# --- streams ---------------------------------------------------------------------

def _run(stream, mode="append", **options):
    """Drive a stream over the files that exist now and return its result table."""
    spark = stream.sparkSession
    out = scratch_path(spark, "stream-out")
    q = (stream.writeStream.outputMode(mode).format("parquet")
         .option("path", out).option("checkpointLocation", scratch_path(spark, "stream-state"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _stream(spark, sf_dir, name):
    """The files of a table as a stream, be the table one file or a folder of them."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # a plain path of a stream has to be a folder; a pattern may be met by either
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query("stream_teach_documents", with_documents("""
SELECT src, dst, relation, kind, CAST(count(*) AS BIGINT) AS events FROM ev GROUP BY ALL"""))
def stream_teach_documents(spark, sf_dir):
    docs = tables.sentences_of(_stream(spark, sf_dir, "documents")).select(
        F.col("sentence").alias("text"), F.col("source").alias("source_label"),
        (F.col("doc_id") * 1_000_000 + F.col("pos")).alias("seq"))
    log = _run(incremental.teach_stream(docs, "documents", negation="ignore"))
    return log.groupBy("src", "dst", "relation", "kind").agg(F.count("*").alias("events"))


@query("stream_fold_orders", with_graph("market", """
SELECT src, dst, relation, traversals, refutations, witnesses, round(strength, 6) AS strength
FROM edges"""))
def stream_fold_orders(spark, sf_dir):
    """Edges kept by the streaming sink, customers joined as a static table."""
    customers = tables.table(spark, sf_dir, "customer")
    rows = tables.market_rows(_stream(spark, sf_dir, "orders"), customers)
    sink = incremental.EvidenceSink(scratch_path(spark, "sink"))
    q = (evidence.teach(rows).writeStream.foreachBatch(sink)
         .option("checkpointLocation", scratch_path(spark, "sink-state"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sink.edges(spark).select("src", "dst", "relation", "traversals", "refutations",
                                    "witnesses", F.round("strength", 6).alias("strength"))


ACTIVITY_SQL = """
SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, event_type AS kind,
       CAST(count(*) AS BIGINT) AS events, round(sum(value), 4) AS value
FROM events GROUP BY ALL"""


@query("activity_windows", ACTIVITY_SQL)
def activity_windows(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events").withColumnRenamed("event_type", "kind")
    return incremental.activity(rows).select(
        "window_start", "kind", "events", F.round("value", 4).alias("value"))


@query("stream_activity_windows", ACTIVITY_SQL)
def stream_activity_windows(spark, sf_dir):
    """All windows, those the watermark hasn't passed yet included.

    Updates are appended by batch; a window's last update is its value.
    """
    rows = _stream(spark, sf_dir, "events").withColumnRenamed("event_type", "kind") \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    updates = scratch_path(spark, "window-updates")
    q = (incremental.activity(rows).writeStream.outputMode("update")
         .foreachBatch(lambda df, batch: df.withColumn("batch", F.lit(batch)).write
                       .mode("overwrite").parquet(f"{updates}/batch={batch}"))
         .option("checkpointLocation", scratch_path(spark, "window-state"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return incremental.last_updates(spark.read.parquet(updates)).select(
        "window_start", "kind", "events", F.round("value", 4).alias("value"))


def _staged(spark, frames, build):
    """Run a stream over files that arrive one frame after the other; what it has appended."""
    source, out, state = (scratch_path(spark, f"staged-{x}") for x in ("in", "out", "state"))
    for frame in frames:
        frame.write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(frame.schema).parquet(source))
        q = (stream.writeStream.outputMode("append").format("parquet").option("path", out)
             .option("checkpointLocation", state).trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _events(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def _one_event(spark, like, days, kind):
    """One row of another kind, ``days`` from the last event."""
    last = like.agg(F.max("ts").alias("ts"))
    return last.select(F.lit(-1).cast("bigint").alias("event_id"),
                       F.expr(f"ts + INTERVAL {days} DAYS").alias("ts"),
                       F.lit(-1).cast(like.schema["user_id"].dataType).alias("user_id"),
                       F.lit(kind).alias("event_type"), F.lit(1.0).alias("value"))


@query("stream_late_events", ACTIVITY_SQL)
def stream_late_events(spark, sf_dir):
    """A row far ahead closes all windows; one older than the watermark then changes none."""
    events = _events(spark, sf_dir)
    frames = [events, _one_event(spark, events, 30, "ahead"), _one_event(spark, events, -1, "late"),
              _one_event(spark, events, 30, "ahead")]
    return _staged(spark, frames, lambda s: incremental.activity(
        s.withColumnRenamed("event_type", "kind"))).select(
        "window_start", "kind", "events", F.round("value", 4).alias("value"))


@query("stream_new_witnesses", """
SELECT DISTINCT CAST(user_id AS VARCHAR) AS src, event_type AS dst,
       's' || (event_id % 7) AS source_label FROM events""")
def stream_new_witnesses(spark, sf_dir):
    """A source that says the same again is no new witness of the edge."""
    rows = _stream(spark, sf_dir, "events").select(
        F.lit("events").alias("region"), F.col("user_id").cast("string").alias("src"),
        F.col("event_type").alias("dst"), F.lit("did").alias("relation"),
        F.concat(F.lit("s"), (F.col("event_id") % 7).cast("string")).alias("source_label"),
        F.col("ts").cast("timestamp").alias("ts"))
    return _run(incremental.new_witnesses(rows, "100000 hours")).select("src", "dst", "source_label")


SESSIONS_SQL = """
WITH n AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts)
             < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id, event_type ORDER BY ts
                             ROWS UNBOUNDED PRECEDING) AS grp FROM n)
SELECT user_id AS conversation, min(ts) AS session_start, event_type AS node,
       round(sum(value), 4) AS weight, CAST(count(DISTINCT event_id % 7) AS BIGINT) AS sources
FROM g GROUP BY user_id, event_type, grp"""


def _memory(rows):
    hits = rows.select(
        F.col("user_id").alias("conversation"), "ts", F.col("event_type").alias("node"),
        (F.col("event_id") % 7).alias("seed"), F.col("value").alias("weight"))
    return incremental.working_memory(hits).select(
        "conversation", "session_start", "node", F.round("weight", 4).alias("weight"),
        F.col("sources").cast("bigint"))


@query("stream_working_memory", SESSIONS_SQL)
def stream_working_memory(spark, sf_dir):
    """Sessions of a stream; a row far ahead closes them all."""
    events = _events(spark, sf_dir)
    return _staged(spark, [events, _one_event(spark, events, 30, "ahead")], _memory)


@query("working_memory_sessions", SESSIONS_SQL)
def working_memory_sessions(spark, sf_dir):
    return _memory(_events(spark, sf_dir))
