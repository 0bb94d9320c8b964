"""File sources and sinks: statements, documents, thesaurus, questions, stored graphs."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import fixed
from ..functions.strings import strip

GRAPH_JSON = T.StructType([
    T.StructField("neurons", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("label", T.StringType()),
        T.StructField("neuron_type", T.StringType())]))),
    T.StructField("segments", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("source_id", T.LongType()),
        T.StructField("target_id", T.LongType()), T.StructField("relation", T.StringType()),
        T.StructField("strength", T.DoubleType()), T.StructField("traversals", T.LongType()),
        T.StructField("refutations", T.LongType())]))),
    T.StructField("paths", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("origin_id", T.LongType()),
        T.StructField("terminus_id", T.LongType()), T.StructField("source_text", T.StringType())]))),
    T.StructField("path_steps", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("path_id", T.LongType()),
        T.StructField("step_order", T.IntegerType()), T.StructField("segment_id", T.LongType())]))),
])
QUESTION_JSON = "id bigint, question string, choices array<string>, answer_idx int"


def statement_lines(lines: DataFrame, done: DataFrame = None) -> DataFrame:
    """(text): stripped lines that are neither blank, comments nor already taught."""
    text = strip(F.col("value"))
    out = lines.select(text.alias("text")).filter((F.col("text") != "")
                                                  & ~F.startswith("text", F.lit("#")))
    if done is not None:
        out = out.join(done.select("text").distinct(), "text", "left_anti")
    return out


def read_statements(spark: SparkSession, path: str, done: DataFrame = None) -> DataFrame:
    return statement_lines(spark.read.text(path), done)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(source, text): one row per file, labelled with the file name; empty files are dropped."""
    docs = spark.read.text(path, wholetext=True).select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"),
        F.col("value").alias("text"))
    return docs.filter(strip(F.col("text")) != "")


def thesaurus_edges(lines: DataFrame, max_synonyms: int = None) -> DataFrame:
    """Comma lines 'root, synonym, ...' -> distinct synonym_of edges, both ways.

    ``max_synonyms`` keeps the first words of a line, None all.
    """
    parts = F.transform(F.split(F.lower("value"), ","), strip)
    rows = lines.select(parts.alias("p")).filter(F.size("p") >= 2).select(
        F.get("p", F.lit(0)).alias("root"),
        F.explode(F.slice("p", 2, max_synonyms or F.size("p"))).alias("syn")) \
        .filter((F.col("syn") != "") & (F.col("syn") != F.col("root")))
    return rows.select(F.inline(F.array(
        F.struct(F.col("root").alias("src"), F.col("syn").alias("dst")),
        F.struct(F.col("syn").alias("src"), F.col("root").alias("dst"))))).distinct() \
        .withColumn("relation", F.lit("synonym_of"))


def read_graph_json(spark: SparkSession, path: str, region: str = "main"):
    """(nodes, edges, paths) of exported graph files; one JSON object per file."""
    doc = spark.read.schema(GRAPH_JSON).json(path, multiLine=True)
    neurons = doc.select(F.inline("neurons"))
    label = neurons.select("id", "label")
    segments = doc.select(F.inline("segments"))
    reg = F.lit(region).alias("region")
    named = (segments.withColumnRenamed("id", "segment_id")
             .join(label.toDF("source_id", "src"), "source_id")
             .join(label.toDF("target_id", "dst"), "target_id"))
    edges = named.select(reg, "src", "dst", "relation", "traversals",
                         F.coalesce("refutations", F.lit(0)).cast("bigint").alias("refutations"),
                         "strength")
    steps = (doc.select(F.inline("path_steps")).join(
        named.select("segment_id", "src", "dst", "relation"), "segment_id")
        .groupBy("path_id").agg(F.array_sort(F.collect_list(
            F.struct("step_order", "src", "dst", "relation"))).alias("s")))
    paths = (doc.select(F.inline("paths"))
             .join(label.toDF("origin_id", "origin"), "origin_id")
             .join(label.toDF("terminus_id", "terminus"), "terminus_id")
             .join(steps.withColumnRenamed("path_id", "id"), "id", "left")
             .select(reg, F.col("id").alias("path_id"), "origin", "terminus", "source_text",
                     F.transform("s", lambda x: F.struct(
                         x["src"].alias("src"), x["dst"].alias("dst"),
                         x["relation"].alias("relation"))).alias("steps")))
    return neurons.select(reg, "label", F.col("neuron_type").alias("node_type")), edges, paths


def merge_new(rows: DataFrame, into: DataFrame, key: list[str]) -> DataFrame:
    """Insert-or-ignore: existing keys keep their row."""
    fresh = rows.dropDuplicates(key).join(into.select(*key).distinct(), key, "left_anti")
    return into.unionByName(fresh, allowMissingColumns=True)


def _quoted(c) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")),
                                          F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, line) of a Graphviz file: nodes shaped by type, edges weighted by their teachings."""
    spark = nodes.sparkSession
    shape = F.lit("plaintext")
    for kind, name in fixed.NODE_SHAPES.items():
        shape = F.when(F.col("node_type") == kind, name).otherwise(shape)
    frame = spark.createDataFrame([(0, "strict digraph evidence {"), (3, "}")],
                                  "ord int, line string")
    body = nodes.select(F.lit(1).alias("ord"), F.concat(
        _quoted("label"), F.lit(" [shape="), shape, F.lit("]")).alias("line"))
    arrows = edges.select(F.lit(2).alias("ord"), F.concat(
        _quoted("src"), F.lit(" -> "), _quoted("dst"), F.lit(" [tooltip="), _quoted("relation"),
        F.lit(" weight="), F.col("traversals").cast("string"), F.lit("]")).alias("line"))
    return frame.unionByName(body).unionByName(arrows)


def export_dot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write the DOT text in order (range-sorted parts, read back by name order)."""
    dot_lines(nodes, edges).orderBy("ord", "line").select("line").write.text(path)


def append_log(log: DataFrame, path: str) -> None:
    """Append evidence rows; the log is the durable store."""
    log.write.mode("append").partitionBy("region").parquet(path)


def save_graph(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("region").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str, names=("nodes", "edges", "paths")) -> dict:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def list_regions(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("region").agg(F.count("*").alias("nodes"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION_JSON).json(path, multiLine=True)


def _picked(n: int, *parts) -> Column:
    """A number below n, hashed from the parts; other engines can compute it too."""
    digest = F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str)
                                      else F.lit(str(p)) for p in parts]))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def shuffle_choices(questions: DataFrame, seed: int = 42) -> DataFrame:
    """Reorder choices by a seeded hash and move the answer index along."""
    tagged = F.transform("choices", lambda c, i: F.struct(
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("question_id").cast("string"),
                          i.cast("string"), c)).alias("h"),
        c.alias("c"), (i == F.col("answer_idx")).alias("right")))
    mixed = F.array_sort(tagged)
    return (questions.withColumn("_m", mixed)
            .withColumn("answer_idx", F.array_position(
                F.transform("_m", lambda x: x["right"]), True).cast("int") - 1)
            .withColumn("choices", F.transform("_m", lambda x: x["c"])).drop("_m"))


def synthesize_statements(vocabulary: DataFrame, seed: int = 42) -> DataFrame:
    """One labelled statement per vocabulary row (id, subject, obj): teach .6, refute .2, ask .2.

    A statement is an opening, the subject, a verb phrase and the object; a
    question asks for the subject.  Picks depend on the row id and the seed alone,
    so reruns and lost tasks give the same rows.
    """
    die = _picked(10, seed, 1, "id")
    kind = F.when(die < 6, "teach").when(die < 8, "refute").otherwise("question")

    def part(values, salt):
        return F.element_at(F.array(*[F.lit(v) for v in values]), _picked(len(values), seed, salt, "id") + 1)
    phrase = F.when(F.col("kind") == "teach", part(fixed.TEACHING_VERBS, 3)) \
        .otherwise(part(fixed.REFUTING_VERBS, 4))
    told = F.concat(part(fixed.OPENINGS, 2), F.col("subject"), F.lit(" "), phrase, F.lit(" "),
                    F.col("obj"))
    asked = F.concat(part(fixed.ASKING, 5), F.col("subject"))
    verb = F.when(F.col("kind") == "teach", "is").when(F.col("kind") == "refute", "is_not") \
        .otherwise("?")
    return (vocabulary.withColumn("kind", kind)
            .withColumn("input", F.when(F.col("kind") == "question", asked).otherwise(told))
            .select("id", "input", "subject", verb.alias("verb"), "obj", "kind"))
