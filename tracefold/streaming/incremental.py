"""Structured Streaming over statements and evidence.

The evidence log is append-only and durable per batch; edges are a fold of it.
Counters of an edge depend on event order (seq), not on arrival order, and those
of parts of the log add up: late and out-of-order events give the same result as
one batch over everything.
"""

from pyspark.sql import DataFrame, functions as F

from ..functions import statements
from ..operators.evidence import EDGE_KEY, facts, fold_sources, merge_sources, sources_of, teach


def teach_stream(lines: DataFrame, region: str = "main", negation: str = "refute") -> DataFrame:
    """Stateless: stream of (text, source_label, seq) -> stream of evidence rows.

    A negated statement refutes; with ``negation='ignore'`` it teaches.
    """
    parsed = statements.parse_statements(lines, "text")
    kind = F.when(F.col("negated"), "refute").otherwise("teach") if negation == "refute" \
        else F.lit("teach")
    return teach(facts(parsed.withColumn("source_text", F.col("original")),
                       region=F.lit(region), kind=kind))


class EvidenceSink:
    """foreachBatch target: append to the log, and keep mergeable counters per (edge, source).

    A batch writes its rows and their counters and reads nothing of the log, so
    its cost follows the batch, not the history.  Every ``merge_every`` batches
    the counters so far are merged into one table, whose size is that of the
    distinct (edge, source) pairs.  All is written under the batch id, so a batch
    that is run again after a failure replaces its own files and counts nothing twice.
    """

    def __init__(self, path: str, merge_every: int = 16):
        self.log_path, self.part_path, self.base_path = f"{path}/log", f"{path}/parts", f"{path}/merged"
        self.merge_every = merge_every

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id and batch_id % self.merge_every == 0:
            # the batches before this one are complete, however often this one runs
            self._counters(spark, batch_id).write.mode("overwrite").parquet(
                f"{self.base_path}/upto={batch_id}")
        batch.write.mode("overwrite").parquet(f"{self.log_path}/batch={batch_id}")
        new = spark.read.parquet(f"{self.log_path}/batch={batch_id}")
        sources_of(new).write.mode("overwrite").parquet(f"{self.part_path}/batch={batch_id}")

    def _merged_upto(self, spark, before) -> int:
        """Last complete merge below ``before``; 0 if there is none."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.base_path + "/upto=*/_SUCCESS")
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
        ids = [int(f.getPath().getParent().getName().split("=")[1]) for f in found]
        return max([i for i in ids if before is None or i < before], default=0)

    def _counters(self, spark, before=None) -> DataFrame:
        """Counters per (edge, source) of the batches below ``before``, or of all."""
        base = self._merged_upto(spark, before)
        parts = spark.read.parquet(self.part_path).filter(F.col("batch") >= base)
        if before is not None:
            parts = parts.filter(F.col("batch") < before)
        parts = parts.drop("batch")
        if base:
            parts = parts.unionByName(spark.read.parquet(f"{self.base_path}/upto={base}"))
        return merge_sources(parts)

    def edges(self, spark) -> DataFrame:
        """Current edges."""
        return fold_sources(self._counters(spark))


def new_witnesses(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First evidence row of each (edge, source) within the watermark on ``ts``.

    Bounded state; the exact no-op of repeated sources is the fold's.
    """
    return (log.withWatermark("ts", delay).filter("source_label <> ''")
            .dropDuplicatesWithinWatermark(EDGE_KEY + ["source_label"]))


def activity(events: DataFrame, width: str = "10 minutes", slide: str = None,
             delay: str = "1 hour") -> DataFrame:
    """Events per tumbling or sliding window and kind; late rows only miss this view."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (events.withWatermark("ts", delay).groupBy(window, "kind")
            .agg(F.count("*").alias("events"), F.sum("value").alias("value"))
            .select(F.col("window.start").alias("window_start"),
                    F.col("window.end").alias("window_end"), "kind", "events", "value"))


def last_updates(updates: DataFrame) -> DataFrame:
    """The last update of each window out of batch-numbered ones."""
    return (updates.groupBy("window_start", "kind")
            .agg(F.max_by(F.struct("events", "value"), "batch").alias("u"))
            .select("window_start", "kind", "u.events", "u.value"))


def working_memory(hits: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Convergence per conversation session from (conversation, ts, node, seed, weight).

    A stream keeps the seeds of its open sessions as state; a batch counts them
    with a distributed distinct.
    """
    sources = F.size(F.collect_set("seed")) if hits.isStreaming else F.count_distinct("seed")
    return (hits.withWatermark("ts", delay)
            .groupBy(F.session_window("ts", gap), "conversation", "node")
            .agg(F.sum("weight").alias("weight"), sources.cast("bigint").alias("sources"))
            .select("conversation", F.col("session_window.start").alias("session_start"),
                    "node", "weight", "sources"))
