"""Session settings and tables written between the steps of an iterative job.

Level-by-level traversals would otherwise grow one plan without bound.  Each
step is written as Parquet to the cluster's shared checkpoint folder and read
back: lineage ends there, a lost executor only repeats the current step, and
the optimiser sees the true size of the step when it picks a join.
"""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Most rows of a side of a join that are sent whole.
SENT = 100_000

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own, removed when
    the process ends; any other is refused, as executors would not share it.
    """
    conf = spark.sparkContext.getConf()
    configured = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-tracefold-", dir="/tmp")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/tracefold/{app}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_buckets(df: DataFrame, name: str, columns: list[str], buckets: int) -> DataFrame:
    """Write ``df`` once as a bucketed, sorted table; joins on the columns read it without an exchange.

    Only the catalog entry lives in the session; the files are in the shared folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"tracefold_{uuid.uuid4().hex}"
    (df.repartition(buckets, *columns).write.mode("errorifexists").option("path", path)
     .bucketBy(buckets, *columns).sortBy(*columns).saveAsTable(table))
    return spark.table(table)


def sent(side: DataFrame) -> DataFrame:
    """A stored side of a join, to be sent whole if it has few rows by count, else to be merged.

    Files tell little of it: stored columns are packed, and a few MB of them may be GB of rows,
    which a broadcast gathers in the driver.
    """
    return F.broadcast(side) if side.limit(SENT + 1).count() <= SENT else side.hint("merge")


def clear(spark: SparkSession) -> None:
    """Drop this application's scratch tables once its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(
        f"{shared_dir(spark)}/tracefold/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
