"""Shared-storage staging: cut lineage with tables that every executor can read.

A staged table is a Parquet folder below the folder that the cluster names in
``spark.checkpoint.dir``.  Executors may be lost at any time: a staged table is
replicated by that file system and never lives on one machine, unlike a local
checkpoint or a cached block.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


FOLDER = "sentryflow"
BATCH_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set and all tasks run on this machine (tests)."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sentryflow-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{FOLDER}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` on this session, whatever their rows hold; a smaller setting stays.

    Results are lazy, so the bound has to last; every operator that sends texts to Python comes through here first.
    """
    size = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    bound_batches(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """At more than half of its largest heap the driver collects its garbage, and executors drop the shuffles and broadcasts of plans that a staged table has cut off."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        spark._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of fewer partitions than cores over all cores; larger tables are left as they are read."""
    bound_batches(df.sparkSession)
    want = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() < want:
        return df.repartition(want)
    return df


def remove_staged(spark: SparkSession) -> None:
    """Delete all tables staged by this application's folder, when no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{FOLDER}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
