"""Partitioned, ordered Parquet shards and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sentryflow.staging import new_path


def write_shards(df: DataFrame, partitions: list[str], order: list[str], path: str | None = None, rows_per_file: int = 1_000_000, salt: int = 16) -> str:
    """zstd files of at most ``rows_per_file`` rows below ``column=value`` folders, each file in ``order``; returns the folder.

    A partition's rows go to ``salt`` tasks by hash of the order columns, so that a hot one is written in parallel.
    """
    path = path or new_path(df.sparkSession, "shards")
    dealt = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salt))).repartition(*partitions, "__salt").drop("__salt")
    dealt.sortWithinPartitions(*partitions, *order).write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).partitionBy(*partitions).parquet(path)
    return path


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def misplaced(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    """file and number of rows that come before their predecessor in its order."""
    df = spark.read.parquet(path).withColumn("__f", F.col("_metadata.file_path")).withColumn("__i", F.col("_metadata.row_index"))
    w = Window.partitionBy("__f").orderBy("__i")
    key = F.struct(*order)
    return df.select(F.col("__f").alias("file"), (F.lag(key).over(w) > key).alias("bad")).groupBy("file").agg(F.count_if("bad").alias("misplaced"))
