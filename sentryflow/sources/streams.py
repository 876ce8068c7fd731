"""Tables read as streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentryflow.staging import table


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """A Parquet table as a stream; its schema is that of the files there now.

    The path is a pattern (one that only the table meets), as a file source takes a lone file only by pattern.
    """
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{name}.parque[t]")
