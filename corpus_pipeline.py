"""A training-corpus pipeline over ``documents``.

Stages, each written as Parquet and read again as the next one's input:

1. language: documents without a letter go, and those of 60 letters or more whose
   profile cosine is under 0.1; profiles are learned from the labelled rows.
2. near_dedup: of each group of near duplicates (five-word shingles, Jaccard of
   0.8 or more) the row with the smallest doc_id stays.  Rows are judged by their texts:
   a repeated or null doc_id ties nothing together.
3. decontaminate: documents that hold a benchmark item go.
4. mixing: documents are repeated or left out to the sources' target shares.
5. packing: token ids in packed rows, written as binary matrices and read back.

Nulls: a null text is without language and goes in stage 1; a null doc_id is
judged like others; a null source is a source of its own; extra columns, whatever
their names, are carried by stages 1 to 4; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sentryflow.llm import decontaminate as decontamination, language_id, mixing, near_dedup, packing
from sentryflow.staging import staged, table

NEAR_PERCENT = 80
#: Equal coordinates of 48; a pair at exactly 0.8 has fewer with a chance of 8e-7.
NEAR_MATCHES = 24
#: The last stage cannot be expressed in SQL (byte-pair encoding, packing), nor the first (random vectors).
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.written_in(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, percent=NEAR_PERCENT, matches=NEAR_MATCHES)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.read_matrix(packing.write_packed(docs))


STAGES = [("language", language), ("near_dedup", near_duplicates), ("decontaminate", decontaminate), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
