"""Line deduplication with levelled sorted runs of line hashes.

A run is a table of (h1, h2, owner, docs), dealt into hash buckets and sorted
by hash within each, one file a bucket, in the shared folder.  Documents come in batches of falling doc_id.  The batch's lines are
merged against the runs with an anti-join: a key that no run holds is owned by
the batch's largest doc_id, which is the largest of all; a key that some run
holds adds its document count without an owner.  The batch then adds a run of
its own to level 0, and ``fanout`` runs of a level are compacted into one run
of the next.  A last compaction gives every key its owner and document count.
Batches are merged against runs, and pairs of runs into one, as they lie: bucket by bucket, without a shuffle.
There is a batch for every ``BATCH_ROWS`` lines, ``batches`` at least.

A line's key is the line stripped of ASCII white space, A-Z lower-cased; it
counts if it has ``min_chars`` code points.  Keys found in ``min_docs``
documents or more lose all their lines except those of the owner.  To mark
them, the lines of a key that is in over ``hot`` documents are dealt over several tasks; there are at
most lines / ``hot`` such keys, and their list is broadcast.

Defined cases: a null or empty text is one empty line; a document is a
distinct doc_id, so rows that repeat an id count once and all keep the lines
that the id owns; rows with a null doc_id take no part and stay whole; very long texts
are split whole; only the id and text columns are read; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sentryflow.staging import new_path, staged

_SPACE = " \t\n\x0b\x0c\r"
BATCH_ROWS = 2_000_000_000
#: The list of hot keys has at most this many rows (of 40 bytes), whatever the input.
HOT_KEYS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@contextmanager
def sorted_scans(spark: SparkSession):
    """Within it, scans of bucketed tables keep the order of their one file a bucket."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bucketed(df: DataFrame) -> DataFrame:
    """Write ``df`` in hash buckets of (h1, h2), each sorted by them, and read it back; the table's name is gone at once, its files stay."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"sentryflow_run_{uuid.uuid4().hex}"
    w = df.repartition(n, "h1", "h2").sortWithinPartitions("h1", "h2").write.bucketBy(n, "h1", "h2").sortBy("h1", "h2")
    w.format("parquet").option("path", new_path(spark, "run")).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


class LineRuns:
    """Levels of sorted runs; level i + 1 holds runs of ``fanout`` runs of level i."""

    def __init__(self, fanout: int = 4):
        self.fanout, self.levels = fanout, [[]]

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """``batch``: h1, h2, owner, docs, one row a key.  Returns its rows, owner null where a run already has the key."""
        new = batch.select("h1", "h2")
        for r in self.runs():
            new = new.join(r.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        if self.runs():
            own = batch.join(new.withColumn("new", F.lit(True)).hint("merge"), ["h1", "h2"], "left")
            batch = own.select("h1", "h2", F.when(F.col("new"), F.col("owner")).alias("owner"), "docs")
        run = bucketed(batch.select("h1", "h2", "owner", "docs"))
        self.levels[0].append(run)
        at = 0
        while len(self.levels[at]) >= self.fanout:
            if at + 1 == len(self.levels):
                self.levels.append([])
            self.levels[at + 1].append(bucketed(self.merged(self.levels[at])))
            self.levels[at] = []
            at += 1
        return run

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        """One run of several by outer merges.  (A union of bucketed scans followed by an aggregate gives wrong groups in Spark 4.1.2.)"""
        out = runs[0].select("h1", "h2", "owner", "docs")
        for r in runs[1:]:
            r = r.select("h1", "h2", F.col("owner").alias("r_owner"), F.col("docs").alias("r_docs"))
            both = out.join(r.hint("merge"), ["h1", "h2"], "full")
            out = both.select("h1", "h2", F.greatest("owner", "r_owner").alias("owner"), (F.coalesce("docs", F.lit(0)) + F.coalesce("r_docs", F.lit(0))).alias("docs"))
        return out


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, t (hash of the text), pos, h1, h2 for each line whose key counts."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    key = lines.select("doc_id", "t", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return key.select("doc_id", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3, hot: int = 20_000) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped for each row."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = keyed_lines(base.where("doc_id is not null"), min_chars)
    spark = docs.sparkSession
    held = staged(lines.select("doc_id", "h1", "h2").distinct(), "lines")
    total = held.count()
    batches = max(batches, -(-total // BATCH_ROWS))
    ends = base.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    batch = F.lit(0)
    for e in ends:
        batch = batch + (F.col("doc_id") > F.lit(e)).cast("int")
    runs = LineRuns(fanout)
    path = new_path(spark, "batches")
    keys = held.groupBy(batch.alias("batch"), "h1", "h2").agg(F.max("doc_id").alias("owner"), F.count("*").alias("docs"))
    keys.write.partitionBy("batch").parquet(path)
    keys = spark.read.schema("h1 long, h2 long, owner long, docs long, batch int").parquet(path)
    with sorted_scans(spark):
        for b in range(len(ends), -1, -1):
            runs.add(bucketed(keys.where(F.col("batch") == b).drop("batch")))
        drops = staged(LineRuns.merged(runs.runs()).where(F.col("docs") >= min_docs), "drops")
    hot = max(hot, -(-total // HOT_KEYS))
    parts = F.ceil(F.col("docs") / hot).cast("int")
    often = F.broadcast(drops.where(F.col("docs") > hot).select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), parts.alias("parts")))
    dealt = drops.select("h1", "h2", "owner", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    lines = lines.join(often, (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2")), "left")
    lines = lines.select("doc_id", "t", "pos", "h1", "h2", F.pmod(F.xxhash64("doc_id", "pos"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    marks = (
        lines.join(dealt, ["h1", "h2", "part"])
        .where("doc_id <> owner")
        .groupBy(F.col("doc_id").alias("m_doc"), F.col("t").alias("m_t"))
        .agg(F.collect_set("pos").alias("gone"))
    )
    keyed = base.withColumn("t", F.xxhash64("text"))
    joined = keyed.join(marks.hint("merge"), (keyed.doc_id == marks.m_doc) & (keyed.t == marks.m_t), "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(_rewrite, "doc_id long, kept_text string, n_lines long, n_dropped long")


def _rewrite(batches):
    for b in batches:
        texts, total, dropped = [], [], []
        for text, gone in zip(b.column(1), b.column(2)):
            lines = (text.as_py() or "").split("\n")
            gone = set(gone.as_py() or ())
            texts.append("\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text.as_py() or "")
            total.append(len(lines))
            dropped.append(len(gone))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())],
            names=["doc_id", "kept_text", "n_lines", "n_dropped"],
        )
