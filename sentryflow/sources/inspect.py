"""Row inspection with reasons of rejection, feature union over files, row budget and sampling caps.

Defined cases: a row has one reason, the first that applies: column_count_mismatch, invalid_label, invalid_device,
invalid_timestamp; null cells count as empty; a file of its header alone has no rows; an empty table has no reasons.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sentryflow.functions.scalars import flow_behavior, seeded_rank
from sentryflow.sources.tables import NUMERIC_SHARE, column_key, normalize_columns, number

REASONS = ("column_count_mismatch", "invalid_label", "invalid_device", "invalid_timestamp")
#: Largest logical record, in characters.
MAX_RECORD = 1 << 20


def read_inspected(spark: SparkSession, path: str | list[str], header: list[str], max_record: int = MAX_RECORD) -> DataFrame:
    """Rows of CSV files that share ``header`` as text under normalised names, with ``__fits`` (as many cells as names) and ``source_path``."""
    names = normalize_columns(header)
    schema = ", ".join(f"`{n}` string" for n in names) + ", __bad string"
    df = spark.read.schema(schema).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="__bad", maxCharsPerColumn=max_record).csv(path, recursiveFileLookup=True, pathGlobFilter="*.[cC][sS][vV]")
    return df.select(*names, F.col("__bad").isNull().alias("__fits"), F.col("_metadata.file_path").alias("source_path"))


def timestamp_validity(df: DataFrame, column: str) -> Column:
    """Whether a row's time is valid: a finite number where ``NUMERIC_SHARE`` of all rows are numbers (text of booleans is none), else a UTC time."""
    c = F.col(f"`{column}`")
    r = df.agg(F.count(number(c)).alias("n"), F.count("*").alias("all")).first()
    if r.n >= NUMERIC_SHARE * r["all"]:
        return F.coalesce(F.abs(number(c)) < float("inf"), F.lit(False))
    return c.try_cast("timestamp").isNotNull()


def inspected(df: DataFrame, label: str, device: str | None = None, time: str | None = None, raw: str | None = None, fits: str | None = None) -> DataFrame:
    """Adds reason (null: accepted), device and behavior to text rows."""
    blank = lambda c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) == ""
    tests = [
        (~F.col(fits) if fits else F.lit(False), REASONS[0]),
        (blank(label), REASONS[1]),
        (blank(device) if device else F.lit(False), REASONS[2]),
        (~timestamp_validity(df, time) if time else F.lit(False), REASONS[3]),
    ]
    reason = F.coalesce(*[F.when(test, F.lit(name)) for test, name in tests])
    category = F.trim(F.col(f"`{label}`"))
    out = df.withColumn("reason", reason)
    behavior = flow_behavior(category, F.trim(F.col(f"`{raw}`")) if raw else category)
    return out.withColumn("device", F.when(F.col("reason").isNull(), F.trim(F.col(f"`{device}`")) if device else F.lit("unknown"))).withColumn("behavior", F.when(F.col("reason").isNull(), behavior))


def reason_counts(rows: DataFrame) -> DataFrame:
    """reason ("accepted" for none) and rows."""
    return rows.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("rows"))


def class_device_counts(rows: DataFrame) -> DataFrame:
    """Rows of each behavior and device among the accepted."""
    return rows.where("reason is null").groupBy("behavior", "device").agg(F.count("*").alias("rows"))


def rejected_samples(rows: DataFrame, order: list[str], n: int = 32) -> DataFrame:
    """The first ``n`` rejected rows in order: a report, top-n by design."""
    return rows.where("reason is not null").orderBy(*order).limit(n)


def require_accepted(rows: DataFrame) -> None:
    """An error if any row is rejected."""
    bad = {r.reason: r.rows for r in reason_counts(rows).collect() if r.reason != "accepted"}
    if bad:
        raise ValueError(f"rejected rows: {bad}")


def union_features(frames: Iterable[DataFrame], metadata: Iterable[str] = ()) -> DataFrame:
    """One table of files with different headers: metadata first, then features in the order they are first seen; null where a file lacks one.

    Names that differ in case alone are one feature, under its first spelling.
    """
    frames, meta = list(frames), list(metadata)
    names: dict[str, str] = {column_key(m): m for m in meta}
    for f in frames:
        for c in f.columns:
            names.setdefault(column_key(c), c)
    if len(names) == len(meta):
        raise ValueError("no feature")
    out = None
    for f in frames:
        own = {column_key(c): c for c in f.columns}
        if lost := [m for m in meta if column_key(m) not in own]:
            raise ValueError(f"a file lacks {lost}")
        f = f.select(*[F.col(f"`{own[k]}`").alias(n) for k, n in names.items() if k in own])
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out.select(*[f"`{n}`" for n in names.values()])


def within_budget(df: DataFrame, rows: int | None) -> DataFrame:
    """``df`` itself; an error if it has more rows.  It looks at ``rows`` + 1 rows at most."""
    if rows is not None and df.limit(rows + 1).count() > rows:
        raise MemoryError(f"more than {rows} rows")
    return df


def capped(df: DataFrame, by: str, uid: str, cap: int, seed=2309) -> DataFrame:
    """At most ``cap`` rows of each value of ``by``: those first in the order of their seeded hash, with their rank.

    Rows over the cap are dropped by design (it is a sampling operator); each task keeps ``cap`` rows a value before the shuffle.
    """
    w = Window.partitionBy(by).orderBy("__rank", uid)
    ranked = df.withColumn("__rank", seeded_rank(seed, F.col(uid))).withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap)
    return ranked.drop("__rank")


def out_of_order_rows(df: DataFrame, order: str, ts: str) -> DataFrame:
    """One row: how many rows of the whole input come later in ``order`` than a row of a larger ``ts`` (directly before them).

    Only neighbours in ``order`` are compared, in ranges; a range's first row is compared with the last of the range before.
    """
    from sentryflow.staging import staged

    parts = staged(df.select(F.col(order).alias("o"), F.col(ts).alias("t")).repartitionByRange("o").withColumn("p", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("p").orderBy("o")
    inside = parts.withColumn("before", F.lag("t").over(w)).agg(F.count_if(F.col("t") < F.col("before")).alias("late"))
    edges = parts.groupBy("p").agg(F.min_by("t", "o").alias("first"), F.max_by("t", "o").alias("last"))
    across = edges.withColumn("before", F.lag("last").over(Window.orderBy("p"))).agg(F.count_if(F.col("first") < F.col("before")).alias("late"))
    return inside.unionByName(across).agg(F.sum("late").alias("n_late"))


def content_id(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the columns' values in order, apart by unit separators; nulls are told from empty text."""
    return F.sha2(F.concat_ws("\x1f", *[F.when(F.col(f"`{c}`").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string"))) for c in columns]), 256)


def proof(df: DataFrame, uid: str, label: str) -> DataFrame:
    """One row that is equal for equal sources: rows, distinct ids, their smallest and largest, and an order-free fingerprint of (id, label)."""
    h = F.xxhash64(F.col(uid), F.col(label)).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.count_distinct(uid).alias("ids"), F.min(uid).alias("min_id"), F.max(uid).alias("max_id"), F.sum(h).cast("string").alias("fingerprint"))
