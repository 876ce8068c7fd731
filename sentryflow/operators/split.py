"""Leakage-safe splits by hash ranks and order positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sentryflow.functions.constants import UNKNOWN
from sentryflow.functions.scalars import normalize_token, seeded_rank
from sentryflow.operators.order import running
from sentryflow.staging import staged

FRACTIONS = (0.70, 0.15)
#: Leading hexadecimal digits of a hash that rows are counted by.
BUCKET_DIGITS = 3


def positions(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """Adds the row's place (from 0) in a total order, without bringing the rows to one task.

    Rows are range-partitioned once; places are counted in partitions and shifted by
    the sizes of those before, one small row a partition.
    """
    w = Window.partitionBy("__part").orderBy(*order)
    parts = staged(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("__part").count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    return parts.withColumn("__own", F.row_number().over(w) - 1).join(F.broadcast(starts), "__part").withColumn(name, F.col("__own") + F.col("__start")).drop("__part", "__own", "__start")


def quotas(counts: DataFrame, label: str, target: Column, total: Column) -> DataFrame:
    """Largest-remainder shares of ``target`` rows over labels; ties to the smaller label."""
    c = counts.withColumn("__t", target.cast("long")).withColumn("__n", total.cast("long"))
    c = c.withColumn("base", F.floor(F.col("count") * F.col("__t") / F.col("__n")).cast("long")).withColumn("rest", (F.col("count") * F.col("__t")) % F.col("__n"))
    every = Window.partitionBy()
    c = c.withColumn("left", F.col("__t") - F.sum("base").over(every)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("rest"), label)))
    return c.select(label, "count", (F.col("base") + (F.col("place") <= F.col("left")).cast("long")).alias("quota"))


def split_random(df: DataFrame, uid: str, label: str, seed=2309, fractions=FRACTIONS) -> DataFrame:
    """Stratified: labels share floor(n * fraction) rows by largest remainder; rows in the order of their seeded hash, those without an id last.

    Rows are counted by label and leading hash digits. Only those in the bucket of a label's last training or
    validation row are put in order, a few thousandths of a large table; a bucket before or after these is whole in one part.
    """
    bucket = F.coalesce(F.conv(F.substring("__rank", 1, BUCKET_DIGITS), 16, 10).cast("int"), F.lit(16**BUCKET_DIGITS))
    keyed = df.withColumn("__rank", seeded_rank(seed, F.col(uid))).withColumn("__bucket", bucket)
    sizes = staged(keyed.groupBy(label, "__bucket").agg(F.count("*").alias("__size")), "buckets")
    counts = sizes.groupBy(label).agg(F.sum("__size").alias("count"))
    n = F.sum("count").over(Window.partitionBy())
    tv = counts.withColumn("n", n).withColumn("tr", F.floor(F.col("n") * fractions[0])).withColumn("va", F.floor(F.col("n") * fractions[1]))
    train = quotas(tv.select(label, "count", "tr", "n"), label, F.col("tr"), F.col("n")).select(label, F.col("quota").alias("__train"))
    val = quotas(tv.select(label, "count", "va", "n"), label, F.col("va"), F.col("n")).select(label, F.col("quota").alias("__val"))
    ends = train.join(val, label).select(label, F.col("__train").alias("__end1"), (F.col("__train") + F.col("__val")).alias("__end2"))
    before = Window.partitionBy(label).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    steps = sizes.withColumn("__below", F.coalesce(F.sum("__size").over(before), F.lit(0))).join(F.broadcast(ends), label)
    # the first bucket that goes on after the part's last row; none if the part takes the label's last row
    edge = lambda end: F.min(F.when(F.col("__below") + F.col("__size") > F.col(end), F.struct("__bucket", "__below")))
    plan = steps.groupBy(label, "__end1", "__end2").agg(edge("__end1").alias("__e1"), edge("__end2").alias("__e2"))
    past = F.lit(16**BUCKET_DIGITS + 1)
    plan = plan.select(label, "__end1", "__end2", *[c for k in "12" for c in (F.coalesce(f"__e{k}.__bucket", past).alias(f"__at{k}"), F.col(f"__e{k}.__below").alias(f"__below{k}"))])
    placed = keyed.join(F.broadcast(staged(plan, "plan")), label)  # one row a label
    b = F.col("__bucket")
    at_edge = (b == F.col("__at1")) | (b == F.col("__at2"))
    whole = placed.where(~at_edge).withColumn("split", F.when(b < F.col("__at1"), "train").when(b < F.col("__at2"), "validation").otherwise("test"))
    few = staged(placed.where(at_edge).withColumn("__one", F.lit(1)), "edges")
    ranked = running(few, [label, "__bucket"], ["__rank", uid], {"__i": "__one"})
    i = F.col("__i") + F.when(b == F.col("__at1"), F.col("__below1")).otherwise(F.col("__below2"))
    near = ranked.withColumn("split", F.when(i <= F.col("__end1"), "train").when(i <= F.col("__end2"), "validation").otherwise("test"))
    own = ["__rank", "__bucket", "__end1", "__end2", "__at1", "__at2", "__below1", "__below2"]
    return whole.drop(*own).unionByName(staged(near.drop(*own, "__one", "__i"), "ranked"))


def split_device(df: DataFrame, uid: str, device: str, held_out: list[str] | None = None, seed=2309, fractions=FRACTIONS) -> DataFrame:
    """Held-out devices (default: the largest id) are the test set; validation is its share of the rest, by hash rank."""
    if not held_out:
        held_out = [df.agg(F.max(device)).first()[0]]
    rest = positions(df.where(~F.col(device).isin(held_out)).withColumn("__rank", seeded_rank(seed, F.col(uid))), "__rank", uid, name="__i")
    n = rest.count()
    n_val = int(n * fractions[1] / sum(fractions))
    rest = rest.withColumn("split", F.when(F.col("__i") < n - n_val, "train").otherwise("validation")).drop("__i", "__rank")
    return rest.unionByName(df.where(F.col(device).isin(held_out)).withColumn("split", F.lit("test")))


def split_attack(df: DataFrame, uid: str, label: str, attack: str, held_out: list[str] | None = None, **options) -> DataFrame:
    """Held-out attacks (default: the largest that is not benign), and rows already unknown, are tested as unknown; the rest is split at random."""
    token = normalize_token(F.col(attack))
    if not held_out:
        held_out = [df.where(F.col(label) != "benign").agg(F.max(token)).first()[0]]
    held = token.isin(held_out) | (F.col(label) == UNKNOWN)
    unknown = df.where(held).withColumn(label, F.lit(UNKNOWN)).withColumn("split", F.lit("test"))
    return split_random(df.where(~held), uid, label, **options).unionByName(unknown)


def split_time(df: DataFrame, uid: str, ts: str, fractions=FRACTIONS) -> DataFrame:
    n = df.count()
    a, b = int(n * fractions[0]), int(n * fractions[0]) + int(n * fractions[1])
    part = F.when(F.col("__i") < a, "train").when(F.col("__i") < b, "validation").otherwise("test")
    return positions(df, ts, uid, name="__i").withColumn("split", part).drop("__i")


def split_sequence(df: DataFrame, source: str, index: str, fractions=FRACTIONS) -> DataFrame:
    n = df.groupBy(F.col(source).alias("__s")).agg(F.count("*").alias("__n"))
    placed = running(df.withColumn("__one", F.lit(1)), [source], [index], {"__i": "__one"}).join(n, F.col(source).eqNullSafe(F.col("__s")))
    i, n = F.col("__i") - 1, F.col("__n")
    part = F.when(i < F.floor(n * fractions[0]), "train").when(i < F.floor(n * fractions[0]) + F.floor(n * fractions[1]), "validation").otherwise("test")
    return placed.withColumn("split", part).drop("__one", "__i", "__n", "__s")


def split_block(df: DataFrame, source: str, index: str, block_size: int = 10_000, seed=2309, fractions=FRACTIONS) -> DataFrame:
    """Whole blocks of a source go to one part, in the order of their seeded hash."""
    key = F.concat(F.col(source), F.lit("::"), F.floor(F.col(index) / block_size).cast("string"))
    keyed = df.withColumn("__block", key)
    blocks = positions(keyed.select("__block").distinct().withColumn("__rank", seeded_rank(seed, F.col("__block"))), "__rank", "__block", name="__i")
    n = blocks.count()
    n_test = -int(-(n * (1 - sum(fractions))) // 1)
    n_val = -int(-(n * fractions[1]) // 1)
    part = F.when(F.col("__i") < n_test, "test").when(F.col("__i") < n_test + n_val, "validation").otherwise("train")
    return keyed.join(blocks.select("__block", part.alias("split")), "__block").drop("__block")


def leaked(df: DataFrame, key: str) -> DataFrame:
    """Keys that lie in more than one part."""
    return df.groupBy(key).agg(F.count_distinct("split").alias("parts")).where("parts > 1")


def coverage(expected: DataFrame, actual: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """One row: keys that are extra, missing, or differ in ``compare``."""
    e = expected.select(key, F.struct(*compare).alias("e"))
    a = actual.select(key, F.struct(*compare).alias("a"))
    j = e.join(a, key, "full_outer")
    return j.agg(
        F.count_if(F.col("e").isNull()).alias("extra"),
        F.count_if(F.col("a").isNull()).alias("missing"),
        F.count_if(F.col("a").isNotNull() & F.col("e").isNotNull() & (F.col("a") != F.col("e"))).alias("mismatched"),
    )


def split_cross(source: DataFrame, target: DataFrame, uid: str, *, seed=2309, fractions=FRACTIONS) -> DataFrame:
    """Rows of ``source`` are for training and validation, by hash rank; all rows of ``target`` are the test set."""
    n = source.count()
    n_val = int(n * fractions[1] / sum(fractions))
    ranked = positions(source.withColumn("__rank", seeded_rank(seed, F.col(uid))), "__rank", uid, name="__i")
    own = ranked.withColumn("split", F.when(F.col("__i") < n - n_val, "train").otherwise("validation")).drop("__i", "__rank")
    return own.unionByName(target.withColumn("split", F.lit("test")))


def source_coverage(df: DataFrame, source: str, parts=("train", "validation", "test")) -> DataFrame:
    """Rows of each source in each part, and in all."""
    counts = df.groupBy(source).agg(*[F.count_if(F.col("split") == p).alias(p) for p in parts], F.count("*").alias("rows"))
    return counts


def coverage_differs(coverage: DataFrame, expected: DataFrame, source: str) -> DataFrame:
    """Sources whose number of rows is not that of ``expected`` (source, rows)."""
    e = expected.select(F.col(source).alias("__s"), F.col("rows").alias("expected"))
    return coverage.join(e, F.col(source).eqNullSafe(F.col("__s")), "full_outer").where(~F.col("rows").eqNullSafe(F.col("expected"))).select(F.coalesce(source, "__s").alias(source), "rows", "expected")


def members(df: DataFrame, membership: DataFrame, uid: str, part: str | None = None) -> DataFrame:
    """Rows of ``df`` with the part that ``membership`` (uid, split) gives them, or those of one part."""
    m = membership.select(F.col(uid).alias("__uid"), "split")
    if part is not None:
        return df.join(m.where(F.col("split") == part), F.col(uid) == F.col("__uid"), "left_semi")
    return df.join(m, F.col(uid) == F.col("__uid")).drop("__uid")


def part_counts(df: DataFrame, label: str, device: str) -> DataFrame:
    """Rows and devices of each label and part."""
    return df.groupBy(label, "split").agg(F.count("*").alias("rows"), F.count_distinct(device).alias("devices"))


def overlap(df: DataFrame, key: str, first: str = "train", second: str = "test") -> DataFrame:
    """Distinct ``key`` that both parts hold."""
    return df.groupBy(key).agg(F.max(F.col("split") == first).alias("a"), F.max(F.col("split") == second).alias("b")).where("a and b").select(key)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows only ``a`` has and only ``b`` has, repeats counted; both 0 for equal sets."""
    c = list(a.columns)
    d = a.withColumn("__d", F.lit(1)).unionByName(b.withColumn("__d", F.lit(-1))).groupBy(*c).agg(F.sum("__d").alias("__d"))
    return d.agg(F.coalesce(F.sum(F.greatest("__d", F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(-F.col("__d"), F.lit(0))), F.lit(0)).alias("only_b"))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def manifest(df: DataFrame, strategy: str, uid: str, label: str, device: str, *, capped: bool = False, out_of_core: bool = False) -> dict:
    """Counts of a split and what may be concluded from it; a row in two parts is an error."""
    if (bad := leaked(df, uid).count()) > 0:
        raise ValueError(f"{bad} rows are in more than one part")
    rows = part_counts(df, label, device).collect()
    by_part = df.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct(device).alias("devices")).collect()
    ordered = ("time", "device") if out_of_core else ("time", "sequence", "device")
    out = {
        "strategy": strategy,
        "rows": {r.split: r.rows for r in by_part},
        "devices": {r.split: r.devices for r in by_part},
        "class_counts": {r.split: {x[label]: x.rows for x in sorted(rows, key=lambda x: str(x[label])) if x.split == r.split} for r in by_part},
        "device_overlap": [r[0] for r in overlap(df, device).orderBy(device).limit(100).collect()],
        "unknown_in_train": sum(r.rows for r in rows if r.split == "train" and r[label] == UNKNOWN),
        "sampling_applied_before_split": capped,
        "natural_evaluation_distribution": not capped and strategy != "attack",
        "temporal_continuity": strategy in ordered and not capped,
    }
    if not out["temporal_continuity"]:
        out["temporal_validity_note"] = "The replay is exploratory: this split, or sampling before it, leaves out events in between."
    return out


def batch_plan(df: DataFrame, shard: str, order: list[str], size: int) -> DataFrame:
    """Adds batch (from 0 within a shard): ``size`` rows each, in order; a last batch of one row is avoided by taking one from the batch before."""
    placed = running(df.withColumn("__one", F.lit(1)), [shard], order, {"__i": "__one"})
    n = df.groupBy(F.col(shard).alias("__s")).agg(F.count("*").alias("__n"))
    placed = placed.join(n, F.col(shard).eqNullSafe(F.col("__s")))
    lone = (F.col("__n") % size == 1) & (F.col("__n") > 1)
    batch = F.floor((F.col("__i") - 1) / size) + (lone & (F.col("__i") == F.col("__n") - 1)).cast("long") if size > 2 else F.floor((F.col("__i") - 1) / size)
    return placed.withColumn("batch", batch.cast("long")).drop("__one", "__i", "__n", "__s")
