"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Sources in order of code point (null last) weigh 5, 2, 1, 5, 2, 1, ...  They
share ``share`` (150 %) of the words of all documents by weight.  A source may
be repeated ``epochs`` (2) times at most: sources over that are clamped and the
excess is shared by weight among the others until none is above.  Clamping in
order of size / weight reaches that fixed point in one pass.

A source's target is then ``whole`` repetitions of all its documents and one
more of some: documents stand in the order of the MD5 of ``seed`` and their id, and a document is
repeated once more while the middle of its words, counted from the first of the source,
lies within the words still wanted.  The error is half a document at most, and
reruns agree.  A source is cut into 4,096 slices of that order, so that running
sums of a hot source are made slice by slice.

Defined cases: a null or wordless text has size 0 and takes 0; a source without
words has target 0; rows with equal ids stand together, smaller first, then by
the hash of the row; a null id counts as the empty string in the order; rows that
are alike in all columns are each judged, in any order among them.
Very long texts are one row like others.  Columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sentryflow.staging import staged

WEIGHTS = (5, 2, 1)
#: Copies of one row that one task makes, beyond the whole repetitions of its source.
COPIES = 1000


def words(text) -> Column:
    """Runs of other than ASCII white space; 0 for null."""
    parts = F.split(text, r"[\x20\x09-\x0D]+")
    blank = (F.element_at(parts, 1) == "").cast("long") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("long")
    return F.coalesce(F.size(parts) - blank, F.lit(0)).cast("long")


def targets(sources: DataFrame, *, weights=WEIGHTS, share_percent: int = 150, epochs: int = 2) -> DataFrame:
    """``sources``: source, source_size.  Adds weight and target; one row a source, as many as there are sources."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    s = sources.withColumn("weight", w).withColumn("cap", F.lit(epochs) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = (
        s.withColumn("budget", F.sum("source_size").over(everything) * share_percent)  # in hundredths of a word
        .withColumn("left", F.col("budget") - 100 * F.coalesce(F.sum("cap").over(fill), F.lit(0)))
        .withColumn("wleft", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0)))
        .withColumn("clamped", F.col("cap") * 100 * F.col("wleft") <= F.col("weight") * F.col("left"))
    )
    # the first source that is not clamped, in the order of filling, sets the level for all after it
    first = F.min(F.when(~F.col("clamped"), F.struct(F.col("cap") / F.col("weight"), "left", "wleft"))).over(everything)
    level = F.col("weight") * first["left"] / (100 * first["wleft"])
    target = F.when(F.col("clamped") | first.isNull(), F.col("cap").cast("double")).otherwise(level)
    return s.select("source", "source_size", "weight", target.cast("double").alias("target"))


def mix(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share_percent: int = 150, epochs: int = 2, seed: str = "") -> DataFrame:
    """doc_id, source, t (hash of the row), size, source_size, target, repeats, taken for each row of ``docs``."""
    sized = staged(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), row_hash(docs).alias("t"), words(F.col(text_col)).alias("size"))
        .withColumn("order", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
        .withColumn("slice", F.conv(F.substring("order", 1, 3), 16, 10).cast("int")),
        "sized",
    )
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    sources = slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    plan = targets(sources, weights=weights, share_percent=share_percent, epochs=epochs)
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("start", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    plan = starts.join(plan, starts["source"].eqNullSafe(plan["source"])).select(
        starts["source"].alias("p_source"), starts["slice"].alias("p_slice"), "start", "source_size", "target"
    )
    within = Window.partitionBy("source", "slice").orderBy("order", F.col("doc_id").asc_nulls_first(), "size", "t").rowsBetween(Window.unboundedPreceding, -1)
    d = sized.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = d.join(plan, d["source"].eqNullSafe(F.col("p_source")) & (d["slice"] == F.col("p_slice")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    d = d.withColumn("whole", whole)
    more = 2 * (F.col("start") + F.col("ahead")) + F.col("size") <= 2 * (F.col("target") - F.col("whole") * F.col("source_size"))
    repeats = F.when(F.col("size") > 0, F.col("whole") + (more & (F.col("whole") < epochs)).cast("long")).otherwise(F.lit(0))
    d = d.withColumn("repeats", repeats.cast("long"))
    return d.select("doc_id", "source", "t", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def row_hash(df: DataFrame) -> Column:
    """Hash of a row's columns, but for maps."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def repeated(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix repeats it.

    Rows that are alike in all columns share their repeats: each gets the whole part, and one of them the rest, in blocks of ``COPIES``.
    """
    planned = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    planned = staged(planned.groupBy("doc_id", "source", "t").agg(F.sum("repeats").alias("__all"), F.count("*").alias("__rows")), "plan")
    planned = planned.where("__all > 0").withColumnsRenamed({"doc_id": "__p_id", "source": "__p_source", "t": "__p_t"})
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("__source"), row_hash(docs).alias("__t"))
    same = F.col("__id").eqNullSafe(F.col("__p_id")) & F.col("__source").eqNullSafe(F.col("__p_source")) & (F.col("__t") == F.col("__p_t"))
    copies = lambda df, n: df.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), n))).select("__row")
    each = d.join(planned.where("__all >= __rows"), same)
    rest = d.join(planned.where("__all % __rows > 0"), same).dropDuplicates(["__p_id", "__p_source", "__p_t"]).withColumn("__rest", F.expr("__all % __rows"))
    rest = rest.withColumn("__block", F.explode(F.expr(f"sequence(0L, (__rest - 1) div {COPIES})"))).repartition("__p_t", "__block")
    return copies(each, F.expr("__all div __rows")).unionByName(copies(rest, F.least(F.lit(COPIES), F.col("__rest") - COPIES * F.col("__block")))).select("__row.*")
