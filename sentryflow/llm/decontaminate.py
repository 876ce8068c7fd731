"""Benchmark decontamination; DataFrame functions only.

Texts are lower-cased words (runs of letters and digits).  Every window of a
document that is as long as some benchmark item is compared with the items of
that length:

1. A window can only be similar to an item if it shares a word shingle with
   one, so windows without any are left out; this loses nothing.
2. A window's and an item's 64-bit SimHash over shingles must be within
   ``radius`` bits.  The fingerprint is cut into 8 blocks of 8 bits; two within
   the radius are within ``radius // 8`` bits in some block (pigeonhole), so items
   are posted under every block value that near and windows look up their own.
3. The exact weighted Jaccard similarity of the two shingle multisets must
   reach ``threshold``.

A document that is shorter than an item is one window, the whole of it.  It is
compared exactly, without step 2, if its shingles that are in items of that
length are enough for ``threshold``: similarity is shared / (document + item - shared).

A radius of 23 is 4.6 standard deviations above the distance expected at
similarity 0.8, so step 2 practically never decides against step 3.

Windows are made in slices of ``STEP`` starts, dealt over all tasks, so that a long
document is neither one task nor copied into each of its windows.

Defined cases: null and short texts (under ``shingle`` words) match nothing, nor
do such items; the windows of repeated rows are those of one row; items with
equal texts all match; rows with a null doc_id or items with a null id are
searched and reported like others; very long texts and items are exact up to
2 ** 31 shingles; equal similarities go to the first window; only the id and text
columns are read, whatever others are called; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sentryflow.staging import spread, staged

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 23
BLOCKS = 8
#: A benchmark's shingles and fingerprints, and a set of document keys, are broadcast up to so many bytes and joined by a shuffle beyond.
BROADCAST_BYTES = 48 << 20
#: Windows in a slice of a document.
STEP = 1024


def with_shingles(df: DataFrame, text: str, k: int) -> DataFrame:
    """Adds ``sh``: 64-bit hashes of the k-word shingles in order; empty for fewer words."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    sh = F.when(F.size("__words") < k, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("__words") - k), lambda i: F.xxhash64(*[F.get("__words", i + j) for j in range(k)]))
    )
    return once(once(df, "__words", words), "sh", sh).drop("__words")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row; a generator keeps the optimiser from copying it into every use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_simhash(df: DataFrame, sh: str, n: str, name: str) -> DataFrame:
    """Adds the 64-bit SimHash of an array of ``n`` shingle hashes: bit b is set if more than half of the hashes have it.

    Two 32-bit counters a long, so arrays of under 2 ** 31 shingles are exact.  Bits are counted and set by one
    expression over their numbers: one a bit makes plans that take the driver hundreds of MB to prepare.
    """
    lanes = 0x0000000100000001
    none = F.lit(0).cast("long")
    right = lambda x, k: F.call_function("shiftrightunsigned", x, k)
    counts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.aggregate(sh, none, lambda a, x: a + right(x, k).bitwiseAND(F.lit(lanes))))
    count = lambda b: right(F.get("__lanes", b.bitwiseAND(F.lit(31))), b.bitwiseAND(F.lit(32))).bitwiseAND(F.lit(0xFFFFFFFF))
    bit = lambda b: F.when(2 * count(b) > F.col(n), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(none)
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(63)), none, lambda a, b: a.bitwiseOR(bit(b)))
    return once(once(df, "__lanes", counts), name, bits).drop("__lanes")


def block(h: Column, b: int) -> Column:
    return F.shiftrightunsigned(h, 8 * b).bitwiseAND(F.lit(255)).cast("int")


def items_of(benchmark: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """item_id, n (shingles), sh, counts (distinct shingles with their counts), fp: one row an item of k words or more."""
    rows = with_shingles(benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")), "text", k)
    rows = rows.select("item_id", "sh").where(F.size("sh") > 0).distinct()
    counts = F.transform(
        F.array_distinct("sh"), lambda g: F.struct(g.alias("g"), F.size(F.filter("sh", lambda x: x == g)).alias("c"))
    )
    return with_simhash(rows.select("item_id", F.size("sh").alias("n"), "sh", counts.alias("counts")), "sh", "n", "fp")


def small(df: DataFrame, width: Column | int) -> DataFrame:
    """``df`` (staged), marked for broadcast if its rows, of ``width`` bytes each, are counted to be small."""
    total = df.agg(F.sum(width if isinstance(width, Column) else F.lit(width))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df.hint("merge")


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col="doc_id",
    text_col="text",
    item_id_col="item_id",
    item_text_col="text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    radius: int = RADIUS,
) -> DataFrame:
    """doc_id, t (hash of the text), item_id, start_shingle (first best window), similarity: the pairs at or over the threshold."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    items = staged(items_of(benchmark, item_id_col, item_text_col, shingle), "items")
    grams = staged(items.select(F.explode("sh").alias("g"), "n").distinct().groupBy("g").agg(F.collect_set("n").alias("ns")), "grams")
    base = base.withColumn("t", F.xxhash64("text"))
    hashed = with_shingles(spread(base), "text", shingle)
    at = hashed.select("doc_id", "t", F.size("sh").alias("len"), F.posexplode("sh").alias("pos", "g"))
    hits = at.join(small(grams, 32 + 8 * F.size("ns")), "g").select("doc_id", "t", "len", "pos", F.explode("ns").alias("n")).where(F.col("len") / F.col("n") >= threshold)
    # the windows that hold a hit start in few slices; a document shorter than the item is slice 0
    last = F.greatest(F.col("len") - F.col("n"), F.lit(0))
    first_slice = F.floor(F.least(F.greatest(F.col("pos") - F.col("n") + 1, F.lit(0)), last) / STEP).cast("int")
    slices = F.sequence(first_slice, F.floor(F.least(F.col("pos"), last) / STEP).cast("int"))
    found = hits.withColumn("slice", F.explode(slices)).groupBy("doc_id", "t", "n", "len", "slice").agg(F.collect_set("pos").alias("hits"))
    enough = F.size("hits") / (F.col("len") + F.col("n") - F.size("hits")) >= threshold
    found = staged(found.where((F.col("len") >= F.col("n")) | enough), "hits")
    docs_hit = staged(found.select(F.col("doc_id").alias("h_id"), F.col("t").alias("h_t")).distinct(), "docs_hit")
    listed = small(docs_hit, 16)
    near = base.join(listed, (F.col("t") == F.col("h_t")) & F.col("doc_id").eqNullSafe(F.col("h_id")), "left_semi").dropDuplicates(["doc_id", "t"])
    near = with_shingles(near, "text", shingle).select(F.col("doc_id").alias("h_id"), F.col("t").alias("h_t"), "sh")
    part = F.slice("sh", F.col("slice") * STEP + 1, F.when(F.col("len") < F.col("n"), F.col("len")).otherwise(F.col("n") + (STEP - 1)))
    parts = found.join(near.hint("merge"), (F.col("t") == F.col("h_t")) & F.col("doc_id").eqNullSafe(F.col("h_id"))).select("doc_id", "t", "n", "len", "slice", "hits", part.alias("sh"))
    parts = staged(parts, "slices")
    low, high = F.col("slice") * STEP, F.least(F.col("slice") * STEP + (STEP - 1), last)
    starts = F.array_distinct(F.flatten(F.transform("hits", lambda p: F.sequence(F.greatest(p - F.col("n") + 1, low), F.least(p, high)))))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    windows = parts.where("len >= n").repartition(tasks, "t", "n", "slice").select("doc_id", "t", "n", "slice", "sh", F.explode(starts).alias("start"))
    windows = with_simhash(once(windows, "w", F.slice("sh", F.col("start") - low + 1, F.col("n"))).drop("sh", "slice"), "w", "n", "fp")
    slack = radius // BLOCKS
    keys = staged(
        items.select("item_id", F.xxhash64("sh").alias("item_t"), "n", F.col("fp").alias("item_fp"), F.explode(F.array(*[F.struct(F.lit(b).alias("b"), block(F.col("fp"), b).alias("v0")) for b in range(BLOCKS)])).alias("k"))
        .select("item_id", "item_t", "n", "item_fp", F.col("k.b").alias("b"), F.explode(F.filter(F.sequence(F.lit(0), F.lit(255)), lambda v: F.bit_count(F.col("k.v0").bitwiseXOR(v)) <= slack)).alias("v")),
        "blocks",
    )
    probes = windows.select("*", F.explode(F.array(*[F.struct(F.lit(b).alias("b"), block(F.col("fp"), b).alias("v")) for b in range(BLOCKS)])).alias("k")).select("doc_id", "t", "n", "start", "w", "fp", "k.b", "k.v")
    x = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first_block = F.coalesce(*[F.when(F.bit_count(block(x, b)) <= slack, F.lit(b)) for b in range(BLOCKS)])
    pairs = probes.join(small(keys, 48), ["n", "b", "v"]).where((F.bit_count(x) <= radius) & (first_block == F.col("b"))).drop("b", "v", "fp", "item_fp")
    # only what is within the radius meets the items' shingle counts
    full = staged(items.select(F.col("item_id").alias("c_id"), F.xxhash64("sh").alias("c_t"), "counts"), "counts")
    pairs = pairs.join(small(full, 32 + 24 * F.size("counts")), (F.col("item_t") == F.col("c_t")) & F.col("item_id").eqNullSafe(F.col("c_id")))
    shared = F.aggregate("counts", F.lit(0), lambda a, e: a + F.least(e["c"], F.size(F.filter("w", lambda y: y == e["g"]))))
    scored = once(pairs.select("doc_id", "t", "n", "item_id", "start", "w", "counts"), "shared", shared).withColumn("similarity", F.col("shared") / (2 * F.col("n") - F.col("shared")))
    columns = ["doc_id", "t", "item_id", "start", "similarity"]
    scored = scored.select(*columns).unionByName(whole_documents(parts.where("len < n"), items).select(*columns))
    return (
        scored.where(F.col("similarity") >= threshold)
        .groupBy("doc_id", "t", "item_id")
        .agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
        .select("doc_id", "t", "item_id", (-F.col("best.back")).cast("long").alias("start_shingle"), F.col("best.similarity").alias("similarity"))
    )


def whole_documents(short: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, t, item_id, start (0), similarity of documents (doc_id, t, sh, len, n) and the items of n shingles that share one."""
    grams = short.select("doc_id", "t", "len", "n", F.explode("sh").alias("g")).groupBy("doc_id", "t", "len", "n", "g").agg(F.count("*").alias("have"))
    listed = items.select("item_id", F.xxhash64("sh").alias("item_t"), "n", F.explode("counts").alias("e")).select("item_id", "item_t", "n", "e.g", "e.c")
    pairs = grams.join(listed, ["n", "g"]).groupBy("doc_id", "t", "len", "n", "item_id", "item_t").agg(F.sum(F.least("have", "c")).alias("shared"))
    return pairs.select("doc_id", "t", "item_id", F.lit(0).alias("start"), (F.col("shared") / (F.col("len") + F.col("n") - F.col("shared"))).alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found; all columns stay."""
    bad = staged(matches(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("__bad_id"), F.col("t").alias("__bad_t")).distinct(), "bad")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__t"))
    same = F.col("__id").eqNullSafe(F.col("__bad_id")) & (F.col("__t") == F.col("__bad_t"))
    return rows.join(small(bad, 16), same, "left_anti").select("__row.*")
