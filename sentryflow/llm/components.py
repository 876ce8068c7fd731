"""Connected components of an edge table by alternating large-star and small-star steps.

All state stays in staged tables; the driver reads one row (two counts) per round.
Rounds end when every node is a root or a leaf of one root, so none is spent on
finding that nothing changes.  Hubs are pre-aggregated by ``min`` before the shuffle, and a
hub's edges are dealt over several tasks when they are joined back: nodes of over
``hub`` edges are at most edges / ``hub``, and their list is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sentryflow.staging import staged


#: The list of hubs has at most this many rows (of 24 bytes), whatever the input.
HUBS = 100_000


def _with_min(pairs: DataFrame, rows: int, hub: int) -> tuple[DataFrame, DataFrame]:
    """``pairs`` (u, v) with m, the smallest v of its u; and (u, m) alone."""
    hub = max(hub, -(-rows // HUBS))
    low = pairs.groupBy("u").agg(F.min("v").alias("m"), F.ceil(F.count("*") / hub).cast("int").alias("parts"))
    hubs = F.broadcast(low.where("parts > 1").select(F.col("u").alias("h"), F.col("parts").alias("h_parts")))
    dealt = pairs.join(hubs, F.col("u") == F.col("h"), "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("h_parts", F.lit(1))).cast("int").alias("part"))
    each = low.select("u", "m", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return dealt.join(each, ["u", "part"]).select("u", "v", "m"), low.select("u", "m")


def sized(df: DataFrame, rows: int, each: int = 500_000) -> DataFrame:
    """``df`` in a task for every ``each`` of its ``rows`` narrow rows, and no fewer than cores, so that a small table is not hundreds of files."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def connected_components(edges: DataFrame, max_rounds: int = 60, hub: int = 1000, ready: bool = False) -> DataFrame:
    """``edges``: columns a, b (long, any order, repeats and loops allowed; none of them, and staged, if ``ready``).

    Returns (node, root) for every node that has an edge to another; root is the
    smallest node of its component.  Null ends are ignored; an empty table gives
    an empty result.
    """
    e = edges if ready else edges.where("a is not null and b is not null and a <> b")
    e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if not ready:
        e = staged(e.distinct(), "edges")
    rows, loose = _state(e)
    for _ in range(max_rounds):
        if not loose:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, _ = _with_min(both, 2 * rows, hub)
        large = joined.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        joined, low = _with_min(large, rows, hub)
        small = (
            joined.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = staged(sized(small, rows), "edges")
        rows, loose = _state(e)
    if loose:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _state(e: DataFrame) -> tuple[int, int]:
    """The number of edges, and of nodes that are not yet a root or a leaf of one root."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("up")), F.struct(F.col("v").alias("node"), F.lit(None).cast("long").alias("up")))).alias("x"))
    nodes = ends.groupBy("x.node").agg(F.min("x.up").alias("lo"), F.max("x.up").alias("hi"), F.count("x.up").alias("ups"), F.count("*").alias("ends"))
    loose = (F.col("lo") < F.col("hi")) | ((F.col("ups") > 0) & (F.col("ups") < F.col("ends")))
    r = nodes.agg(F.sum("ups"), F.sum(loose.cast("long"))).first()
    return r[0] or 0, r[1] or 0
