"""Running totals in a total order, without bringing a group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sentryflow.staging import staged


def running(df: DataFrame, group: list[str], order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """Adds, for each ``new: old`` of ``sums``, the sum of ``old`` up to and including the row, within its group in the given order.

    Rows are dealt by ranges of group and order, so a hot group is several tasks; sums are made
    within each range and shifted by those of the group's earlier ranges, one small row a range and group.
    ``order`` must tell all rows of a group apart.
    """
    parts = staged(df.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("__part", *group).agg(*[F.sum(old).alias(f"__t_{new}") for new, old in sums.items()])
    starts = totals.select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__g_{g}") for g in group], *[F.coalesce(F.sum(f"__t_{new}").over(before), F.lit(0)).alias(f"__s_{new}") for new in sums])
    same = F.col("__part") == F.col("__p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    out = parts.select("*", *[F.sum(old).over(own).alias(f"__o_{new}") for new, old in sums.items()]).join(starts, same)
    return out.select(*df.columns, *[(F.col(f"__o_{new}") + F.col(f"__s_{new}")).alias(new) for new in sums])


def quantile_steps(values: DataFrame, group: list[str], value: str, qs: list[float]) -> DataFrame:
    """``group``, q, x: exact quantiles with linear interpolation of the non-null values, from counts by distinct value."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    steps = running(counts, group, ["__v"], {"__up": "__c"})
    n = counts.groupBy(*group).agg(F.sum("__c").alias("__n"))
    # as many rows as groups and quantiles
    wanted = n.select(*[F.col(g).alias(f"__w_{g}") for g in group], "__n", F.explode(F.array(*map(F.lit, qs))).alias("q")).withColumn("__h", (F.col("__n") - 1) * F.col("q"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__w_{g}"))
    holds = lambda at: (F.col("__up") > at) & (F.col("__up") - F.col("__c") <= at)
    low, high = F.floor("__h"), F.ceil("__h")
    hit = steps.join(F.broadcast(wanted), same & (holds(low) | holds(high)))
    found = hit.groupBy(*group, "q", "__h").agg(F.max(F.when(holds(low), F.col("__v"))).alias("__lo"), F.max(F.when(holds(high), F.col("__v"))).alias("__hi"))
    return found.select(*group, "q", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (F.col("__h") - F.floor("__h"))).alias("x"))


def value_at(scores: DataFrame, score: str, rank: int, descending: bool = False) -> float | None:
    """The ``rank``-th (from 1) smallest or largest value; the last one if there are fewer; None for no rows."""
    sign = -1 if descending else 1
    counts = scores.where(F.col(score).isNotNull()).select((F.col(score) * sign).alias("__v")).groupBy("__v").agg(F.count("*").alias("__c"))
    steps = running(counts, [], ["__v"], {"__up": "__c"})
    row = steps.agg(F.min(F.when(F.col("__up") >= rank, F.col("__v"))).alias("at"), F.max("__v").alias("last")).first()
    at = row["last"] if row["at"] is None else row["at"]
    return None if at is None else sign * at
