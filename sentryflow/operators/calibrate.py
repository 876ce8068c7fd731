"""Threshold calibration on validation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sentryflow.functions.scalars import missing
from sentryflow.operators.order import value_at
from sentryflow.operators.stats import quantiles


def places_below(x: Column, limits: list[float], all_places: int) -> Column:
    """How many of the rising limits are less than x; all places for a missing x or no limits."""
    if not limits:
        return F.lit(all_places)
    return F.when(x.isNull(), all_places).otherwise(F.size(F.filter(F.array(*map(F.lit, limits)), lambda t: t < x)))


def fast_path_sweep(df: DataFrame, features: list[str], is_benign, min_recall: float, grid=None) -> DataFrame:
    """q, benign_exit, attack_recall for 50 benign quantiles of each feature: one quantile pass and one counting pass."""
    grid = grid or [round(0.50 + 0.01 * i, 2) for i in range(50)]
    at = {r.feature: r.q for r in quantiles(df.where(is_benign), features, grid).collect()}
    # limits rise with q, so a row is inside from some q on: one place a row, then running sums over at most len(grid) rows
    first = F.lit(0)
    for f in features:
        first = F.greatest(first, places_below(missing(F.col(f)), at.get(f) or [], len(grid)))
    counts = df.groupBy(first.alias("at"), is_benign.alias("b")).agg(F.count("*").alias("n"))
    wanted = df.sparkSession.createDataFrame([(i, q) for i, q in enumerate(grid)], "i int, q double")
    inside = F.coalesce(F.sum(F.when(F.col("at") <= F.col("i"), F.col("n"))), F.lit(0))
    rates = counts.crossJoin(F.broadcast(wanted)).groupBy("q", "b").agg((inside / F.sum("n")).alias("share"))
    out = rates.groupBy("q").agg(F.max(F.when(F.col("b"), F.col("share"))).alias("benign_exit"), F.max(F.when(~F.col("b"), 1 - F.col("share"))).alias("attack_recall"))
    return out.withColumn("meets", F.col("attack_recall") >= min_recall)


def exit_threshold(df: DataFrame, score: str, is_attack, min_recall: float, points: int = 201) -> DataFrame:
    """Smallest candidate over the largest attack score that must not leave early: threshold, benign_exit, attack_recall.

    Candidates are ``points`` evenly spaced values over the range of scores and the scores themselves.
    """
    s = F.col(score)
    r = df.agg(F.min(s).alias("lo"), F.max(s).alias("hi"), F.count_if(is_attack).alias("n")).first()
    if r.lo is None:
        return df.sparkSession.createDataFrame([], "threshold double, benign_exit double, attack_recall double")
    need = -int(-(min_recall * r.n) // 1)
    lo, hi = r.lo - 1e-6, r.hi + 1e-6
    # the ``need``-th smallest attack score must stay below the threshold
    edge = value_at(df.where(is_attack), score, need) if need else lo
    grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
    over = [g for g in grid if edge is None or g > edge]
    next_score = df.where(s > edge).agg(F.min(s)).first()[0] if edge is not None else None
    best = min([x for x in ([min(over)] if over else []) + ([next_score] if next_score is not None else [])], default=hi)
    return df.agg(
        F.lit(best).alias("threshold"), F.avg(F.when(~is_attack, (s >= best).cast("double"))).alias("benign_exit"), F.avg(F.when(is_attack, (s < best).cast("double"))).alias("attack_recall")
    )


def confidence_sweep(df: DataFrame, top: str, distance: str, distance_threshold: float, max_rate: float = 0.02) -> DataFrame:
    """confidence, rate for the 189 confidences .05 to .99: share of known rows that would be called unknown."""
    steps = [round(0.05 + 0.005 * i, 3) for i in range(189)]
    p, given = F.col(top), F.array(*map(F.lit, steps))
    # how many steps the top probability reaches: a guess within one place, then exactly; one place a row
    guess = F.greatest(F.lit(0), F.least(F.lit(185), F.floor((p - 0.05) / 0.005).cast("int") - 1))
    reached = guess + F.size(F.filter(F.slice(given, guess + 1, 4), lambda t: t <= p))
    counts = df.groupBy(reached.alias("reached")).agg(F.count("*").alias("n"), F.count_if(F.col(distance) >= distance_threshold).alias("far"))
    wanted = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(steps)], "i int, confidence double")
    rates = counts.crossJoin(F.broadcast(wanted)).groupBy("confidence").agg((F.sum(F.when(F.col("reached") <= F.col("i"), F.col("far")).otherwise(0)) / F.sum("n")).alias("rate"))
    return rates.withColumn("allowed", F.col("rate") <= max_rate)
