"""Train-only feature statistics, in as few passes as the data needs."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sentryflow.functions.scalars import feature_cost, missing
from sentryflow.operators.order import quantile_steps


def long_form(df: DataFrame, features: list[str], carry: list[str] = ()) -> DataFrame:
    """feature, ordinal, value (null if missing) and ``carry``: one row a feature and row."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("ordinal"), missing(F.col(f)).alias("value")) for i, f in enumerate(features)])
    return df.select(*carry, F.inline(pairs))


def finite_counts(df: DataFrame, features: list[str]) -> DataFrame:
    return long_form(df, features).groupBy("feature").agg(F.count("value").alias("finite"), (F.count("*") - F.count("value")).alias("missing"))


def quantiles(df: DataFrame, features: list[str], qs: list[float]) -> DataFrame:
    """feature, q (array): exact linear-interpolation quantiles, from counts by distinct value in ranges."""
    found = quantile_steps(long_form(df, features), ["feature"], "value", qs)
    return found.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "x"))), lambda e: e["x"]).alias("q"))


def extremes(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row: smallest and largest ``key``, and the smallest, largest and number of distinct values of each column."""
    each = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("distinct", F.count_distinct))]
    return df.agg(F.min(key).alias(f"min_{key}"), F.max(key).alias(f"max_{key}"), *each)


def exact_sum(value: Column) -> Column:
    """A sum that does not depend on the order of rows: 18 digits after the point, rounded to a double at the end."""
    return F.sum(value.cast("decimal(38,18)")).cast("double")


def ordered_digest(values: DataFrame, column: str, prefix: int = 3) -> DataFrame:
    """n and digest of hexadecimal strings in their order, read as a stream in sorted partitions.

    A leaf is the SHA-256 of the sorted values of one prefix, joined by newlines; the digest is that of the
    leaves in the order of their prefixes, joined likewise.  So at most 16 ** ``prefix`` leaves meet.
    """
    rows = values.select(F.substring(column, 1, prefix).alias("prefix"), F.col(column).alias("h"))

    def run(batches):
        now, sha, n = None, None, 0
        for b in batches:
            for p, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if p != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pylist([{"prefix": now, "n": n, "leaf": sha.hexdigest()}])
                    now, sha, n = p, hashlib.sha256(), 0
                sha.update((("\n" if n else "") + h).encode())
                n += 1
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"prefix": now, "n": n, "leaf": sha.hexdigest()}])

    leaves = rows.where("h is not null").repartition("prefix").sortWithinPartitions("prefix", "h").mapInArrow(run, "prefix string, n long, leaf string")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("prefix", "leaf"))), lambda e: e["leaf"])
    return leaves.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.concat_ws("\n", ordered), 256).alias("digest"))


def class_moments(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """feature, label, n, mean, m2 of the float32 values; merging is Spark's own."""
    rows = long_form(df, features, [label]).withColumn("value", F.col("value").cast("float").cast("double"))
    return rows.groupBy("feature", "ordinal", label).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2"))


def f_scores(moments: DataFrame, label: str) -> DataFrame:
    """ANOVA F by feature; not finite, or too few rows: 0."""
    w = Window.partitionBy("feature")
    m = moments.where("n > 0").withColumn("grand", F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w))
    g = m.groupBy("feature", "ordinal").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("ssb"), F.sum("m2").alias("ssw")
    )
    score = F.try_divide(F.try_divide("ssb", F.col("k") - 1), F.try_divide("ssw", F.col("n") - F.col("k")))
    return g.select("feature", "ordinal", F.coalesce(F.when(F.col("n") > F.col("k"), score), F.lit(0.0)).alias("f_score"), ((F.col("ssb") + F.col("ssw")) / F.col("n")).alias("variance"))


def rank_features(scores: DataFrame, selection: str = "f_score", budget: int | None = None) -> DataFrame:
    """Ranks by score, ties in column order; as many rows as there are features."""
    every = Window.partitionBy()
    if selection == "cost_aware":
        s = F.coalesce(F.try_divide("f_score", F.max("f_score").over(every)), F.lit(0.0)) / feature_cost(F.col("feature"))
    else:
        s = F.col(selection)
    ranked = scores.withColumn("score", s).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ordinal")))
    return ranked if budget is None else ranked.where(F.col("rank") <= max(1, budget))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).count()
    every = Window.partitionBy()
    raw = counts.withColumn("raw", F.sum("count").over(every) / (F.count("*").over(every) * F.col("count")))
    return raw.select(label, "count", (F.col("raw") / F.avg("raw").over(every)).alias("weight"))


def bottom_k(df: DataFrame, uid: str, priority, k: int) -> DataFrame:
    """The k rows of smallest (priority, uid): a mergeable sample of whole rows, kept as a top-k per task."""
    return df.withColumn("priority", priority).orderBy("priority", uid).limit(k)


def dkw(n, alpha: float = 0.05):
    """Largest error of an empirical quantile of n values, with confidence 1 - alpha."""
    return F.least(F.lit(1.0), F.sqrt(F.log(F.lit(2.0 / alpha)) / (2 * n)))
