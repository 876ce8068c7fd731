"""Exact classification and operational metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sentryflow.functions import constants as K
from sentryflow.operators.order import running, value_at


def confusion(df: DataFrame, true="true_label", pred="predicted_label") -> DataFrame:
    return df.groupBy(true, pred).count()


def per_class(cells: DataFrame, true="true_label", pred="predicted_label") -> DataFrame:
    """label, tp, support, predicted, precision, recall, f1 for labels seen in truth or prediction; 0 for no rows."""
    t = cells.select(F.col(true).alias("label"), F.col("count").alias("support"), F.lit(0).alias("predicted"), F.when(F.col(true) == F.col(pred), F.col("count")).otherwise(0).alias("tp"))
    p = cells.select(F.col(pred).alias("label"), F.lit(0).alias("support"), F.col("count").alias("predicted"), F.lit(0).alias("tp"))
    g = t.unionByName(p).groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    g = g.withColumn("precision", zero(F.try_divide("tp", "predicted"))).withColumn("recall", zero(F.try_divide("tp", "support")))
    return g.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def summary(classes: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy, macro averages and MCC in one row."""
    d = lambda c: F.col(c).cast("double")
    a = classes.agg(
        F.sum(d("tp")).alias("c"), F.sum(d("support")).alias("s"), F.sum(d("support") * d("predicted")).alias("tp_"), F.sum(d("predicted") * d("predicted")).alias("pp"),
        F.sum(d("support") * d("support")).alias("tt"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
    )
    den = F.sqrt(F.col("s") * F.col("s") - F.col("pp")) * F.sqrt(F.col("s") * F.col("s") - F.col("tt"))
    mcc = F.coalesce(F.try_divide(F.col("c") * F.col("s") - F.col("tp_"), den), F.lit(0.0))
    return a.select((F.col("c") / F.col("s")).alias("accuracy"), "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1", mcc.alias("mcc"))


def brier(probs: Column, true: Column, labels=K.LABELS) -> Column:
    """Sum of squared differences from the one-hot truth, for one row."""
    hot = F.transform(F.array(*map(F.lit, labels)), lambda x: F.when(x == true, 1.0).otherwise(0.0))
    return F.aggregate(F.zip_with(probs, hot, lambda p, h: (p - h) * (p - h)), F.lit(0.0), lambda a, x: a + x)


def calibration_error(df: DataFrame, confidence: str, correct: str) -> DataFrame:
    """Ten bins with the edges as given; the last is closed, and what falls between edges is in none."""
    c = F.col(confidence)
    edges = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (lo, hi) in enumerate(K.ECE_EDGES)])
    inside = F.filter(edges, lambda e: (c >= e["lo"]) & ((c < e["hi"]) | ((e["i"] == 9) & (c <= e["hi"]))))
    bin_of = F.try_element_at(inside, F.lit(1))["i"]
    total = df.select(F.count("*").alias("n"))
    bins = df.withColumn("bin", bin_of).where("bin is not null").groupBy("bin").agg(F.count("*").alias("m"), F.avg(c).alias("conf"), F.avg(F.col(correct).cast("double")).alias("acc"))
    return bins.crossJoin(total).agg(F.sum(F.col("m") / F.col("n") * F.abs(F.col("acc") - F.col("conf"))).alias("ece"))


def ranking_metrics(scores: DataFrame) -> DataFrame:
    """``scores``: label, score, positive (boolean).  label, auroc, average_precision; labels with one side only are left out.

    Equal scores are one step, summed before the shuffle; steps are ordered in ranges, so that a label is no single task.
    """
    steps = scores.groupBy("label", "score").agg(F.sum(F.col("positive").cast("long")).alias("pos"), F.sum((~F.col("positive")).cast("long")).alias("neg"))
    sides = steps.groupBy(F.col("label").alias("__l")).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).where("P > 0 and N > 0")
    s = running(steps.withColumn("__down", -F.col("score")), ["label"], ["__down"], {"tp": "pos", "fp": "neg"}).join(sides, F.col("label") == F.col("__l"))
    area = F.col("neg") * (F.col("tp") + (F.col("tp") - F.col("pos"))) / 2.0
    return s.groupBy("label").agg(
        F.sum(area / (F.col("P") * F.col("N"))).alias("auroc"), F.sum(F.col("pos") / F.col("P") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision")
    )


def fixed_fpr_boundary(benign: DataFrame, score: str, target: float) -> float | None:
    """The score that a row must exceed for at most floor(target * n) benign rows to be called attacks.

    Counts by distinct score are summed first and added up in ranges; the driver reads one row.
    """
    return value_at(benign, score, int(target * benign.count() + 1e-12) + 1, descending=True)


def operational(df: DataFrame, level: str = "action_level", true: str = "true_label", pred: str | None = None, raw: str | None = None) -> DataFrame:
    """Alert and mitigation rates, precision and recalls of a replay, in one row; null where nothing is counted.

    With ``pred``, what the classifier alone would alert; with ``raw``, recall on attacks whose name speaks of a low rate.
    """
    attack, alert, mitigate = F.col(true) != "benign", F.col(level) >= 2, F.col(level) >= 3
    share = lambda of, cond=None: F.avg(F.when(cond, of.cast("double")) if cond is not None else of.cast("double"))
    out = [
        F.count("*").alias("rows"), F.count_if(alert).alias("alerts"), F.count_if(mitigate).alias("mitigations"),
        share(alert).alias("alert_rate"), share(mitigate).alias("mitigation_rate"),
        share(attack, alert).alias("alert_precision"), share(alert, attack).alias("alert_recall"), share(mitigate, attack).alias("mitigation_recall"),
        share(attack, mitigate).alias("action_precision"), share(mitigate, ~attack).alias("benign_disruption_rate"),
        share(alert, ~attack).alias("false_alert_rate"), (1 - share(alert)).alias("reduction_vs_every_row"),
        *[(share(mitigate, attack) * p / 100).alias(f"sensitivity_{p}") for p in (25, 50, 75)],
    ]
    if pred is not None:
        stateless = F.col(pred) != "benign"
        out += [F.count_if(stateless).alias("stateless_alerts"), (1 - F.try_divide(F.count_if(alert), F.count_if(stateless))).alias("reduction_vs_stateless"), share(stateless, attack).alias("stateless_recall")]
    if raw is not None:
        out.append(share(alert, F.coalesce(F.lower(F.col(raw)).rlike("low|slow|beacon"), F.lit(False))).alias("low_rate_recall"))
    return df.agg(*out)


def episodes(df: DataFrame, keys: list[str], order: list[str], ts: str, true: str = "true_label", level: str = "action_level") -> DataFrame:
    """Maximal runs of attack rows in a sequence, with the delay to the first alert in rows and seconds (null: missed)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    attack = F.col(true) != "benign"
    d = df.withColumn("__a", attack).withColumn("__edge", (attack & ~F.coalesce(F.lag(attack).over(w), F.lit(False))).cast("int"))
    d = d.withColumn("__e", F.sum("__edge").over(w)).withColumn("__i", F.row_number().over(w)).where("__a")
    alert, mitigate = F.col(level) >= 2, F.col(level) >= 3
    g = d.groupBy(*keys, F.col("__e").alias("episode")).agg(
        F.count("*").alias("length"), F.min("__i").alias("first_row"), F.min(ts).alias("first_ts"),
        F.min(F.when(alert, F.col("__i"))).alias("alert_row"), F.min_by(F.when(alert, F.col(ts)), F.when(alert, F.col("__i"))).alias("alert_ts"),
        F.min(F.when(mitigate, F.col("__i"))).alias("mitigation_row"), F.min_by(F.when(mitigate, F.col(ts)), F.when(mitigate, F.col("__i"))).alias("mitigation_ts"),
    )
    return g.select(
        *keys, "episode", "length", (F.col("alert_row") - F.col("first_row")).alias("delay_rows"), (F.col("alert_ts") - F.col("first_ts")).alias("delay_seconds"),
        (F.col("mitigation_row") - F.col("first_row")).alias("mitigation_rows"), (F.col("mitigation_ts") - F.col("first_ts")).alias("mitigation_seconds"),
    )


def episode_summary(found: DataFrame, *, continuous: bool = True, real_time: bool = True) -> DataFrame:
    """One row: episodes, missed ones, and p50 and p95 of the delays of those that were detected; delays are null where time is not to be trusted."""
    p = lambda c, q, use: (F.percentile(c, F.lit(q)) if use else F.lit(None).cast("double")).alias(f"{c}_p{int(q * 100)}")
    mitigation = "mitigation_seconds" if real_time else "mitigation_rows"
    return found.agg(
        F.count("*").alias("episodes"), F.count_if(F.col("delay_rows").isNull()).alias("missed_alerts"), F.count_if(F.col("mitigation_rows").isNull()).alias("missed_mitigations"),
        p("delay_rows", 0.5, continuous), p("delay_rows", 0.95, continuous), p("delay_seconds", 0.5, real_time), p("delay_seconds", 0.95, real_time),
        (F.percentile(mitigation, F.lit(0.5)) if continuous else F.lit(None).cast("double")).alias("mitigation_p50"),
    )


def false_alert_events(df: DataFrame, keys: list[str], order: list[str], true: str = "true_label", level: str = "action_level") -> DataFrame:
    """One row: how often an alert begins on a benign row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    alert = F.col(level) >= 2
    rising = alert & ~F.coalesce(F.lag(alert).over(w), F.lit(False)) & (F.col(true) == "benign")
    return df.select(rising.alias("r")).agg(F.count_if("r").alias("false_alert_events"))


def false_alerts_per_hour(df: DataFrame, keys: list[str], order: list[str], ts: str, **columns) -> DataFrame:
    """One row: false alert events, observed device hours, and events an hour."""
    both = false_alert_events(df, keys, order, **columns).crossJoin(device_hours(df, keys, ts))
    return both.select("false_alert_events", "device_hours", F.try_divide("false_alert_events", "device_hours").alias("false_alerts_per_hour"))


def routing_summary(routed: DataFrame, operations: tuple[float, float, float], stage: str = "exit_stage") -> DataFrame:
    """One row: share of each exit, average operations a row, and their reduction against running both models on every row."""
    boolean, tiny, main = operations
    at = lambda c: F.avg(c.cast("double"))
    st = F.col(stage)
    spent = boolean + tiny * at(st >= 1) + main * at(st == 2)
    return routed.agg(
        at(st == 0).alias("boolean_share"), at(st == 1).alias("tiny_share"), at(st == 2).alias("main_share"), spent.alias("average_operations"), (1 - spent / (tiny + main)).alias("reduction")
    )


def latency_summary(samples: DataFrame, order: str, value: str, last: int = 10_000) -> DataFrame:
    """One row: p50, p95 and mean of the last ``last`` samples in order."""
    recent = samples.orderBy(F.desc(order)).limit(last)
    return recent.agg(F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"), F.avg(value).alias("mean"), F.count("*").alias("n"))


def false_negatives(df: DataFrame, true: str = "true_label", pred: str = "predicted_label") -> DataFrame:
    """One row: share of high-risk rows called benign, and recall of the unknown label."""
    miss, unknown = (F.col(pred) == "benign").cast("double"), (F.col(pred) == K.UNKNOWN).cast("double")
    return df.agg(F.avg(F.when(F.col(true).isin(K.HIGH_RISK), miss)).alias("high_risk_fnr"), F.avg(F.when(F.col(true) == K.UNKNOWN, unknown)).alias("unknown_recall"))


def attack_prior(df: DataFrame, true: str = "true_label") -> DataFrame:
    """Share of each attack label among attack rows; as many rows as labels."""
    c = df.where(F.col(true) != "benign").groupBy(true).count()
    return c.select(true, (F.col("count") / F.sum("count").over(Window.partitionBy())).alias("prior"))


def macro_auprc(rankings: DataFrame, labels: list[str]) -> DataFrame:
    """Mean average precision over ``labels``; a label with one side only counts 0."""
    return rankings.where(F.col("label").isin(labels)).agg((F.coalesce(F.sum("average_precision"), F.lit(0.0)) / len(labels)).alias("macro_auprc"))


def selection_score(macro_f1, auprc, attack_recall, weights: dict[str, float]) -> Column:
    """Weighted sum by which a validation run is chosen; weights must be shares that sum to 1."""
    names = ("macro_f1", "macro_auprc", "attack_recall")
    if set(weights) != set(names) or any(not 0 <= w <= 1 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must be shares of macro_f1, macro_auprc and attack_recall that sum to 1")
    return sum(weights[n] * v for n, v in zip(names, (macro_f1, auprc, attack_recall)))


def experiment_summary(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sample standard deviation and half width of the 95 % interval of runs that differ in their seed."""
    n, sd = F.count(value), F.stddev_samp(value)
    return runs.groupBy(*by).agg(n.alias("runs"), F.avg(value).alias("mean"), sd.alias("sd"), (1.96 * sd / F.sqrt(n)).alias("ci95"))

def device_hours(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    spans = df.groupBy(*keys).agg(F.greatest((F.max(ts) - F.min(ts)) / 3600, F.lit(1 / 3600)).alias("hours"))
    return spans.agg(F.sum("hours").alias("device_hours"))
