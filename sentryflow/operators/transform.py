"""Imputation, scaling, encoding, open-set rule and exit predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sentryflow.functions import constants as K
from sentryflow.functions.scalars import missing
from sentryflow.operators.stats import long_form, quantiles


def feature_stats(train: DataFrame, features: list[str]) -> dict[str, dict]:
    """Median, quartiles, mean and sd of each feature over the training rows: one row a feature on the driver."""
    moments = long_form(train, features).groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    rows = quantiles(train, features, [0.25, 0.5, 0.75]).join(moments, "feature")
    return {r.feature: {"q25": r.q[0], "median": r.q[1], "q75": r.q[2], "mean": r["mean"], "sd": r.sd} for r in rows.collect()}


def encoder_thresholds(train: DataFrame, features: list[str], kind: str, bits: int = 3) -> dict[str, list[float]]:
    """Thresholds of each feature's encoder, from its exact quantiles: ``bits`` for thermometer, 2 ** ``bits`` - 1 for hybrid, the median for sign."""
    if kind == "none":
        return {f: [] for f in features}
    if not 2 <= bits <= 4:
        raise ValueError("bits must be between 2 and 4")
    qs = {"sign": [0.5], "thermometer": [i / (bits + 1) for i in range(1, bits + 1)], "hybrid": [i / 2**bits for i in range(1, 2**bits)]}[kind]
    return {r.feature: list(r.q) for r in quantiles(train, features, qs).collect()}


def input_groups(features: list[str], kind: str, bits: int = 3) -> list[int]:
    """For each encoded column, the place of its feature."""
    width = bits if kind == "thermometer" else 1
    return [i for i in range(len(features)) for _ in range(width)]


def encoded_of_first(groups: list[int], count: int) -> list[int]:
    """Places of the encoded columns of the first ``count`` features."""
    return [at for at, feature in enumerate(groups) if feature < count]


def full_probabilities(probs: Column, active: list[str], labels=K.LABELS) -> Column:
    """Probabilities of ``active`` labels, then unknown, at the places of all labels; others 0; normalised."""
    at = {label: F.element_at(probs, i + 1) for i, label in enumerate([*active, K.UNKNOWN])}
    placed = F.array(*[at.get(label, F.lit(0.0)) for label in labels])
    total = F.greatest(F.aggregate(placed, F.lit(0.0), lambda a, p: a + p), F.lit(1e-12))
    return F.transform(placed, lambda p: p / total)


def scaled(feature: str, s: dict, scaler: str = "robust") -> Column:
    """Median for missing values, then (x - centre) / scale; a scale of nothing counts as 1."""
    x = F.coalesce(missing(F.col(feature)), F.lit(s["median"]))
    if scaler == "robust":
        return (x - s["median"]) / ((s["q75"] - s["q25"]) or 1.0)
    if scaler == "standard":
        near_constant = s["sd"] <= 10 * 2.220446049250313e-16 * max(abs(s["mean"]), 1e-300)
        return (x - s["mean"]) / (1.0 if near_constant else s["sd"])
    return x


def encode(x: Column, kind: str, thresholds: list[float], median: float) -> Column:
    """Array of encoded inputs of one feature."""
    if kind == "none":
        return F.array(x)
    if kind == "sign":
        return F.array(F.when(x >= median, 1.0).otherwise(-1.0))
    t = F.array(*map(F.lit, thresholds))
    if kind == "thermometer":
        return F.transform(t, lambda v: F.when(x >= v, 1.0).otherwise(-1.0))
    if kind == "hybrid":
        return F.array(2.0 * F.size(F.filter(t, lambda v: x >= v)) / len(thresholds) - 1.0)
    raise ValueError(kind)


def encode_label(label: Column, labels: list[str]) -> Column:
    return (F.array_position(F.array(*map(F.lit, labels)), label) - 1).cast("int")


def anomaly_distance(values: list[Column], centres: list[float]) -> Column:
    total = F.lit(0.0)
    for v, c in zip(values, centres):
        total = total + F.abs(v - c)
    return total / len(values)


def open_set(probs: Column, distance: Column, threshold: float, confidence: float) -> tuple[Column, Column]:
    """(is_unknown, probabilities with the unknown share last) for known-label probabilities."""
    top = F.array_max(probs)
    strength = 1 / (1 + F.exp(-4 * (distance / threshold - 1)))
    uncertain = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (confidence - top) / confidence)) if confidence > 0 else F.lit(0.0)
    u = F.least(F.lit(0.999), F.greatest(F.lit(0.0), strength * uncertain))
    full = F.concat(F.transform(probs, lambda p: p * (1 - u)), F.array(u))
    total = F.greatest(F.aggregate(full, F.lit(0.0), lambda a, p: a + p), F.lit(1e-12))
    return (top < confidence) & (distance >= threshold), F.transform(full, lambda p: p / total)


def boolean_exit(limits: dict[str, float]) -> Column:
    """All features finite and at most their limit; no limits: false."""
    out = F.lit(bool(limits))
    for f, t in limits.items():
        out = out & F.coalesce(missing(F.col(f)) <= t, F.lit(False))
    return out


def exit_score(p: Column, temporal_risk: Column, device_risk: Column, false_negative_cost: float) -> Column:
    return p - (1 - p) - temporal_risk - device_risk - false_negative_cost


def risk(p_benign: Column, counters: dict[str, Column]) -> Column:
    w = K.RISK_WEIGHTS
    r = w["model"] * (1 - p_benign)
    for name in ("scan", "flood", "beacon", "unknown"):
        r = r + w[name] * counters[name] / 15
    r = r - w["benign"] * counters["benign"] / 15
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), r))


def action_level(r: Column) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, K.ACTION_THRESHOLDS)), lambda t: t <= r))


def action_name(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, K.ACTIONS)), (level + 1).cast("int"))


def stateful_label(level: Column, predicted: Column, counters: dict[str, Column]) -> Column:
    order = ["scan", "flood", "beacon", "unknown"]
    top = F.greatest(*[counters[c] for c in order])
    largest = F.coalesce(*[F.when(counters[c] == top, F.lit(f"{c}_like")) for c in order])
    return F.when(level < 2, "benign").when(predicted != "benign", predicted).otherwise(largest)


