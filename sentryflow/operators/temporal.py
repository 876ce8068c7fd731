"""Per-device risk state and cascade routing: folds over ordered events.

A fold is sequential within a device and parallel across them.  Partitions are
sorted by device and time and read batch by batch, so memory is one batch and
one device's counters, whatever the length of a history.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sentryflow.operators.transform import action_level, action_name, risk


COUNTERS = ("scan", "flood", "beacon", "unknown", "benign")


@dataclass
class Device:
    """Five saturating counters and the time up to which they have decayed."""

    counters: dict = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))
    since: float | None = None

    def update(self, probs: dict, ts: float | None, *, increment=2, decay=1, evidence=0.45, interval=60.0) -> None:
        lost = 0
        if ts is not None:
            if self.since is None:
                self.since = ts
            elif (steps := int((ts - self.since) // interval)) > 0:
                lost, self.since = steps * decay, self.since + steps * interval
        for c in COUNTERS:
            step = increment if probs[c] >= evidence else -decay
            self.counters[c] = min(15, max(0, self.counters[c] + step - lost))

    def suspicion(self) -> float:
        c = self.counters
        return min(1.0, max(0.0, (c["scan"] + c["flood"] + c["beacon"] + c["unknown"] - c["benign"]) / 60))


def replay(df: DataFrame, keys: list[str], order: list[str], ts: str, prob: str = "prob_{}", **options) -> DataFrame:
    """``keys``, ``order`` and the five counters after each row."""
    columns = {c: prob.format(c if c == "benign" else f"{c}_like") for c in COUNTERS}
    carried = list(dict.fromkeys([*keys, *order]))
    rows = df.select(*carried, F.col(ts).cast("double").alias("__ts"), *[F.col(v).cast("double").alias(f"__{k}") for k, v in columns.items()])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(carried)])

    def run(batches):
        key, state = None, Device()
        for b in batches:
            data = b.to_pydict()
            ids = list(zip(*(data[k] for k in keys)))
            out = {c: [] for c in COUNTERS}
            for i, k in enumerate(ids):
                if k != key:
                    key, state = k, Device()
                state.update({c: data[f"__{c}"][i] or 0.0 for c in COUNTERS}, data["__ts"][i], **options)
                for c in COUNTERS:
                    out[c].append(state.counters[c])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in carried), *(pa.array(out[c], pa.int32()) for c in COUNTERS)], names=[*carried, *(f"state_{c}" for c in COUNTERS)]
            )

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema + "".join(f", state_{c} int" for c in COUNTERS))


def exit_step(state: Device, ts: float | None, boolean: bool, p: float, main: dict, *, threshold: float, penalty: float = 0.30, false_negative_cost: float = 0.10, prior: dict | None = None) -> tuple[float, int]:
    """Exit score and stage of one row; the device's state then takes the probabilities of the model that it left by."""
    prior = prior or {c: 0.25 for c in COUNTERS if c != "benign"}
    doubt = state.suspicion()
    if boolean and doubt <= 0:
        score, stage, probs = 1.0, 0, dict.fromkeys(COUNTERS, 0.0) | {"benign": 1.0}
    else:
        score = p - (1 - p) - penalty * doubt - false_negative_cost
        if score >= threshold:
            stage, probs = 1, {c: (1 - p) * prior.get(c, 0.0) for c in COUNTERS} | {"benign": p}
        else:
            stage, probs = 2, main
    state.update(probs, ts)
    return score, stage


def route(df: DataFrame, keys: list[str], order: list[str], ts: str, *, threshold: float, penalty: float = 0.30, false_negative_cost: float = 0.10, use_state: bool = True, attack_prior: dict | None = None) -> DataFrame:
    """Early-exit routing: exit_stage and exit_score of each row, where earlier rows of a device make it wait.

    Columns needed: ``boolean`` (fast path), ``p_tiny`` (benign probability of the
    small model), ``prob_<label>`` of the main model.  Without state this is a plain CASE.
    """
    p = F.col("p_tiny")
    if not use_state:
        score = p - (1 - p) - false_negative_cost
        stage = F.when(F.col("boolean"), 0).when(score >= threshold, 1).otherwise(2)
        return df.select(*dict.fromkeys([*keys, *order]), F.when(F.col("boolean"), 1.0).otherwise(score).alias("exit_score"), stage.alias("exit_stage"))
    step = functools.partial(exit_step, threshold=threshold, penalty=penalty, false_negative_cost=false_negative_cost, prior=attack_prior)
    carried = list(dict.fromkeys([*keys, *order]))
    rows = df.select(*carried, F.col(ts).cast("double").alias("__ts"), F.col("boolean").alias("__bool"), p.cast("double").alias("__p"), *[F.col(f"prob_{c if c == 'benign' else c + '_like'}").cast("double").alias(f"__{c}") for c in COUNTERS])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(carried)])

    def run(batches):
        key, state = None, Device()
        for b in batches:
            data = b.to_pydict()
            scores, stages = [], []
            for i, k in enumerate(zip(*(data[k] for k in keys))):
                if k != key:
                    key, state = k, Device()
                score, stage = step(state, data["__ts"][i], data["__bool"][i], data["__p"][i], {c: data[f"__{c}"][i] for c in COUNTERS})
                scores.append(score)
                stages.append(stage)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), pa.array(scores, pa.float64()), pa.array(stages, pa.int32())], names=[*carried, "exit_score", "exit_stage"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema + ", exit_score double, exit_stage int")


def with_risk(states: DataFrame, p_benign: str) -> DataFrame:

    r = risk(F.col(p_benign), {c: F.col(f"state_{c}") for c in COUNTERS})
    out = states.withColumn("risk_score", r)
    return out.withColumn("action_level", action_level(F.col("risk_score"))).withColumn("action", action_name(F.col("action_level")))


