"""Configuration rules and the contracts that inputs must meet before a run: small driver-side logic."""

from __future__ import annotations

import copy
import hashlib
import json
import math
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, functions as F

from sentryflow.functions.constants import LABELS

STRATEGIES = ("random", "device", "attack", "time", "sequence", "block", "cross")
ENCODERS = ("none", "sign", "thermometer", "hybrid")
NEURAL = ("fp32_mlp", "vanilla_bnn", "cost_aware_bnn")
MODELS = (*NEURAL, "logistic_regression", "random_forest", "hist_gradient_boosting", "xgboost")
#: Parts of a configuration that decide results; the rest may differ between runs that are compared.
SCIENTIFIC = ("dataset", "split", "preprocess", "model", "training", "temporal", "cascade")


def merged(base: Mapping, over: Mapping) -> dict:
    """``base`` with the values of ``over``; nested mappings are merged key by key, everything else is replaced."""
    out = copy.deepcopy(dict(base))
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


def _whole(v) -> bool:
    return isinstance(v, int) and not isinstance(v, bool) and v > 0


def problems(config: Mapping) -> list[str]:
    """What is wrong with a configuration, all of it at once; empty if it can be run."""
    part = lambda name: config.get(name) or {}
    d, sp, pre, model, temporal, training, cascade, ev = map(part, ("dataset", "split", "preprocess", "model", "temporal", "training", "cascade", "evaluation"))
    out: list[str] = []
    rule = lambda ok, text: None if ok else out.append(text)
    storage, shards = d.get("storage", "csv"), d.get("shard_manifest")
    rule(storage in ("csv", "parquet"), "dataset.storage is csv or parquet")
    if storage == "parquet":
        rule(isinstance(shards, str) and shards.strip().casefold().endswith(".json"), "dataset.shard_manifest names a JSON manifest")
    else:
        rule(shards is None, "dataset.shard_manifest needs dataset.storage=parquet")
    for name in ("chunk_size", "record_batch_rows", "shard_target_rows", "quantile_sketch_capacity"):
        rule(name not in d or _whole(d[name]), f"dataset.{name} is a positive integer")
    for name in ("max_rows_per_file", "max_rows_per_class", "max_loaded_rows"):
        rule(d.get(name) is None or _whole(d[name]), f"dataset.{name} is a positive integer or null")
    shares = [float(sp.get(f"{p}_fraction", x)) for p, x in (("train", 0.7), ("validation", 0.15), ("test", 0.15))]
    rule(all(x > 0 for x in shares) and math.isclose(sum(shares), 1.0, rel_tol=1e-5, abs_tol=1e-8), "split fractions are positive and sum to 1")
    strategy = sp.get("strategy", "random")
    rule(strategy in STRATEGIES, f"split.strategy is one of {STRATEGIES}")
    rule(not sp.get("held_out_attacks") or strategy == "attack", "split.held_out_attacks needs split.strategy=attack")
    rule(not sp.get("held_out_devices") or strategy == "device", "split.held_out_devices needs split.strategy=device")
    rule(pre.get("encoder", "sign") in ENCODERS, f"preprocess.encoder is one of {ENCODERS}")
    rule(2 <= int(pre.get("thermometer_bits", 2)) <= 4, "preprocess.thermometer_bits is 2 to 4")
    kind = model.get("type", "logistic_regression")
    rule(kind in MODELS, f"model.type is one of {MODELS}")
    if kind in NEURAL:
        dims = list(model.get("hidden_dims", []))
        rule(bool(dims) and all(int(x) > 0 for x in dims), "model.hidden_dims holds positive sizes")
    steps = list(temporal.get("action_thresholds", [0.18, 0.30, 0.44, 0.60, 0.78]))
    rule(len(steps) == 5 and steps == sorted(steps), "temporal.action_thresholds are five rising values")
    rule(int(temporal.get("max_devices", 4096)) > 0, "temporal.max_devices is positive")
    weights = training.get("selection_weights")
    if weights is not None:
        rule(set(weights) == {"macro_f1", "macro_auprc", "attack_recall"} and all(0 <= float(w) <= 1 for w in weights.values()) and math.isclose(sum(map(float, weights.values())), 1.0, abs_tol=1e-9), "training.selection_weights are shares that sum to 1")
    for name in ("checkpoint_every_epochs", "checkpoint_every_steps", "shuffle_buffer_rows"):
        rule(name not in training or _whole(training[name]), f"training.{name} is a positive integer")
    for device, risk in (cascade.get("device_criticality") or {}).items():
        rule(0 <= float(risk) <= 1, f"cascade.device_criticality of {device!r} is in 0 to 1")
    for target in ev.get("fixed_fpr_targets") or []:
        rule(0 < float(target) < 1, "evaluation.fixed_fpr_targets lie between 0 and 1")
    return out


def checked(config: Mapping) -> dict:
    if found := problems(config):
        raise ValueError("; ".join(found))
    return dict(config)


def fingerprint(value) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def same_science(a: Mapping, b: Mapping, parts: Iterable[str] = SCIENTIFIC) -> list[str]:
    """Names of the parts in which two configurations differ; runs may be compared if there are none."""
    return [p for p in parts if fingerprint(a.get(p)) != fingerprint(b.get(p))]


def public(value):
    """A configuration without keys that begin with an underscore, as it is written to a file."""
    if isinstance(value, Mapping):
        return {k: public(v) for k, v in value.items() if not str(k).startswith("_")}
    return [public(v) for v in value] if isinstance(value, list) else value


def shared_schema(source: list[str], target: list[str], shared: list[str], source_id: str | None, target_id: str | None) -> list[str]:
    """The features that two datasets share; an error unless both have all of them and declare the same schema.  Nothing is filled in."""
    if not shared:
        raise ValueError("no shared features are named")
    if not source_id or source_id != target_id:
        raise ValueError("the feature schema ids differ")
    lost = {side: sorted(set(shared) - set(have)) for side, have in (("source", source), ("target", target))}
    if any(lost.values()):
        raise ValueError(f"shared features are missing: {lost}")
    return [str(x) for x in shared]


def materialised_columns(available: list[str], selected: list[str], boolean: list[str]) -> tuple[list[str], list[str]]:
    """(columns, missing boolean features): the selected ones, then boolean ones that are there and not yet selected, in their order."""
    if lost := [c for c in selected if c not in available]:
        raise ValueError(f"selected features are missing: {lost}")
    more = [c for c in dict.fromkeys(boolean) if c in available and c not in selected]
    return [*selected, *more], [c for c in dict.fromkeys(boolean) if c not in available]


def foreign_labels(df: DataFrame, label: str, domain: Iterable[str] = LABELS) -> DataFrame:
    """Labels out of the domain, with their rows; null is one."""
    c = F.col(label)
    return df.where(c.isNull() | ~c.isin(*domain)).groupBy(label).agg(F.count("*").alias("rows"))


def prediction_problems(df: DataFrame, uid: str, labels: Iterable[str] = LABELS, stage: str = "exit_stage") -> DataFrame:
    """One row of counts that must all be 0 in a table of predictions: repeated ids, rows whose exit is none of 0 to 2, rows whose probabilities are no distribution."""
    p = [F.col(f"prob_{x}") for x in labels]
    wrong = F.lit(False)
    for x in p:
        wrong = wrong | x.isNull() | F.isnan(x) | (x < 0) | (x > 1)
    wrong = wrong | (F.abs(sum(p[1:], p[0]) - 1) > 1e-3)
    return df.agg(
        (F.count("*") - F.count_distinct(uid)).alias("repeated_ids"),
        F.count_if(~F.coalesce(F.col(stage).isin(0, 1, 2), F.lit(False))).alias("bad_stages"),
        F.count_if(F.coalesce(wrong, F.lit(True))).alias("bad_probabilities"),
    )


def write_predictions(df: DataFrame, path: str, uid: str, position: str = "storage_position") -> str:
    """Predictions as Parquet in the order they were stored, after their contract is checked; a folder is complete when it has _SUCCESS."""
    found = prediction_problems(df, uid).first().asDict()
    if any(found.values()):
        raise ValueError(f"predictions break their contract: {found}")
    df.repartitionByRange(position).sortWithinPartitions(position).write.option("compression", "zstd").parquet(path)
    return path


def write_membership(df: DataFrame, path: str, uid: str) -> dict:
    """Part of each row as Parquet sorted by id; returns counts and an order-free digest."""
    rows = df.select(uid, "split")
    rows.repartitionByRange(uid).sortWithinPartitions(uid).write.parquet(path)
    back = df.sparkSession.read.parquet(path)
    r = back.agg(F.count("*").alias("rows"), F.count_distinct(uid).alias("ids"), F.sum(F.xxhash64(uid, "split").cast("decimal(38,0)")).cast("string").alias("digest")).first()
    if r.rows != r.ids:
        raise ValueError("an id is in the membership more than once")
    return {"rows": r.rows, "digest": r.digest, "parts": {x.split: x["count"] for x in back.groupBy("split").count().collect()}}


def criticality(device, known: Mapping[str, float], default: float = 0.0):
    """Risk of a device, by name, from a configured mapping."""
    if not known:
        return F.lit(float(default))
    table = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(table, device), F.lit(float(default)))
