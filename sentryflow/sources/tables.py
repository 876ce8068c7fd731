"""CSV sources: header rules, roles of columns, numeric features, times, and the three labelled layouts.

Files of one call share a header (Spark checks each against it and fails on
another).  All columns are read as text and typed by one aggregation, so a source
is scanned twice, never collected; what reaches the driver is one row a call, or
the header.

Defined cases: a cell that is no number is null in a feature; infinities are kept
as ``missing`` treats them downstream; a column with no number at all is no
feature; a null label is ``unknown_like``; an empty table has no features and fails.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sentryflow.functions.scalars import as_bool, canonical_behavior, device_behavior, flow_behavior, normalize_token

#: Files beside the data that hold no rows of it, and the column names tried for a role, in order.
SIDECARS = {"nbaiot": {"demonstrate_structure.csv"}, "botiot": {"data_names.csv"}}
ROLES = {
    "label": ["category", "label", "attack"],
    "raw": ["subcategory", "attack", "category"],
    "device": ["saddr", "srcip", "device_id"],
    "time": ["stime", "timestamp", "time"],
}
PACKET_COLUMNS = ["device_id", "timestamp", "length_bytes", "protocol", "destination_ip", "destination_port"]
PASSED_ON = ["behavior_label", "raw_attack", "flow_id", "capture_id"]
NUMERIC_SHARE = 0.95


def column_key(name: str) -> str:
    return unicodedata.normalize("NFC", name.strip().removeprefix("\ufeff").strip()).casefold()


def normalize_columns(names: Iterable[str], source: str = "input") -> list[str]:
    """Stripped NFC names; control characters, empty names and names equal but for case are errors."""
    out: dict[str, str] = {}
    for raw in map(str, names):
        if any(unicodedata.category(ch) == "Cc" and ord(ch) < 128 for ch in raw):
            raise ValueError(f"{source}: control character in column {raw!r}")
        name = unicodedata.normalize("NFC", raw.removeprefix("\ufeff").strip())
        if not name or name.casefold() in out:
            raise ValueError(f"{source}: {'repeated' if name else 'empty'} column {raw!r}")
        out[name.casefold()] = name
    if not out:
        raise ValueError(f"{source}: no header")
    return list(out.values())


def is_sidecar(kind: str, filename: str) -> bool:
    return filename.strip().casefold() in SIDECARS.get(kind, ())


def resolve_role(columns: Iterable[str], role: str, preferred: str | None = None) -> str | None:
    by_key = {column_key(c): c for c in columns}
    return next((by_key[k] for k in map(column_key, filter(None, [preferred, *ROLES[role]])) if k in by_key), None)


def read_csv(spark: SparkSession, path: str | list[str], kind: str = "csv") -> DataFrame:
    """All columns as text under normalised names, and ``source_path``."""
    df = spark.read.options(header=True, inferSchema=False, enforceSchema=False, mode="FAILFAST").csv(path, recursiveFileLookup=True, pathGlobFilter="*.[cC][sS][vV]")
    named = df.select(*[F.col(f"`{old}`").alias(new) for old, new in zip(df.columns, normalize_columns(df.columns, str(path)))], F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("source_path"))
    skip = sorted(SIDECARS.get(kind, ()))
    return named.where(~F.lower(F.element_at(F.split("source_path", "/"), -1)).isin(skip)) if skip else named


def number(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def numeric_features(df: DataFrame, drop: Iterable[str] = ()) -> list[str]:
    """Columns in which at least one value is a number, in their order."""
    gone = {column_key(c) for c in drop}
    names = [c for c in df.columns if column_key(c) not in gone]
    if not names:
        return []
    found = df.agg(*[F.max(number(F.col(f"`{c}`")).isNotNull()).alias(str(i)) for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if found[i]]


def epoch_seconds(df: DataFrame, column: str, by: str = "source_path") -> DataFrame:
    """Adds ``ts_s``: numbers as they are where 95 % of a file's rows are numbers, else parsed as UTC times; what is neither is null."""
    c = F.col(f"`{column}`")
    share = df.groupBy(by).agg((F.count(number(c)) >= NUMERIC_SHARE * F.count("*")).alias("__numeric"))
    parsed = F.unix_micros(c.try_cast("timestamp")) / 1e6
    return df.join(share, by).withColumn("ts_s", F.when(F.col("__numeric"), number(c)).otherwise(parsed)).drop("__numeric")


def _typed(df: DataFrame, meta: dict[str, Column], drop: Iterable[str]) -> DataFrame:
    features = numeric_features(df, [*drop, "source_path", "ts_s"])
    if not features:
        raise ValueError("no numeric feature")
    taken = [c for c in features if column_key(c) not in {column_key(m) for m in meta}]
    return df.select(*[v.alias(k) for k, v in meta.items()], *[number(F.col(f"`{c}`")).cast("float").alias(c) for c in taken])


def device_directories(spark: SparkSession, root: str) -> DataFrame:
    """``<device>/<family>_attacks/<type>.csv`` and ``<device>/benign_traffic.csv``: labels from paths; no time."""
    df = read_csv(spark, root, "nbaiot")
    below = F.split(F.substring_index(F.col("source_path"), root.rstrip("/").split("://")[-1] + "/", -1), "/")
    stem = F.regexp_replace(F.element_at(below, -1), r"(?i)\.csv$", "")
    family = F.regexp_replace(F.element_at(below, -2), "_attacks$", "")
    raw = F.when(F.lower(stem).contains("benign"), "benign").when(F.size(below) > 1, F.concat_ws("_", family, stem)).otherwise(stem)
    raw = normalize_token(raw)
    meta = {
        "source_path": F.col("source_path"),
        "device_id": F.when(F.size(below) > 1, F.element_at(below, 1)).otherwise("source_root"),
        "raw_attack": raw,
        "behavior_label": device_behavior(raw),
    }
    return _typed(df, meta, [])


def flow_records(spark: SparkSession, path: str | list[str], overrides: dict[str, str] | None = None, preferred: dict[str, str] | None = None) -> DataFrame:
    """Flow records with category and subcategory; ``overrides`` maps normalised raw names, then categories, to labels."""
    df, like = read_csv(spark, path, "botiot"), preferred or {}
    role = {r: resolve_role(df.columns, r, like.get(r)) for r in ROLES}
    if role["label"] is None:
        raise ValueError("no label column")
    if role["time"]:
        df = epoch_seconds(df, role["time"])
    category, raw = (F.col(f"`{role[r] or role['label']}`") for r in ("label", "raw"))
    label = flow_behavior(category, raw)
    if overrides:
        known = F.create_map(*[F.lit(x) for k, v in overrides.items() for x in (k, v)])
        label = F.coalesce(F.try_element_at(known, normalize_token(raw)), F.try_element_at(known, normalize_token(category)), label)
    stem = F.regexp_replace(F.element_at(F.split("source_path", "/"), -1), r"(?i)\.csv$", "")
    device = F.col(f"`{role['device']}`") if role["device"] else F.concat(F.lit("source_"), stem)
    meta = {"source_path": F.col("source_path"), "device_id": device, "ts_s": F.col("ts_s") if role["time"] else F.lit(None).cast("double"), "raw_attack": normalize_token(raw), "behavior_label": label}
    return _typed(df, meta, filter(None, role.values()))


def labelled_records(spark: SparkSession, path: str | list[str], label: str, device: str | None = None, time: str | None = None, raw: str | None = None) -> DataFrame:
    """Any labelled CSV, with the names of its role columns."""
    df = read_csv(spark, path)
    by_key = {column_key(c): c for c in df.columns}
    if lost := [c for c in (label, device, time, raw) if c and column_key(c) not in by_key]:
        raise ValueError(f"no column {lost}")
    label, device, time, raw = (by_key[column_key(c)] if c else None for c in (label, device, time, raw))
    if time:
        df = epoch_seconds(df, time)
    meta = {
        "source_path": F.col("source_path"),
        "device_id": F.col(f"`{device}`") if device else F.lit("unknown"),
        "ts_s": F.col("ts_s") if time else F.lit(None).cast("double"),
        "raw_attack": normalize_token(F.col(f"`{raw or label}`")),
        "behavior_label": canonical_behavior(F.col(f"`{label}`")),
    }
    return _typed(df, meta, filter(None, [label, device, time, raw]))


def packet_records(df: DataFrame) -> DataFrame:
    """Packet metadata as text (batch or stream) to the columns of the window operators; a time that is no number is an error."""
    names = set(df.columns)
    if lost := [c for c in PACKET_COLUMNS if c not in names]:
        raise ValueError(f"no column {lost}")
    given = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in names else F.lit(d)
    seq = F.col("seq").cast("long") if "seq" in names else F.monotonically_increasing_id()
    return df.select(
        seq.alias("seq"), F.col("device_id").cast("string"), F.col("timestamp").cast("double").alias("ts_s"), F.col("length_bytes").cast("double").cast("long").alias("length_bytes"), "protocol", "destination_ip",
        F.col("destination_port").cast("double").cast("int").alias("destination_port"), given("tcp_flags", "").alias("tcp_flags"), as_bool(given("outbound", "true"), True).alias("outbound"),
        F.coalesce(given("flow_duration_seconds", "0").try_cast("double"), F.lit(0.0)).alias("flow_duration_seconds"), as_bool(given("connection_failed", "false"), False).alias("connection_failed"),
        *[c for c in PASSED_ON if c in names],
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, bytes, time of change and SHA-256 of each file (a file is read whole by one task)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))
