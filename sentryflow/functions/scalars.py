"""Row-level expressions: tokens, labels, flags, hashes and missing values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sentryflow.functions import constants as K


def normalize_token(c: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one underscore, none at the ends; ``unknown`` if nothing is left."""
    t = F.regexp_replace(F.lower(F.trim(c.cast("string"))), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.btrim(t, F.lit("_")), F.lit("")), F.lit("unknown"))


def _first_rule(token: Column, rules, default) -> Column:
    out = F.lit(default)
    for value, pattern in reversed(rules):
        out = F.when(token.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def device_behavior(raw: Column) -> Column:
    """Label of a device-directory source from its attack name."""
    t = normalize_token(raw)
    return F.when(t.isin("benign", "normal", "benign_traffic"), "benign").when((t == "scan") | t.endswith("_scan"), "scan_like").otherwise("flood_like")


def flow_behavior(category: Column, subcategory: Column) -> Column:
    """Label of a flow record from its category and subcategory; the first rule that is met decides."""
    return _first_rule(normalize_token(F.concat_ws("_", category, F.coalesce(subcategory, F.lit("")))), K.FLOW_RULES, K.UNKNOWN)


def canonical_behavior(label: Column) -> Column:
    t = normalize_token(label)
    pairs = [F.lit(x) for kv in K.LABEL_ALIASES.items() for x in kv]
    t = F.coalesce(F.element_at(F.create_map(*pairs), t), t)
    return F.when(t.isin(K.LABELS), t).otherwise(K.UNKNOWN)


def feature_cost(name: Column) -> Column:
    return _first_rule(normalize_token(name), K.FEATURE_COSTS, K.DEFAULT_FEATURE_COST)


def flag_tokens(flags: Column) -> Column:
    return F.filter(F.split(F.upper(F.coalesce(flags, F.lit(""))), "[^A-Z0-9]+"), lambda t: t != "")


def has_flag(flags: Column, short: str, long: str) -> Column:
    return F.exists(flag_tokens(flags), lambda t: t.isin(short, long) | ((F.length(t) <= 2) & t.contains(short)))


def ack_only(flags: Column) -> Column:
    s = F.array_distinct(flag_tokens(flags))
    return (F.size(s) == 1) & F.element_at(s, 1).isin("A", "ACK")


def as_bool(c: Column, default: bool) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "outbound", "out"), F.lit(default))


def missing(c: Column) -> Column:
    """NaN and infinities as null."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def seeded_rank(seed, uid: Column) -> Column:
    """SHA-256 of seed, a zero byte and the row's id: the order of samples and splits."""
    return F.sha2(F.concat(F.lit(str(seed)), F.lit("\0"), uid.cast("string")), 256)


def row_uid(algorithm: str, source_id: Column, index: Column) -> Column:
    """SHA-256 over canonical JSON of algorithm, row index and source id."""
    return F.sha2(F.concat(F.lit(f'{{"algorithm":"{algorithm}","row_index":'), index.cast("string"), F.lit(',"source_id":"'), source_id, F.lit('"}')), 256)


def redact_url(url: Column) -> Column:
    """Without credentials, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, "^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1"), "[?#].*$", "")


def array_of(*columns) -> Column:
    return F.array(*[F.col(c) if isinstance(c, str) else c for c in columns])


def argmax_label(probs: Column, labels=K.LABELS) -> Column:
    """The first label of those with the largest probability."""
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(probs, F.array_max(probs)).cast("int"))
