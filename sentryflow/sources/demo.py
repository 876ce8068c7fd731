"""A synthetic labelled table of the 24 window features.

Every value is a function of seed, row and draw number (hashes as uniforms), so
the table is the same however it is partitioned, and is made on executors.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sentryflow.streaming.devices import FEATURES

#: Labels with their share and raw name, then distributions of features, then what a label changes.
LABELS = [("benign", 0.67, "benign"), ("scan_like", 0.09, "port_scan"), ("flood_like", 0.11, "udp_flood"), ("beacon_like", 0.05, "periodic_c2"), ("exfil_like", 0.05, "data_exfiltration"), ("unknown_like", 0.03, "novel_lowrate")]
LOGNORMAL = {"packet_rate": (1.6, 0.45), "byte_rate": (5.4, 0.35), "interarrival_mean": (-1.0, 0.5), "interarrival_jitter": (-1.7, 0.6)}
PROTOCOLS = {"tcp_ratio": 5.0, "udp_ratio": 3.0, "icmp_ratio": 0.4}
BETA = {
    "syn_ratio": (1, 15), "rst_ratio": (1, 25), "ack_only_ratio": (2, 8), "unique_destination_ip_ratio": (1.5, 8), "unique_destination_port_ratio": (1.5, 9), "new_destination_ratio": (1.5, 10),
    "repeated_destination_score": (2, 5), "repeated_port_score": (2, 5), "interarrival_stability": (3, 3), "periodicity_score": (1.5, 6), "outbound_packet_ratio": (5, 3), "outbound_byte_ratio": (4, 3),
    "short_flow_ratio": (3, 4), "long_flow_ratio": (1, 10), "small_packet_ratio": (4, 4), "failed_connection_score": (1, 15),
}
SCALED = {
    "scan_like": {"packet_rate": (2, 2)}, "flood_like": {"packet_rate": (12, 30), "byte_rate": (8, 20), "tcp_ratio": (0.2, 0.2)}, "beacon_like": {"interarrival_jitter": (0.08, 0.08)},
    "exfil_like": {"byte_rate": (8, 18)}, "unknown_like": {"interarrival_mean": (5, 5)},
}
REPLACED = {
    "scan_like": {"syn_ratio": (0.55, 0.95), "unique_destination_ip_ratio": (0.6, 1), "unique_destination_port_ratio": (0.55, 1), "new_destination_ratio": (0.65, 1), "short_flow_ratio": (0.7, 1), "failed_connection_score": (0.45, 0.95)},
    "flood_like": {"udp_ratio": (0.7, 1)},
    "beacon_like": {"repeated_destination_score": (0.8, 1), "repeated_port_score": (0.75, 1), "interarrival_stability": (0.85, 1), "periodicity_score": (0.8, 1)},
    "exfil_like": {"outbound_packet_ratio": (0.88, 1), "outbound_byte_ratio": (0.92, 1), "long_flow_ratio": (0.65, 1)},
    "unknown_like": {"periodicity_score": (0.55, 0.78), "new_destination_ratio": (0.45, 0.68), "outbound_byte_ratio": (0.72, 0.9), "failed_connection_score": (0.3, 0.55)},
}
FLOOD_BURST = (4, 10)


class Draws:
    """Random columns; each use of ``uniform`` is a new draw."""

    def __init__(self, seed: int):
        self.seed, self.no = seed, count()

    def uniform(self, lo: float = 0.0, hi: float = 1.0) -> Column:
        h = F.pmod(F.xxhash64("id", F.lit(self.seed), F.lit(next(self.no))), F.lit(1 << 52))
        return lo + (hi - lo) * ((h + 0.5) / float(1 << 52))

    def normal(self) -> Column:
        return F.sqrt(-2 * F.log(self.uniform())) * F.cos(2 * F.pi() * self.uniform())

    def lognormal(self, mean: float, sd: float) -> Column:
        return F.exp(mean + sd * self.normal())

    def gamma(self, shape: float) -> Column:
        """Sums of exponentials; half a squared normal for a half; other shapes under 1 by a power of a uniform."""
        whole, rest = int(shape), shape - int(shape)
        parts = [-F.log(self.uniform()) for _ in range(whole)]
        if rest == 0.5:
            z = self.normal()
            parts.append(z * z / 2)
        elif rest:
            parts.append(-F.log(self.uniform()) * F.pow(self.uniform(), F.lit(1 / rest)))
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return total


def demo(spark: SparkSession, rows: int = 12_000, seed: int = 2309) -> DataFrame:
    """device_id (8, in turn), timestamp (every quarter second), behavior_label, raw_attack and the features as float."""
    if rows < 1000:
        raise ValueError("a demo needs 1,000 rows or more")
    d = Draws(seed)
    label, raw = (F.lit(LABELS[-1][i]) for i in (0, 2))
    for i in reversed(range(len(LABELS) - 1)):
        below = F.col("__u") < sum(share for _, share, _ in LABELS[: i + 1])
        label, raw = F.when(below, LABELS[i][0]).otherwise(label), F.when(below, LABELS[i][2]).otherwise(raw)
    df = spark.range(rows).withColumn("__u", d.uniform())
    df = df.select("id", F.format_string("device_%02d", F.col("id") % 8).alias("device_id"), (1.78e9 + 0.25 * F.col("id")).alias("timestamp"), label.alias("behavior_label"), raw.alias("raw_attack"))
    base = {k: d.lognormal(*v) for k, v in LOGNORMAL.items()} | {f"__{k}": d.gamma(v) for k, v in PROTOCOLS.items()} | {"burst_score": d.gamma(1.5) * 0.5}
    for k, (a, b) in BETA.items():
        if a == 1:
            base[k] = 1 - F.pow(d.uniform(), F.lit(1 / b))
        else:
            base |= {f"__a_{k}": d.gamma(a), f"__b_{k}": d.gamma(b)}
    df = df.withColumns(base)
    mass = sum((F.col(f"__{k}") for k in PROTOCOLS), F.lit(0.0))
    made = {k: F.col(f"__{k}") / mass for k in PROTOCOLS} | {k: F.col(f"__a_{k}") / (F.col(f"__a_{k}") + F.col(f"__b_{k}")) for k, (a, _) in BETA.items() if a != 1}
    df = df.withColumns(made | {"byte_rate": F.col("packet_rate") * F.col("byte_rate")})
    out = {}
    for f in FEATURES:
        c = F.col(f)
        for name, _, _ in LABELS:
            here = F.col("behavior_label") == name
            if f in SCALED.get(name, {}):
                c = F.when(here, F.col(f) * d.uniform(*SCALED[name][f])).otherwise(c)
            if f in REPLACED.get(name, {}):
                c = F.when(here, d.uniform(*REPLACED[name][f])).otherwise(c)
            if f == "burst_score" and name == "flood_like":
                c = F.when(here, F.col(f) + d.uniform(*FLOOD_BURST)).otherwise(c)
        if f != "burst_score" and f.endswith(("ratio", "score", "stability")):
            c = F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
        out[f] = c.cast("float")
    return df.select("device_id", "timestamp", "behavior_label", "raw_attack", *[v.alias(k) for k, v in out.items()])
