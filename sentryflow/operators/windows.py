"""The 24 sliding-window device features as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sentryflow.functions.scalars import ack_only, has_flag


def window_features(packets: DataFrame, window_seconds: float = 60.0, max_events: int = 2048) -> DataFrame:
    """One row an event: the last ``max_events`` events of its device, by arrival, that are at most ``window_seconds`` old."""
    by_device = Window.partitionBy("device_id").orderBy("ts_s", "seq")
    first_seen = F.row_number().over(Window.partitionBy("device_id", "destination_ip").orderBy("ts_s", "seq")) == 1
    proto = F.lower(F.trim("protocol"))
    one = F.struct(
        F.col("ts_s").alias("ts"), F.col("length_bytes").alias("len"), proto.alias("proto"), F.col("destination_ip").alias("dst"), F.col("destination_port").alias("port"),
        has_flag(F.col("tcp_flags"), "S", "SYN").alias("syn"), has_flag(F.col("tcp_flags"), "R", "RST").alias("rst"), ack_only(F.col("tcp_flags")).alias("ack"),
        F.col("outbound").alias("out"), F.col("flow_duration_seconds").alias("dur"), F.col("connection_failed").alias("bad"), F.col("__new").alias("new"),
    )
    p = packets.withColumn("__new", first_seen).withColumn("__e", one)
    p = p.withColumn("__w", F.collect_list("__e").over(by_device.rowsBetween(-(max_events - 1), 0)))
    p = p.select("device_id", "seq", "ts_s", F.explode(F.array(F.filter("__w", lambda x: x["ts"] >= F.col("ts_s") - window_seconds))).alias("w"))
    n = F.size("w")

    def share(cond) -> Column:
        return F.size(F.filter("w", cond)) / n

    def distinct(field: str) -> Column:
        return F.size(F.array_distinct(F.transform("w", lambda x: x[field]))) / n

    def total(value) -> Column:
        return F.aggregate("w", F.lit(0.0), lambda a, x: a + value(x))

    ts = F.transform("w", lambda x: x["ts"])
    p = p.withColumn("span", F.element_at(ts, -1) - F.element_at(ts, 1))
    p = p.withColumn("dt", F.when(n >= 2, F.greatest("span", F.lit(1e-3))).otherwise(F.lit(float(window_seconds))))
    p = p.select("*", F.explode(F.array(F.transform("w", lambda x: F.floor(x["ts"])))).alias("secs"))
    peak = F.array_max(F.transform(F.array_distinct("secs"), lambda s: F.size(F.filter("secs", lambda y: y == s))))
    p = p.withColumn("mean_gap", F.when(n >= 2, F.col("span") / (n - 1)).otherwise(0.0))
    gaps = F.zip_with(F.slice(ts, 2, F.greatest(n - 1, F.lit(0))), F.slice(ts, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)
    var = F.aggregate(gaps, F.lit(0.0), lambda a, g: a + (g - F.col("mean_gap")) * (g - F.col("mean_gap")))
    p = p.select("*", F.explode(F.array(F.when(n >= 2, F.sqrt(var / (n - 1))).otherwise(0.0))).alias("jitter"))
    p = p.withColumn("stable", F.when(n >= 2, 1 / (1 + F.col("jitter") / F.greatest("mean_gap", F.lit(1e-6)))).otherwise(0.0))
    out_bytes = total(lambda x: F.when(x["out"], x["len"]).otherwise(0).cast("double"))
    all_bytes = total(lambda x: x["len"].cast("double"))
    features = {
        "packet_rate": n / F.col("dt"),
        "byte_rate": all_bytes / F.col("dt"),
        "burst_score": peak / (n / F.size(F.array_distinct("secs"))),
        "tcp_ratio": share(lambda x: x["proto"] == "tcp"),
        "udp_ratio": share(lambda x: x["proto"] == "udp"),
        "icmp_ratio": share(lambda x: x["proto"] == "icmp"),
        "syn_ratio": share(lambda x: x["syn"]),
        "rst_ratio": share(lambda x: x["rst"]),
        "ack_only_ratio": share(lambda x: x["ack"]),
        "unique_destination_ip_ratio": distinct("dst"),
        "unique_destination_port_ratio": distinct("port"),
        "new_destination_ratio": share(lambda x: x["new"]),
        "repeated_destination_score": 1 - distinct("dst"),
        "repeated_port_score": 1 - distinct("port"),
        "interarrival_mean": F.col("mean_gap"),
        "interarrival_jitter": F.col("jitter"),
        "interarrival_stability": F.col("stable"),
        "periodicity_score": F.when(n >= 4, F.col("stable")).otherwise(0.0),
        "outbound_packet_ratio": share(lambda x: x["out"]),
        "outbound_byte_ratio": out_bytes / F.greatest(all_bytes, F.lit(1.0)),
        "short_flow_ratio": share(lambda x: x["dur"] < 1),
        "long_flow_ratio": share(lambda x: x["dur"] > 30),
        "small_packet_ratio": share(lambda x: x["len"] < 128),
        "failed_connection_score": share(lambda x: x["bad"]),
    }
    return p.select("device_id", "seq", "ts_s", *[v.cast("double").alias(k) for k, v in features.items()])


def out_of_order(packets: DataFrame, ts: str = "ts_s", seq: str = "seq") -> DataFrame:
    """n_late: events whose time is before that of one that arrived earlier on the same device."""
    w = Window.partitionBy("device_id").orderBy(seq)
    return packets.select((F.lag(ts).over(w) > F.col(ts)).alias("late")).agg(F.count_if("late").alias("n_late"))
