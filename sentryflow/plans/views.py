"""The driver's tables seen as packets, scored predictions and labelled features; each view with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sentryflow.staging import table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PROBS = ["benign", "scan_like", "flood_like", "beacon_like", "exfil_like", "unknown_like"]


def events(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.withColumn("ts_s", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def packets(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    t = F.col("event_type")
    return events(spark, sf_dir, read).select(
        F.col("event_id").alias("seq"), F.concat(F.lit("dev_"), F.col("user_id").cast("string")).alias("device_id"), "ts_s",
        (F.floor(F.col("value") * 10).cast("long") + 40).alias("length_bytes"),
        F.when(t == "purchase", "udp").when(t == "signup", "icmp").otherwise("tcp").alias("protocol"),
        F.concat(F.lit("10.0.0."), (F.col("k") % 16).cast("string")).alias("destination_ip"), (F.lit(1000) + F.col("k") % 7).alias("destination_port"),
        F.when(t == "click", "SYN").when(t == "view", "ACK").when(t == "error", "RST").otherwise("").alias("tcp_flags"),
        (F.col("event_id") % 3 != 0).alias("outbound"), (F.col("value") / 10).alias("flow_duration_seconds"), (t == "error").alias("connection_failed"),
    )


def predictions(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    t = F.col("event_type")
    b = events(spark, sf_dir, read).select(
        "event_id", F.concat(F.lit("capture_"), (F.col("user_id") % 5).cast("string")).alias("source_file"),
        F.concat(F.lit("dev_"), F.col("user_id").cast("string")).alias("device_id"), "ts_s", F.col("event_id").alias("sequence_index"),
        F.when(t == "signup", "scan_like").when(t == "error", "flood_like").when(t == "purchase", "exfil_like").otherwise("benign").alias("true_label"),
        (((F.col("event_id") * 7919) % 1000).cast("double") / 1000).alias("u"),
    )
    p = b.withColumn("p_benign", F.when(F.col("true_label") == "benign", 0.4 + 0.5 * F.col("u")).otherwise(0.6 * F.col("u"))).withColumn("r", 1 - F.col("p_benign"))
    r = F.col("r")
    return p.select(
        "event_id", F.sha2(F.concat(F.lit("ev|"), F.col("event_id").cast("string")), 256).alias("row_uid"), "source_file", "device_id", "ts_s", "sequence_index", "true_label",
        F.round("p_benign", 6).alias("prob_benign"), F.round(r * F.when(F.col("true_label") == "scan_like", 0.7).otherwise(0.2), 6).alias("prob_scan_like"),
        F.round(r * F.when(F.col("true_label") == "flood_like", 0.7).otherwise(0.2), 6).alias("prob_flood_like"),
        F.round(r * 0.05, 6).alias("prob_beacon_like"), F.round(r * 0.03, 6).alias("prob_exfil_like"), F.round(r * 0.02, 6).alias("prob_unknown_like"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.col("l_quantity").cast("long").cast("string"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"))
    label = F.when(F.col("l_returnflag") == "A", "benign").when(F.col("l_returnflag") == "N", "scan_like").otherwise("flood_like")
    return li.select(
        F.sha2(key, 256).alias("row_uid"), label.alias("behavior_label"), F.concat(F.lit("sup_"), F.col("l_suppkey").cast("string")).alias("device_id"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / F.lit(1e6)).alias("ts_s"), F.col("l_linestatus").alias("source_file"), F.col("l_orderkey").alias("sequence_index"),
        F.concat_ws("_", "l_linestatus", "l_returnflag").alias("raw_attack"), *FEATURES,
    )


SQL_EVENTS = "ev as (select *, epoch_us(ts)/1e6 as ts_s, cast(json_extract_string(props, '$.k') as int) as k from events)"
SQL_PACKETS = f"""{SQL_EVENTS}, packets as (select event_id as seq, concat('dev_', cast(user_id as varchar)) as device_id, ts_s, cast(floor(value*10) as bigint) + 40 as length_bytes,
  case event_type when 'purchase' then 'udp' when 'signup' then 'icmp' else 'tcp' end as protocol, concat('10.0.0.', cast(k % 16 as varchar)) as destination_ip, 1000 + k % 7 as destination_port,
  case event_type when 'click' then 'SYN' when 'view' then 'ACK' when 'error' then 'RST' else '' end as tcp_flags, event_id % 3 <> 0 as outbound, value/10 as flow_duration_seconds, event_type = 'error' as connection_failed from ev)"""
SQL_PREDICTIONS = f"""{SQL_EVENTS}, b as (select event_id, concat('capture_', cast(user_id % 5 as varchar)) as source_file, concat('dev_', cast(user_id as varchar)) as device_id, ts_s, event_id as sequence_index,
    case event_type when 'signup' then 'scan_like' when 'error' then 'flood_like' when 'purchase' then 'exfil_like' else 'benign' end as true_label, cast((event_id*7919) % 1000 as double)/1000 as u from ev),
  p0 as (select *, case when true_label = 'benign' then 0.4::double + 0.5::double*u else 0.6::double*u end as p_benign from b), q0 as (select *, 1 - p_benign as r from p0),
  predictions as (select event_id, sha256(concat('ev|', cast(event_id as varchar))) as row_uid, source_file, device_id, ts_s, sequence_index, true_label, round(p_benign, 6) as prob_benign,
    round(r*case when true_label='scan_like' then 0.7::double else 0.2::double end, 6) as prob_scan_like, round(r*case when true_label='flood_like' then 0.7::double else 0.2::double end, 6) as prob_flood_like,
    round(r*0.05::double, 6) as prob_beacon_like, round(r*0.03::double, 6) as prob_exfil_like, round(r*0.02::double, 6) as prob_unknown_like from q0)"""
SQL_FEATURES = """features as (select sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint), strftime(l_shipdate, '%Y-%m-%d'), cast(round(l_extendedprice*100) as bigint))) as row_uid,
  case l_returnflag when 'A' then 'benign' when 'N' then 'scan_like' else 'flood_like' end as behavior_label, concat('sup_', cast(l_suppkey as varchar)) as device_id, epoch_us(l_shipdate)/1e6 as ts_s,
  l_linestatus as source_file, l_orderkey as sequence_index, concat_ws('_', l_linestatus, l_returnflag) as raw_attack, l_quantity, l_extendedprice, l_discount, l_tax from lineitem)"""
