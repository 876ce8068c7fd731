"""Registered queries of the engine's own operators, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sentryflow.functions import constants as K, scalars as S
from sentryflow.operators import calibrate, metrics, split, stats, temporal, transform, windows
from sentryflow.plans import views as V
from sentryflow.sources import inspect, tables
from sentryflow.staging import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WINDOW = 604_800.0


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(c: str | Column, name: str | None = None) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def probs() -> Column:
    return F.array(*[F.col(f"prob_{x}") for x in V.PROBS])


_PROB_LIST = "[" + ", ".join(f"prob_{x}" for x in V.PROBS) + "]"
_LABELS = "[" + ", ".join(f"'{x}'" for x in V.PROBS) + "]"
_ARGMAX = f"list_extract({_LABELS}, list_position({_PROB_LIST}, list_max({_PROB_LIST})))"
_TOKEN = "coalesce(nullif(trim(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown')"
_LONG = "long as (select row_uid, behavior_label, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) as feature, unnest([0, 1, 2, 3]) as ordinal, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) as value from features)"


# --- scalar functions -------------------------------------------------------

@query("b1_normalize_token", f"select p_partkey, {_TOKEN.format('p_name')} as name_token, {_TOKEN.format('p_type')} as type_token from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", S.normalize_token(F.col("p_name")).alias("name_token"), S.normalize_token(F.col("p_type")).alias("type_token"))


@query("b2_b4_labels", f"""
with x as (select distinct event_type, case event_type when 'click' then 'Mirai Scan' when 'view' then 'Benign Traffic' when 'error' then 'udp-flood' when 'signup' then 'Normal' else 'SCAN' end as raw,
  case event_type when 'click' then 'Reconnaissance' when 'view' then 'Normal' when 'error' then 'DDoS' when 'signup' then 'Theft' else 'c2' end as category from events),
t as (select *, {_TOKEN.format('raw')} as rt, {_TOKEN.format("category || '_TCP'")} as ct, {_TOKEN.format('raw')} as kt from x)
select event_type, case when rt in ('benign','normal','benign_traffic') then 'benign' when rt = 'scan' or rt like '%\\_scan' escape '\\' then 'scan_like' else 'flood_like' end as device_behavior,
  case when regexp_matches(ct, 'normal|benign') then 'benign' when regexp_matches(ct, 'scan|reconnaissance|fingerprint') then 'scan_like' when regexp_matches(ct, 'ddos|dos|flood') then 'flood_like'
       when regexp_matches(ct, 'exfil|theft|keylog') then 'exfil_like' when regexp_matches(ct, 'beacon|c2|command_control') then 'beacon_like' else 'unknown_like' end as flow_behavior,
  case kt when 'normal' then 'benign' when 'scan' then 'scan_like' when 'flood' then 'flood_like' when 'benign' then 'benign' else 'unknown_like' end as canonical from t""")
def _(spark, d):
    t = F.col("event_type")
    pick = lambda *v: F.when(t == "click", v[0]).when(t == "view", v[1]).when(t == "error", v[2]).when(t == "signup", v[3]).otherwise(v[4])
    x = table(spark, d, "events").select("event_type").distinct()
    raw, cat = pick("Mirai Scan", "Benign Traffic", "udp-flood", "Normal", "SCAN"), pick("Reconnaissance", "Normal", "DDoS", "Theft", "c2")
    return x.select("event_type", S.device_behavior(raw).alias("device_behavior"), S.flow_behavior(cat, F.lit("TCP")).alias("flow_behavior"), S.canonical_behavior(raw).alias("canonical"))


@query("b6_b7_flags", f"""
with {V.SQL_PACKETS}
select seq, tcp_flags = 'SYN' as syn, tcp_flags = 'RST' as rst, tcp_flags = 'ACK' as ack_only, coalesce(lower(trim(cast(outbound as varchar))) in ('1','true','yes','outbound','out'), false) as outbound from packets""")
def _(spark, d):
    f = F.col("tcp_flags")
    return V.packets(spark, d).select("seq", S.has_flag(f, "S", "SYN").alias("syn"), S.has_flag(f, "R", "RST").alias("rst"), S.ack_only(f).alias("ack_only"), S.as_bool(F.col("outbound"), False).alias("outbound"))


@query("b22_s13_row_identity", """
select event_id, sha256('2309' || chr(0) || cast(event_id as varchar)) as rank, sha256('{"algorithm":"sha256-v1","row_index":' || cast(event_id as varchar) || ',"source_id":"' || event_type || '"}') as row_uid from events""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", S.seeded_rank(2309, F.col("event_id")).alias("rank"), S.row_uid("sha256-v1", F.col("event_type"), F.col("event_id")).alias("row_uid"))


# --- sources -----------------------------------------------------------------

@query("s6_s8_inference", f"""
with t as (select cast(unnest([cast(event_id as varchar), event_type, cast(value as varchar), props]) as varchar) as v, unnest(['event_id','event_type','value','props']) as col from events)
select col as feature, max(case when try_cast(v as double) is not null then 1 else 0 end) = 1 as is_numeric, avg(case when try_cast(v as double) is not null then 1.0 else 0.0 end) >= 0.95 as numeric_time from t group by col""")
def _(spark, d):
    text = table(spark, d, "events").select(*[F.col(c).cast("string") for c in ("event_id", "event_type", "value", "props")])
    known = tables.numeric_features(text)
    times = {c: (F.avg(tables.number(F.col(c)).isNotNull().cast("double")) >= tables.NUMERIC_SHARE).alias(c) for c in text.columns}
    r = text.agg(*times.values()).first()
    return spark.createDataFrame([(c, c in known, r[c]) for c in text.columns], "feature string, is_numeric boolean, numeric_time boolean")


def inspected_events(spark, d) -> DataFrame:
    """Events as text rows of which some break each rule."""
    e, i = table(spark, d, "events"), F.col("event_id")
    rows = e.select(
        "event_id", (i % 11 != 0).alias("fits"), F.when(i % 7 == 0, "  ").when(F.col("event_type") == "error", "DDoS").when(F.col("event_type") == "signup", "Theft").otherwise("Normal").alias("category"),
        F.when(i % 13 == 0, F.lit(None)).otherwise(F.concat(F.lit(" dev_"), (F.col("user_id") % 50).cast("string"))).alias("saddr"),
        F.when(i % 41 == 0, "n/a").when(i % 19 == 0, "Infinity").otherwise(F.col("value").cast("string")).alias("stime"),
    )
    return inspect.inspected(rows, "category", "saddr", "stime", fits="fits")


_INSPECTED = """x as (select event_id, event_id % 11 <> 0 as fits, case when event_id % 7 = 0 then '  ' when event_type = 'error' then 'DDoS' when event_type = 'signup' then 'Theft' else 'Normal' end as category,
  case when event_id % 13 = 0 then null else concat('dev_', cast(user_id % 50 as varchar)) end as device, event_id % 41 = 0 as not_time, event_id % 19 = 0 as endless from events),
share as (select avg((not not_time)::int) >= 0.95 as numeric_time from x),
y as (select x.*, case when not fits then 'column_count_mismatch' when trim(category) = '' then 'invalid_label' when device is null then 'invalid_device'
  when numeric_time and (not_time or endless) then 'invalid_timestamp' when not numeric_time then 'unclear' end as reason from x, share)"""


@query("s20_inspect", f"with {_INSPECTED} select coalesce(reason, 'accepted') as reason, count(*) as rows from y group by 1")
def _(spark, d):
    rows = inspected_events(spark, d)
    return inspect.reason_counts(rows).withColumn("reason", F.when(F.col("reason") == "", None).otherwise(F.col("reason")))


@query("s20_a24_class_devices", f"with {_INSPECTED} select case category when 'DDoS' then 'flood_like' when 'Theft' then 'exfil_like' else 'benign' end as behavior, device, count(*) as rows from y where reason is null group by 1, 2")
def _(spark, d):
    return inspect.class_device_counts(inspected_events(spark, d))


@query("s20_rejected_samples", f"with {_INSPECTED} select event_id, reason from y where reason is not null order by event_id limit 32")
def _(spark, d):
    return inspect.rejected_samples(inspected_events(spark, d), ["event_id"]).select("event_id", "reason")


@query("s7_feature_union", """
select event_id, cast(value as double) as value, cast(null as double) as price, 'events' as origin from events union all by name
select o_orderkey as event_id, cast(null as double) as value, cast(o_totalprice as double) as price, 'orders' as origin from orders""")
def _(spark, d):
    a = table(spark, d, "events").select("event_id", F.lit("events").alias("origin"), F.col("value").cast("double"))
    b = table(spark, d, "orders").select(F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderkey").alias("EVENT_ID"), F.lit("orders").alias("origin"))
    return inspect.union_features([a, b], ["event_id", "origin"])


@query("s9_row_budget", "select count(*) as rows from events")
def _(spark, d):
    e = table(spark, d, "events")
    return inspect.within_budget(e, 100_000_000).agg(F.count("*").alias("rows"))


@query("w14_class_cap", """
with x as (select event_id, event_type, row_number() over (partition by event_type order by sha256('2309' || chr(0) || cast(event_id as varchar)), event_id) as r from events)
select event_type, count(*) as rows, min(event_id) as first_id, max(event_id) as last_id from x where r <= 700 group by 1""")
def _(spark, d):
    c = inspect.capped(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 700)
    return c.groupBy("event_type").agg(F.count("*").alias("rows"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("s19_global_order", f"with {V.SQL_PACKETS}, l as (select ts_s < lag(ts_s) over (order by seq) as late from packets) select count(*) filter (where late) as n_late from l")
def _(spark, d):
    return inspect.out_of_order_rows(V.packets(spark, d), "seq", "ts_s")


@query("s13_content_ids", "select event_id, sha256(concat_ws(chr(31), 'v' || event_type, 'v' || cast(user_id as varchar))) as content_id from events")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "user_id")
    return e.select("event_id", inspect.content_id(e, ["event_type", "user_id"]).alias("content_id"))


@query("b25_redaction", "select distinct 'https://example.org/' || event_type as url from events")
def _(spark, d):
    u = table(spark, d, "events").select(F.concat(F.lit("https://user:secret@example.org/"), "event_type", F.lit("?token="), F.col("user_id").cast("string")).alias("raw"))
    return u.select(S.redact_url(F.col("raw")).alias("url")).distinct()


@query("w12_w13_sample_caps", """
with x as (select *, row_number() over (partition by event_type order by sha256('2309' || chr(0) || cast(event_id as varchar)), event_id) as r from events)
select event_type, event_id, r from x where r <= 50""")
def _(spark, d):
    return inspect.capped(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 50).select("event_type", "event_id", F.col("r").cast("long").alias("r"))


# --- statistics and preprocessing -------------------------------------------

@query("a3_finite_counts", f"with {V.SQL_FEATURES}, {_LONG} select feature, count(value) as finite, count(*) - count(value) as missing from long group by feature")
def _(spark, d):
    return stats.finite_counts(V.features(spark, d), V.FEATURES)


@query("a9_quantiles", f"with {V.SQL_FEATURES}, {_LONG} select feature, round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.5), 6) as q50, round(quantile_cont(value, 0.75), 6) as q75 from long group by feature")
def _(spark, d):
    q = stats.quantiles(V.features(spark, d), V.FEATURES, [0.25, 0.5, 0.75])
    return q.select("feature", *[r6(F.col("q")[i], f"q{p}") for i, p in enumerate((25, 50, 75))])


_MOMENTS = "mo as (select feature, ordinal, behavior_label, count(value) as n, avg(cast(cast(value as float) as double)) as mean, var_pop(cast(cast(value as float) as double)) * count(value) as m2 from long group by all)"
_SCORES = """gr as (select *, sum(n*mean) over (partition by feature) / sum(n) over (partition by feature) as grand from mo),
sc as (select feature, ordinal, count(*) as k, sum(n) as n, sum(n*(mean-grand)*(mean-grand)) as ssb, sum(m2) as ssw from gr group by feature, ordinal),
fs as (select feature, ordinal, coalesce(case when n > k then (ssb/nullif(k-1,0))/nullif(ssw/nullif(n-k,0),0) end, 0) as f_score, (ssb+ssw)/n as variance from sc)"""


@query("a4_class_moments", f"with {V.SQL_FEATURES}, {_LONG}, {_MOMENTS} select feature, behavior_label, n, round(mean, 4) as mean, round(m2/n, 2) as var from mo")
def _(spark, d):
    return stats.class_moments(V.features(spark, d), V.FEATURES, "behavior_label").select("feature", "behavior_label", "n", F.round("mean", 4).alias("mean"), F.round(F.col("m2") / F.col("n"), 2).alias("var"))


@query("a5_a7_feature_ranking", f"with {V.SQL_FEATURES}, {_LONG}, {_MOMENTS}, {_SCORES} select feature, round(f_score, 4) as f_score, row_number() over (order by f_score desc, ordinal) as rank from fs")
def _(spark, d):
    s = stats.f_scores(stats.class_moments(V.features(spark, d), V.FEATURES, "behavior_label"), "behavior_label")
    return stats.rank_features(s).select("feature", F.round("f_score", 4).alias("f_score"), F.col("rank").cast("long").alias("rank"))


@query("a8_class_weights", f"with {V.SQL_FEATURES}, c as (select behavior_label, count(*) as n from features group by 1), w as (select *, sum(n) over () / (count(*) over () * n) as raw from c) select behavior_label, round(raw / avg(raw) over (), 6) as weight from w")
def _(spark, d):
    return stats.class_weights(V.features(spark, d), "behavior_label").select("behavior_label", r6("weight"))


@query("a10_a11_sketch", """
with s as (select event_id, value from events order by sha256('7' || chr(0) || cast(event_id as varchar)), event_id limit 2000)
select count(*) as kept, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.9), 6) as q90, round(least(1.0, sqrt(ln(2/0.05)/(2*count(value)))), 6) as bound from s""")
def _(spark, d):
    s = stats.bottom_k(table(spark, d, "events").select("event_id", "value"), "event_id", S.seeded_rank(7, F.col("event_id")), 2000)
    return s.agg(F.count("*").alias("kept"), r6(F.percentile("value", F.lit(0.5)), "median"), r6(F.percentile("value", F.lit(0.9)), "q90"), r6(stats.dkw(F.count("value")), "bound"))


@query("b9_b11_transform", f"""
with {V.SQL_FEATURES}, s as (select quantile_cont(l_quantity, 0.5) as m, quantile_cont(l_quantity, 0.25) as a, quantile_cont(l_quantity, 0.75) as b, quantile_cont(l_extendedprice, 0.5) as em, quantile_cont(l_extendedprice, 0.25) as ea, quantile_cont(l_extendedprice, 0.75) as eb from features)
select row_uid, round((l_quantity - m) / (b - a), 6) as quantity, round((l_extendedprice - em) / (eb - ea), 6) as price, case when (l_quantity - m) / (b - a) >= 0 then 1.0::double else -1.0::double end as sign_bit,
  list_position(['benign', 'scan_like'], behavior_label) as label_place from features, s""")
def _(spark, d):
    f = V.features(spark, d)
    st = transform.feature_stats(f, V.FEATURES[:2])
    q, p = (transform.scaled(c, st[c]) for c in V.FEATURES[:2])
    place = F.array_position(F.array(F.lit("benign"), F.lit("scan_like")), F.col("behavior_label"))
    return f.select("row_uid", r6(q, "quantity"), r6(p, "price"), F.element_at(transform.encode(q, "sign", [], 0.0), 1).alias("sign_bit"), F.nullif(place, F.lit(0)).cast("int").alias("label_place"))


@query("b14_b15_open_set", f"""
with {V.SQL_PREDICTIONS}, x as (select *, [prob_benign, prob_scan_like, prob_flood_like, prob_beacon_like, prob_exfil_like] as p, abs(prob_benign - 0.6::double) + abs(prob_scan_like - 0.1::double) as dist from predictions),
y as (select *, list_max(p) as top, 1/(1+exp(-4*(dist/0.3::double-1))) * greatest(0, least(1, (0.6::double - list_max(p))/0.6::double)) as u0 from x), z as (select *, least(0.999::double, greatest(0, u0)) as u from y)
select event_id, top < 0.6 and dist >= 0.3 as is_unknown, round(u, 6) as unknown_share, round(prob_benign*(1-u) / greatest(list_sum(p)*(1-u)+u, 1e-12), 6) as benign_out from z""")
def _(spark, d):
    known = F.array(*[F.col(f"prob_{x}") for x in K.KNOWN_LABELS])
    p = V.predictions(spark, d).withColumn("dist", F.abs(F.col("prob_benign") - 0.6) + F.abs(F.col("prob_scan_like") - 0.1)).withColumn("p", known)
    unknown, full = transform.open_set(F.col("p"), F.col("dist"), 0.3, 0.6)
    top = F.array_max("p")
    u = F.least(F.lit(0.999), F.greatest(F.lit(0.0), 1 / (1 + F.exp(-4 * (F.col("dist") / 0.3 - 1))) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (0.6 - top) / 0.6))))
    return p.select("event_id", unknown.alias("is_unknown"), r6(u, "unknown_share"), r6(F.element_at(full, 1), "benign_out"))


# --- splits and set operations -------------------------------------------------

def _quota_sql(target: str) -> str:
    return f"(select behavior_label, floor(n*{target}/t) + case when row_number() over (order by (n*{target}) % t desc, behavior_label) <= {target} - sum(floor(n*{target}/t)) over () then 1 else 0 end as q from c)"


_SPLIT = f"""with {V.SQL_EVENTS}, d as (select event_id, case event_type when 'signup' then 'scan_like' when 'error' then 'flood_like' else 'benign' end as behavior_label, user_id, ts_s, event_type from ev),
c as (select behavior_label, count(*) as n, cast(sum(count(*)) over () as bigint) as t, cast(floor(sum(count(*)) over () * 0.70::double) as bigint) as tr, cast(floor(sum(count(*)) over () * 0.15::double) as bigint) as va from d group by 1),
qt as {_quota_sql('tr')}, qv as {_quota_sql('va')},
rk as (select d.*, row_number() over (partition by behavior_label order by sha256('2309' || chr(0) || cast(event_id as varchar)), event_id) as i from d),
sp as (select rk.*, case when i <= qt.q then 'train' when i <= qt.q + qv.q then 'validation' else 'test' end as split from rk join qt using (behavior_label) join qv using (behavior_label))"""


def labelled_events(spark, d) -> DataFrame:
    t = F.col("event_type")
    label = F.when(t == "signup", "scan_like").when(t == "error", "flood_like").otherwise("benign")
    return V.events(spark, d).select("event_id", label.alias("behavior_label"), "user_id", "ts_s", "event_type")


@query("p5_p6_split_random", _SPLIT + " select event_id, behavior_label, split from sp")
def _(spark, d):
    return split.split_random(labelled_events(spark, d), "event_id", "behavior_label").select("event_id", "behavior_label", "split")


@query("a1_a2_split_counts", _SPLIT + " select behavior_label, split, count(*) as rows, count(distinct user_id) as devices from sp group by 1, 2")
def _(spark, d):
    return split.part_counts(split.split_random(labelled_events(spark, d), "event_id", "behavior_label"), "behavior_label", "user_id")


@query("j4_device_overlap", _SPLIT + " select user_id from sp where split = 'train' intersect select user_id from sp where split = 'test' order by user_id limit 100")
def _(spark, d):
    s = split.split_random(labelled_events(spark, d), "event_id", "behavior_label")
    return split.overlap(s, "user_id").orderBy("user_id").limit(100)


@query("j5_row_leakage", _SPLIT + " select count(*) as leaked from (select event_id from sp group by event_id having count(distinct split) > 1)")
def _(spark, d):
    return split.leaked(split.split_random(labelled_events(spark, d), "event_id", "behavior_label"), "event_id").agg(F.count("*").alias("leaked"))


@query("p7_split_device", f"""with {V.SQL_EVENTS}, h as (select *, user_id = (select max(user_id) from ev) as held from ev), k as (select count(*) as n, cast(floor(count(*) * 0.15::double / (0.70::double + 0.15::double)) as bigint) as v from h where not held),
r as (select event_id, row_number() over (order by sha256('2309' || chr(0) || cast(event_id as varchar)), event_id) - 1 as i from h where not held)
select event_id, case when i < n - v then 'train' else 'validation' end as split from r, k union all select event_id, 'test' from h where held""")
def _(spark, d):
    return split.split_device(V.events(spark, d).select("event_id", "user_id"), "event_id", "user_id").select("event_id", "split")


@query("p8_split_attack", f"""with {V.SQL_EVENTS}, d0 as (select event_id, case event_type when 'signup' then 'scan_like' when 'error' then 'flood_like' else 'benign' end as behavior_label, event_type from ev),
h as (select *, event_type = (select max(event_type) from d0 where behavior_label <> 'benign') as held from d0), d as (select * from h where not held),
c as (select behavior_label, count(*) as n, cast(sum(count(*)) over () as bigint) as t, cast(floor(sum(count(*)) over () * 0.70::double) as bigint) as tr, cast(floor(sum(count(*)) over () * 0.15::double) as bigint) as va from d group by 1),
qt as {_quota_sql('tr')}, qv as {_quota_sql('va')}, rk as (select d.*, row_number() over (partition by behavior_label order by sha256('2309' || chr(0) || cast(event_id as varchar)), event_id) as i from d)
select event_id, behavior_label, case when i <= qt.q then 'train' when i <= qt.q + qv.q then 'validation' else 'test' end as split from rk join qt using (behavior_label) join qv using (behavior_label)
union all select event_id, 'unknown_like', 'test' from h where held""")
def _(spark, d):
    return split.split_attack(labelled_events(spark, d), "event_id", "behavior_label", "event_type").select("event_id", "behavior_label", "split")


@query("p9_split_time", f"""with {V.SQL_EVENTS}, r as (select event_id, row_number() over (order by ts_s, event_id) - 1 as i, count(*) over () as n from ev)
select event_id, case when i < floor(n*0.70::double) then 'train' when i < floor(n*0.70::double) + floor(n*0.15::double) then 'validation' else 'test' end as split from r""")
def _(spark, d):
    return split.split_time(V.events(spark, d).select("event_id", "ts_s"), "event_id", "ts_s").select("event_id", "split")


@query("p10_split_sequence", f"""with {V.SQL_PREDICTIONS}, r as (select event_id, source_file, row_number() over (partition by source_file order by sequence_index) - 1 as i, count(*) over (partition by source_file) as n from predictions)
select event_id, source_file, case when i < floor(n*0.70::double) then 'train' when i < floor(n*0.70::double) + floor(n*0.15::double) then 'validation' else 'test' end as split from r""")
def _(spark, d):
    return split.split_sequence(V.predictions(spark, d), "source_file", "sequence_index").select("event_id", "source_file", "split")


@query("p2_set_equality", "with a as (select user_id, event_type from events), b as (select user_id, event_type from events where value < 50) select (select count(*) from (select * from a except all select * from b)) as only_a, (select count(*) from (select * from b except all select * from a)) as only_b")
def _(spark, d):
    a = table(spark, d, "events").select("user_id", "event_type")
    b = table(spark, d, "events").where("value < 50").select("user_id", "event_type")
    return split.difference(a, b)


@query("p4_uniqueness", "select o_custkey, count(*) as n from orders group by 1 having count(*) > 1")
def _(spark, d):
    return split.repeated_keys(table(spark, d, "orders"), "o_custkey")


@query("j1_j6_membership", """
with m as (select o_orderkey, o_orderstatus as label from orders), s as (select distinct l_orderkey as o_orderkey from lineitem), a as (select o_orderkey, label from m where o_orderkey in (select o_orderkey from s))
select count(*) filter (where m.o_orderkey is null) as extra, count(*) filter (where a.o_orderkey is null) as missing, count(*) filter (where m.label <> a.label) as mismatched from m full outer join a on m.o_orderkey = a.o_orderkey""")
def _(spark, d):
    m = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label"))
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return split.coverage(m, m.join(s, "o_orderkey", "left_semi"), "o_orderkey", ["label"])


@query("j7_feature_costs", """
with f as (select unnest(['packet_rate','byte_rate','unique_destination_ip_ratio','interarrival_jitter','interarrival_mean','syn_ratio','other']) as feature),
c as (select feature, case when regexp_matches(feature, 'destination|unique|cardinality|sketch') then 1.0::double when regexp_matches(feature, 'period|jitter|interarrival|repeated') then 0.8::double when regexp_matches(feature, 'mean|std|variance|covariance|radius') then 0.6::double
  when regexp_matches(feature, 'byte|packet|count|rate|ratio|flag') then 0.3::double else 0.5::double end as cost from f) select feature, round(cost / avg(cost) over (), 6) as cost from c""")
def _(spark, d):
    names = ["packet_rate", "byte_rate", "unique_destination_ip_ratio", "interarrival_jitter", "interarrival_mean", "syn_ratio", "other"]
    c = spark.createDataFrame([(n,) for n in names], "feature string").withColumn("c", S.feature_cost(F.col("feature")))
    return c.select("feature", r6(F.col("c") / F.avg("c").over(Window.partitionBy()), "cost"))


# --- windows and state ---------------------------------------------------------

def rounded_features(f: DataFrame) -> DataFrame:
    coarse = {"interarrival_mean", "interarrival_jitter"}
    return f.select("device_id", "seq", *[F.round(c, 3 if c in coarse else 6).alias(c) for c in f.columns[3:]])


@query("w2_window_features", f"""
with {V.SQL_PACKETS}, nw as (select *, row_number() over (partition by device_id, destination_ip order by ts_s, seq) = 1 as is_new from packets),
pr as (select a.device_id, a.seq, a.ts_s as now_s, b.* exclude (device_id, seq), b.seq as bseq, b.ts_s - lag(b.ts_s) over (partition by a.device_id, a.seq order by b.ts_s, b.seq) as gap
       from nw a join nw b on a.device_id = b.device_id and b.ts_s >= a.ts_s - {WINDOW} and (b.ts_s < a.ts_s or (b.ts_s = a.ts_s and b.seq <= a.seq))),
bu as (select device_id, seq, max(c) as peak, count(*) as secs from (select device_id, seq, floor(ts_s) as s, count(*) as c from pr group by 1, 2, 3) group by 1, 2),
g as (select device_id, seq, count(*) as n, sum(length_bytes) as bytes, case when count(*) >= 2 then greatest(max(ts_s) - min(ts_s), 1e-3) else {WINDOW} end as dt, case when count(*) >= 2 then (max(ts_s)-min(ts_s))/(count(*)-1) else 0 end as mg,
  coalesce(stddev_pop(gap), 0) as jt, avg((protocol='tcp')::int) as tcp, avg((protocol='udp')::int) as udp, avg((protocol='icmp')::int) as icmp, avg((tcp_flags='SYN')::int) as syn, avg((tcp_flags='RST')::int) as rst, avg((tcp_flags='ACK')::int) as ack,
  count(distinct destination_ip)/count(*) as dst, count(distinct destination_port)/count(*) as port, avg(is_new::int) as nd, avg(outbound::int) as ob, sum(case when outbound then length_bytes else 0 end)/greatest(sum(length_bytes),1) as obb,
  avg((flow_duration_seconds<1)::int) as sf, avg((flow_duration_seconds>30)::int) as lf, avg((length_bytes<128)::int) as sp, avg(connection_failed::int) as cf from pr group by 1, 2)
select device_id, seq, round(n/dt, 6) as packet_rate, round(bytes/dt, 6) as byte_rate, round(peak/(n/secs), 6) as burst_score, round(tcp, 6) as tcp_ratio, round(udp, 6) as udp_ratio, round(icmp, 6) as icmp_ratio, round(syn, 6) as syn_ratio, round(rst, 6) as rst_ratio,
  round(ack, 6) as ack_only_ratio, round(dst, 6) as unique_destination_ip_ratio, round(port, 6) as unique_destination_port_ratio, round(nd, 6) as new_destination_ratio, round(1-dst, 6) as repeated_destination_score, round(1-port, 6) as repeated_port_score,
  round(mg, 3) as interarrival_mean, round(jt, 3) as interarrival_jitter, round(case when n >= 2 then 1/(1+jt/greatest(mg, 1e-6)) else 0 end, 6) as interarrival_stability, round(case when n >= 4 then 1/(1+jt/greatest(mg, 1e-6)) else 0 end, 6) as periodicity_score,
  round(ob, 6) as outbound_packet_ratio, round(obb, 6) as outbound_byte_ratio, round(sf, 6) as short_flow_ratio, round(lf, 6) as long_flow_ratio, round(sp, 6) as small_packet_ratio, round(cf, 6) as failed_connection_score
from g join bu using (device_id, seq)""")
def _(spark, d):
    return rounded_features(windows.window_features(V.packets(spark, d), WINDOW))


@query("w1_window_counts", f"with {V.SQL_PACKETS} select a.seq, count(*) as n, sum(b.length_bytes) as bytes from packets a join packets b on a.device_id = b.device_id and b.ts_s >= a.ts_s - {WINDOW} and (b.ts_s < a.ts_s or (b.ts_s = a.ts_s and b.seq <= a.seq)) group by a.seq")
def _(spark, d):
    p = V.packets(spark, d)
    w = Window.partitionBy("device_id").orderBy("ts_s", "seq").rowsBetween(-2047, 0)
    p = p.select("seq", "ts_s", F.collect_list(F.struct("ts_s", "length_bytes")).over(w).alias("w"))
    p = p.select("seq", F.explode(F.array(F.filter("w", lambda x: x["ts_s"] >= F.col("ts_s") - WINDOW))).alias("w"))
    return p.select("seq", F.size("w").cast("long").alias("n"), F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["length_bytes"]).alias("bytes"))


@query("h8_out_of_order", f"with {V.SQL_PACKETS}, l as (select ts_s < lag(ts_s) over (partition by device_id order by seq) as late from packets) select count(*) filter (where late) as n_late from l")
def _(spark, d):
    return windows.out_of_order(V.packets(spark, d))


@query("w6_w7_episodes", f"""with {V.SQL_PREDICTIONS}, r as (select *, row_number() over w as i, true_label <> 'benign' as a, coalesce(lag(true_label <> 'benign') over w, false) as pa from predictions window w as (partition by source_file, device_id order by ts_s, event_id)),
e as (select *, sum((a and not pa)::int) over (partition by source_file, device_id order by i) as episode from r)
select source_file, device_id, episode, count(*) as length, min(case when prob_benign < 0.3 then i end) - min(i) as delay_rows, round(min(case when prob_benign < 0.3 then ts_s end) - min(ts_s), 3) as delay_seconds from e where a group by 1, 2, 3""")
def _(spark, d):
    p = V.predictions(spark, d).withColumn("action_level", F.when(F.col("prob_benign") < 0.3, 2).otherwise(0))
    e = metrics.episodes(p, ["source_file", "device_id"], ["ts_s", "event_id"], "ts_s")
    return e.select("source_file", "device_id", "episode", "length", F.col("delay_rows").cast("long").alias("delay_rows"), F.round("delay_seconds", 3).alias("delay_seconds"))


_FOLD = f"""{V.SQL_PREDICTIONS}, o as (select *, row_number() over (partition by source_file, device_id order by ts_s, event_id) as i from predictions),
f as (select source_file, device_id, event_id, i, ts_s as since, greatest(0, least(15, case when prob_scan_like >= 0.45 then 2 else -1 end)) as sc, greatest(0, least(15, case when prob_flood_like >= 0.45 then 2 else -1 end)) as fl,
  greatest(0, least(15, case when prob_beacon_like >= 0.45 then 2 else -1 end)) as be, greatest(0, least(15, case when prob_unknown_like >= 0.45 then 2 else -1 end)) as un, greatest(0, least(15, case when prob_benign >= 0.45 then 2 else -1 end)) as bn from o where i = 1
 union all select o.source_file, o.device_id, o.event_id, o.i, f.since + 60 * greatest(0, floor((o.ts_s - f.since) / 60)), """ + ", ".join(
    f"greatest(0, least(15, cast(f.{c} + case when o.prob_{p} >= 0.45 then 2 else -1 end - greatest(0, floor((o.ts_s - f.since) / 60)) as int)))" for c, p in (("sc", "scan_like"), ("fl", "flood_like"), ("be", "beacon_like"), ("un", "unknown_like"), ("bn", "benign"))
) + " from f join o on o.source_file = f.source_file and o.device_id = f.device_id and o.i = f.i + 1)"


def replayed(spark, d) -> DataFrame:
    p = V.predictions(spark, d)
    states = temporal.replay(p, ["source_file", "device_id"], ["ts_s", "event_id"], "ts_s")
    return temporal.with_risk(p.join(states.select("event_id", *[f"state_{c}" for c in temporal.COUNTERS]), "event_id"), "prob_benign")


@query("h3_h4_temporal_replay", f"""with recursive {_FOLD}, x as (select f.*, p.prob_benign, greatest(0, least(1, 0.55::double*(1-prob_benign)+0.13::double*sc/15+0.13::double*fl/15+0.10::double*be/15+0.14::double*un/15-0.08::double*bn/15)) as risk from f join predictions p using (event_id))
select event_id, sc as state_scan, fl as state_flood, be as state_beacon, un as state_unknown, bn as state_benign, round(risk, 6) as risk_score, (risk>=0.18)::int+(risk>=0.30)::int+(risk>=0.44)::int+(risk>=0.60)::int+(risk>=0.78)::int as action_level from x""")
def _(spark, d):
    return replayed(spark, d).select("event_id", *[f"state_{c}" for c in temporal.COUNTERS], r6("risk_score"), "action_level")


@query("a25_operational", f"""with recursive {_FOLD}, x as (select f.*, p.prob_benign, p.true_label, {_ARGMAX} as pl, greatest(0, least(1, 0.55::double*(1-prob_benign)+0.13::double*sc/15+0.13::double*fl/15+0.10::double*be/15+0.14::double*un/15-0.08::double*bn/15)) as risk from f join predictions p using (event_id)),
y as (select *, risk >= 0.30 as alert, risk >= 0.44 as mit, true_label <> 'benign' as att from x)
select count(*) as rows, count(*) filter (where alert) as alerts, count(*) filter (where mit) as mitigations, round(avg(att::int) filter (where mit), 6) as action_precision, round(avg(mit::int) filter (where not att), 6) as benign_disruption_rate,
  round(1 - avg(alert::int), 6) as reduction_vs_every_row, round(avg(mit::int) filter (where att) * 0.25, 6) as sensitivity_25, round(avg(mit::int) filter (where att) * 0.5, 6) as sensitivity_50, round(avg(mit::int) filter (where att) * 0.75, 6) as sensitivity_75,
  count(*) filter (where pl <> 'benign') as stateless_alerts, round(1 - count(*) filter (where alert) / nullif(count(*) filter (where pl <> 'benign'), 0), 6) as reduction_vs_stateless, round(avg((pl <> 'benign')::int) filter (where att), 6) as stateless_recall,
  round(avg(alert::int) filter (where true_label like '%flood%' or true_label like '%beacon%'), 6) as low_rate_recall, round(avg(alert::int), 6) as alert_rate, round(avg(mit::int), 6) as mitigation_rate, round(avg(att::int) filter (where alert), 6) as alert_precision, round(avg(alert::int) filter (where att), 6) as alert_recall, round(avg(mit::int) filter (where att), 6) as mitigation_recall, round(avg(alert::int) filter (where not att), 6) as false_alert_rate from y""")
def _(spark, d):
    p = replayed(spark, d).withColumn("pl", S.argmax_label(probs(), V.PROBS))
    o = metrics.operational(p.withColumn("raw", F.when(F.col("true_label").rlike("flood|beacon"), "slow one").otherwise("other")), pred="pl", raw="raw")
    counts = {"rows", "alerts", "mitigations", "stateless_alerts"}
    return o.select(*[F.col(c) if c in counts else r6(c) for c in o.columns])


@query("a27_device_hours", f"with {V.SQL_PREDICTIONS}, s as (select greatest((max(ts_s)-min(ts_s))/3600, 1/3600.0::double) as h from predictions group by source_file, device_id) select round(sum(h), 4) as device_hours from s")
def _(spark, d):
    return metrics.device_hours(V.predictions(spark, d), ["source_file", "device_id"], "ts_s").select(F.round("device_hours", 4).alias("device_hours"))


def cascade_input(spark, d) -> DataFrame:
    return V.predictions(spark, d).withColumn("p_tiny", F.col("prob_benign")).withColumn("boolean", F.col("prob_benign") > 0.88)


@query("h6_cascade_stateless", f"with {V.SQL_PREDICTIONS} select event_id, round(case when prob_benign > 0.88 then 1.0::double else prob_benign - (1 - prob_benign) - 0.1::double end, 6) as exit_score, case when prob_benign > 0.88 then 0 when prob_benign - (1 - prob_benign) - 0.1::double >= 0.5 then 1 else 2 end as exit_stage from predictions")
def _(spark, d):
    r = temporal.route(cascade_input(spark, d), ["source_file", "device_id"], ["ts_s", "event_id"], "ts_s", threshold=0.5, use_state=False)
    return r.select("event_id", r6("exit_score"), "exit_stage")


@query("a28_a29_routing_summary", f"with {V.SQL_PREDICTIONS}, s as (select case when prob_benign > 0.88 then 0 when prob_benign - (1 - prob_benign) - 0.1::double >= 0.5 then 1 else 2 end as st from predictions) select round(avg((st=0)::int), 6) as boolean_share, round(avg((st=1)::int), 6) as tiny_share, round(avg((st=2)::int), 6) as main_share, round(10 + 100*avg((st>=1)::int) + 1000*avg((st=2)::int), 4) as average_operations, round(1 - (10 + 100*avg((st>=1)::int) + 1000*avg((st=2)::int)) / 1100, 6) as reduction from s")
def _(spark, d):
    r = temporal.route(cascade_input(spark, d), ["source_file", "device_id"], ["ts_s", "event_id"], "ts_s", threshold=0.5, use_state=False)
    m = metrics.routing_summary(r, (10, 100, 1000))
    return m.select(*[r6(c) for c in ("boolean_share", "tiny_share", "main_share", "reduction")], F.round("average_operations", 4).alias("average_operations"))


# --- metrics and calibration -----------------------------------------------------

def scored(spark, d) -> DataFrame:
    return V.predictions(spark, d).withColumn("predicted_label", S.argmax_label(probs(), V.PROBS)).withColumn("confidence", F.array_max(probs()))


_SCORED = f"{V.SQL_PREDICTIONS}, sc as (select *, {_ARGMAX} as predicted_label, list_max({_PROB_LIST}) as confidence from predictions)"
_PER_CLASS = f"""{_SCORED}, l as (select true_label as label from sc union select predicted_label from sc),
pc as (select label, (select count(*) from sc where true_label = label and predicted_label = label) as tp, (select count(*) from sc where true_label = label) as support, (select count(*) from sc where predicted_label = label) as predicted from l),
pr as (select *, coalesce(tp/nullif(predicted,0), 0) as p, coalesce(tp/nullif(support,0), 0) as r from pc), pf as (select *, coalesce(2*p*r/nullif(p+r,0), 0) as f1 from pr)"""


@query("a12_confusion", f"with {_SCORED} select true_label, predicted_label, count(*) as count from sc group by 1, 2")
def _(spark, d):
    return metrics.confusion(scored(spark, d))


@query("a13_per_class", f"with {_PER_CLASS} select label, support, round(p, 6) as precision, round(r, 6) as recall, round(f1, 6) as f1 from pf")
def _(spark, d):
    return metrics.per_class(metrics.confusion(scored(spark, d))).select("label", "support", r6("precision"), r6("recall"), r6("f1"))


@query("a14_summary", f"""with {_PER_CLASS}, a as (select sum(tp)::double as c, sum(support)::double as s, sum(support*predicted)::double as st, sum(predicted*predicted)::double as pp, sum(support*support)::double as tt, avg(r) filter (where support > 0) as ba, avg(p) as mp, avg(r) as mr, avg(f1) as mf from pf)
select round(c/s, 6) as accuracy, round(ba, 6) as balanced_accuracy, round(mp, 6) as macro_precision, round(mr, 6) as macro_recall, round(mf, 6) as macro_f1, round((c*s-st)/(sqrt(s*s-pp)*sqrt(s*s-tt)), 6) as mcc from a""")
def _(spark, d):
    s = metrics.summary(metrics.per_class(metrics.confusion(scored(spark, d))))
    return s.select(*[r6(c) for c in s.columns])


@query("a15_false_negatives", f"with {_SCORED} select round(avg((predicted_label = 'benign')::int) filter (where true_label in ('scan_like','flood_like','exfil_like','unknown_like')), 6) as high_risk_fnr, avg((predicted_label = 'unknown_like')::int) filter (where true_label = 'unknown_like') as unknown_recall from sc")
def _(spark, d):
    m = metrics.false_negatives(scored(spark, d))
    return m.select(r6("high_risk_fnr"), "unknown_recall")


@query("a16_brier", f"with {V.SQL_PREDICTIONS} select round(avg(" + "+".join(f"(prob_{x}-(true_label='{x}')::int)*(prob_{x}-(true_label='{x}')::int)" for x in V.PROBS) + "), 6) as brier from predictions")
def _(spark, d):
    return V.predictions(spark, d).agg(r6(F.avg(metrics.brier(probs(), F.col("true_label"), V.PROBS)), "brier"))


@query("a17_ece", f"with {_SCORED}, e as (select unnest({[lo for lo, _ in K.ECE_EDGES]}::double[]) as lo, unnest({[hi for _, hi in K.ECE_EDGES]}::double[]) as hi, unnest(range(10)) as b), j as (select b, count(*) as m, avg(confidence) as cf, avg((true_label = predicted_label)::int) as ac from sc join e on confidence >= lo and (confidence < hi or (b = 9 and confidence <= hi)) group by b) select round(sum(m * abs(ac - cf)) / (select count(*) from sc), 6) as ece from j")
def _(spark, d):
    s = scored(spark, d).withColumn("correct", F.col("true_label") == F.col("predicted_label"))
    return metrics.calibration_error(s, "confidence", "correct").select(r6("ece"))


@query("a18_auroc_ap", f"""with {V.SQL_PREDICTIONS}, l as (select unnest({_LABELS}) as label, unnest({_PROB_LIST}) as score, true_label from predictions), g as (select label, score, sum((true_label = label)::int) as pos, sum((true_label <> label)::int) as neg from l group by 1, 2),
c as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by label) as p, sum(neg) over (partition by label) as n from g window w as (partition by label order by score desc))
select label, round(sum(neg*(2*tp-pos)/2.0::double/(p*n)), 6) as auroc, round(sum(pos/p*tp/(tp+fp)), 6) as average_precision from c where p > 0 and n > 0 group by label""")
def _(spark, d):
    rows = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"prob_{x}").alias("score"), (F.col("true_label") == x).alias("positive")) for x in V.PROBS])
    m = metrics.ranking_metrics(V.predictions(spark, d).select(F.inline(rows)))
    return m.select("label", r6("auroc"), r6("average_precision"))


@query("a19_a20_fixed_fpr", f"""with {V.SQL_PREDICTIONS}, s as (select true_label = 'benign' as b, 1 - prob_benign as score from predictions), t as (select unnest([0.01::double, 0.001::double]) as target), n as (select count(*) as n from s where b),
r as (select score, row_number() over (order by score desc) as i from s where b), e as (select target, (select score from r where i = least(floor(target*n+1e-12)+1, n)) as edge from t, n)
select target, round(edge, 6) as boundary, round(avg((score > edge)::int) filter (where not b), 6) as attack_recall, round(avg((score > edge)::int) filter (where b), 6) as observed_fpr from s, e group by 1, 2""")
def _(spark, d):
    s = V.predictions(spark, d).select((F.col("true_label") == "benign").alias("b"), (1 - F.col("prob_benign")).alias("score"))
    edges = [(t, metrics.fixed_fpr_boundary(s.where("b"), "score", t)) for t in (0.01, 0.001)]
    out = s.select("b", "score", F.inline(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(e).cast("double").alias("edge")) for t, e in edges])))
    hit = (F.col("score") > F.col("edge")).cast("double")
    return out.groupBy("target", r6("edge", "boundary")).agg(r6(F.avg(F.when(~F.col("b"), hit)), "attack_recall"), r6(F.avg(F.when(F.col("b"), hit)), "observed_fpr"))


@query("w16_fast_path_sweep", f"""with {V.SQL_PREDICTIONS}, g as (select unnest(range(50)) as i), q as (select round(0.5 + 0.01*i, 2)::double as q, quantile_cont(prob_scan_like, round(0.5+0.01*0, 2)) as x from g, predictions where true_label = 'benign' group by i),
t as (select unnest(list_transform(range(50), lambda i: round(0.5::double + 0.01::double*i, 2))) as q, unnest((select quantile_cont(prob_scan_like, {[round(0.5 + 0.01 * i, 2) for i in range(50)]}) from predictions where true_label = 'benign')) as ts, unnest((select quantile_cont(prob_flood_like, {[round(0.5 + 0.01 * i, 2) for i in range(50)]}) from predictions where true_label = 'benign')) as tf)
select q, round(avg((prob_scan_like <= ts and prob_flood_like <= tf)::int) filter (where true_label = 'benign'), 6) as benign_exit, round(avg((not (prob_scan_like <= ts and prob_flood_like <= tf))::int) filter (where true_label <> 'benign'), 6) as attack_recall from predictions, t group by q""")
def _(spark, d):
    s = calibrate.fast_path_sweep(V.predictions(spark, d), ["prob_scan_like", "prob_flood_like"], F.col("true_label") == "benign", 0.995)
    return s.select("q", r6("benign_exit"), r6("attack_recall"))


@query("w18_confidence_sweep", f"""with {_SCORED}, k as (select confidence as p, 1 - prob_benign >= 0.3::double as far from sc), g as (select unnest({[round(0.05 + 0.005 * i, 3) for i in range(189)]}::double[]) as confidence)
select g.confidence, round(avg((p < g.confidence and far)::int), 6) as rate from k, g group by 1""")
def _(spark, d):
    s = scored(spark, d).withColumn("distance", 1 - F.col("prob_benign"))
    return calibrate.confidence_sweep(s, "confidence", "distance", 0.3).select("confidence", r6("rate"))


@query("a22_ordered_digest", "with h as (select distinct sha256(cast(user_id as varchar)) as h from events), l as (select substr(h, 1, 3) as p, count(*) as n, sha256(string_agg(h, chr(10) order by h)) as leaf from h group by 1) select cast(sum(n) as bigint) as n, sha256(string_agg(leaf, chr(10) order by p)) as digest from l")
def _(spark, d):
    return stats.ordered_digest(table(spark, d, "events").select(F.sha2(F.col("user_id").cast("string"), 256).alias("h")).distinct(), "h")


@query("a32_attack_prior", f"with {V.SQL_PREDICTIONS}, c as (select true_label, count(*) as n from predictions where true_label <> 'benign' group by 1) select true_label, round(n / sum(n) over (), 6) as prior from c")
def _(spark, d):
    return metrics.attack_prior(V.predictions(spark, d)).select("true_label", r6("prior"))


@query("k1_shard_layout", f"with {V.SQL_FEATURES} select source_file, behavior_label, count(*) as rows, min(row_uid) as first_uid, max(row_uid) as last_uid from features group by 1, 2")
def _(spark, d):
    from sentryflow.sources.shards import read_shards, write_shards

    root = write_shards(V.features(spark, d), ["source_file", "behavior_label"], ["source_file", "sequence_index", "row_uid"])
    return read_shards(spark, root).groupBy("source_file", "behavior_label").agg(F.count("*").alias("rows"), F.min("row_uid").alias("first_uid"), F.max("row_uid").alias("last_uid"))


@query("l7_batch_inference")
def _(spark, d):
    from sentryflow.operators.models import fit_logistic, predict

    f = V.features(spark, d)
    parts = split.split_random(f, "row_uid", "behavior_label")
    model = fit_logistic(parts.where("split = 'train'"), V.FEATURES, "behavior_label")
    return predict(model, parts.where("split = 'test'")).select("row_uid", "behavior_label", "predicted_label")


@query("l1_binary_forward", f"with {V.SQL_PREDICTIONS}, x as (select event_id, [case when prob_benign >= 0.5 then 1 else -1 end, case when prob_scan_like >= 0.2 then 1 else -1 end, case when prob_flood_like >= 0.2 then 1 else -1 end] as v from predictions), h as (select event_id, case when v[1]-v[2]-v[3] >= 0 then 1 else -1 end as h1, case when -v[1]+v[2]+v[3] >= 0 then 1 else -1 end as h2 from x) select event_id, (h1-h2)::double as logit_benign, (h2-h1)::double as logit_attack from h")
def _(spark, d):
    from sentryflow.operators.models import binary_layer, sign

    p = V.predictions(spark, d)
    x = F.array(sign(F.col("prob_benign") - 0.5), sign(F.col("prob_scan_like") - 0.2), sign(F.col("prob_flood_like") - 0.2))
    h = F.transform(binary_layer(x, [[1, -1, -1], [-1, 1, 1]]), sign)
    o = p.select("event_id", F.explode(F.array(h)).alias("h")).select("event_id", binary_layer(F.col("h"), [[1, -1], [-1, 1]]).alias("o"))
    return o.select("event_id", F.col("o")[0].alias("logit_benign"), F.col("o")[1].alias("logit_attack"))
