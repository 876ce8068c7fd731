"""Registered queries of splits, contracts, sinks, encoders, rules and evaluation, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentryflow.operators import calibrate, metrics, split, stats, temporal, transform
from sentryflow.plans import contracts, views as V
from sentryflow.plans.catalog import _PER_CLASS, _PROB_LIST, _LABELS, _SPLIT, cascade_input, labelled_events, query, r6, scored
from sentryflow.staging import new_path, table

_RANK = "sha256('2309' || chr(0) || cast({0} as varchar))"


def random_split(spark, d):
    return split.split_random(labelled_events(spark, d), "event_id", "behavior_label")


# --- splits and membership ------------------------------------------------------

@query("p11_split_block", f"""with b as (select event_id, event_type, event_type || '::' || cast(cast(floor(event_id / 50) as bigint) as varchar) as k from events), u as (select distinct k from b),
r as (select k, row_number() over (order by {_RANK.format('k')}, k) - 1 as i, count(*) over () as n from u)
select event_id, case when i < ceil(n * (1 - (0.70::double + 0.15::double))) then 'test' when i < ceil(n * (1 - (0.70::double + 0.15::double))) + ceil(n * 0.15::double) then 'validation' else 'train' end as split from b join r using (k)""")
def _(spark, d):
    return split.split_block(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 50).select("event_id", "split")


@query("p12_split_cross", f"""with k as (select count(*) as n, cast(floor(count(*) * 0.15::double / (0.70::double + 0.15::double)) as bigint) as v from events where user_id % 3 <> 0),
r as (select event_id, row_number() over (order by {_RANK.format('event_id')}, event_id) - 1 as i from events where user_id % 3 <> 0)
select event_id, case when i < n - v then 'train' else 'validation' end as split from r, k union all select event_id, 'test' from events where user_id % 3 = 0""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id")
    shared = contracts.shared_schema(["event_id", "user_id"], ["event_id", "user_id"], ["event_id"], "events-v1", "events-v1")
    return split.split_cross(e.where("user_id % 3 <> 0").select(*shared), e.where("user_id % 3 = 0").select(*shared), "event_id")


@query("p13_split_manifest", _SPLIT + """ select 'random' as strategy, count(*) filter (where split = 'train') as train_rows, count(*) filter (where split = 'validation') as validation_rows, count(*) filter (where split = 'test') as test_rows,
  count(distinct user_id) filter (where split = 'train') as train_devices, count(*) filter (where split = 'train' and behavior_label = 'scan_like') as train_scans, true as natural_distribution, false as temporal_continuity from sp""")
def _(spark, d):
    m = split.manifest(random_split(spark, d), "random", "event_id", "behavior_label", "user_id")
    row = (m["strategy"], m["rows"]["train"], m["rows"]["validation"], m["rows"]["test"], m["devices"]["train"], m["class_counts"]["train"].get("scan_like", 0), m["natural_evaluation_distribution"], m["temporal_continuity"])
    return spark.createDataFrame([row], "strategy string, train_rows long, validation_rows long, test_rows long, train_devices long, train_scans long, natural_distribution boolean, temporal_continuity boolean")


@query("p14_label_domain", "select event_type as label, count(*) as rows from events where event_type not in ('benign','scan_like','flood_like','beacon_like','exfil_like','unknown_like') group by 1")
def _(spark, d):
    return contracts.foreign_labels(table(spark, d, "events").select(F.col("event_type").alias("label")), "label")


@query("a2_source_coverage", _SPLIT + " select event_type, count(*) filter (where split = 'train') as train, count(*) filter (where split = 'validation') as validation, count(*) filter (where split = 'test') as test, count(*) as rows from sp group by 1")
def _(spark, d):
    return split.source_coverage(random_split(spark, d), "event_type")


@query("a2_coverage_equality", "select event_type, count(*) as rows, count(*) - 1 as expected from events where event_type = 'click' group by 1")
def _(spark, d):
    c = split.source_coverage(random_split(spark, d), "event_type")
    e = table(spark, d, "events").groupBy("event_type").agg((F.count("*") - (F.col("event_type") == "click").cast("long")).alias("rows"))
    return split.coverage_differs(c, e, "event_type")


@query("j2_j3_members", _SPLIT + " select e.event_id, e.value from events e join sp using (event_id) where split = 'validation'")
def _(spark, d):
    return split.members(table(spark, d, "events").select("event_id", "value"), random_split(spark, d), "event_id", "validation")


@query("j8_device_criticality", "select distinct user_id, case user_id when 1 then 0.9::double when 2 then 0.4::double else 0.1::double end as risk from events")
def _(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    return u.select("user_id", contracts.criticality(F.concat(F.lit("dev_"), F.col("user_id").cast("string")), {"dev_1": 0.9, "dev_2": 0.4}, 0.1).alias("risk"))


@query("h9_batch_plan", """with r as (select event_id, event_type, row_number() over (partition by event_type order by event_id) as i, count(*) over (partition by event_type) as n from events)
select event_id, cast(floor((i - 1) / 37) + case when n % 37 = 1 and n > 1 and i = n - 1 then 1 else 0 end as bigint) as batch from r""")
def _(spark, d):
    return split.batch_plan(table(spark, d, "events").select("event_id", "event_type"), "event_type", ["event_id"], 37).select("event_id", "batch")


# --- sinks ------------------------------------------------------------------------

@query("k3_materialised_columns", "select * from (values ('l_tax', 0), ('l_quantity', 1), ('l_discount', 2)) t(name, place)")
def _(spark, d):
    columns, _ = contracts.materialised_columns(table(spark, d, "lineitem").columns, ["l_tax", "l_quantity"], ["l_quantity", "l_discount", "absent"])
    return spark.createDataFrame(list(zip(columns, range(len(columns)))), "name string, place int")


@query("k4_membership", _SPLIT + " select split, count(*) as rows from sp group by 1")
def _(spark, d):
    m = contracts.write_membership(random_split(spark, d), new_path(spark, "membership"), "event_id")
    return spark.createDataFrame(sorted(m["parts"].items()), "split string, rows long")


@query("k5_predictions", f"with {V.SQL_PREDICTIONS} select event_id, case when prob_benign > 0.88 then 0 when prob_benign - (1 - prob_benign) - 0.1::double >= 0.5 then 1 else 2 end as exit_stage, round(prob_benign, 6) as prob_benign from predictions")
def _(spark, d):
    p = cascade_input(spark, d)
    r = temporal.route(p, ["source_file", "device_id"], ["ts_s", "event_id"], "ts_s", threshold=0.5, use_state=False).select("event_id", "exit_stage")
    full = p.join(r, "event_id").withColumn("storage_position", F.col("event_id"))
    rest = sum((F.col(f"prob_{x}") for x in V.PROBS[1:-1]), F.col("prob_benign"))
    path = contracts.write_predictions(full.withColumn("prob_unknown_like", F.greatest(F.lit(0.0), 1 - rest)), new_path(spark, "predictions"), "event_id")
    return spark.read.parquet(path).select("event_id", "exit_stage", r6("prob_benign"))


# --- statistics, encoders, rules -----------------------------------------------------

@query("a6_variance", f"with {V.SQL_FEATURES} select 'l_quantity' as feature, round(var_pop(cast(cast(l_quantity as float) as double)), 4) as variance from features union all select 'l_tax', round(var_pop(cast(cast(l_tax as float) as double)), 4) from features")
def _(spark, d):
    s = stats.f_scores(stats.class_moments(V.features(spark, d), ["l_quantity", "l_tax"], "behavior_label"), "behavior_label")
    return s.select("feature", F.round("variance", 4).alias("variance"))


@query("a21_exact_sum", "select event_type, sum(value::decimal(38,6))::double as total from events group by 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(stats.exact_sum(F.round("value", 6)).alias("total"))


@query("a23_extremes", "select min(event_id) as min_event_id, max(event_id) as max_event_id, min(event_type) as min_event_type, max(event_type) as max_event_type, count(distinct event_type) as distinct_event_type, min(user_id) as min_user_id, max(user_id) as max_user_id, count(distinct user_id) as distinct_user_id from events")
def _(spark, d):
    return stats.extremes(table(spark, d, "events"), "event_id", "event_type", "user_id")


@query("b11_encoders", f"""with {V.SQL_FEATURES}, t as (select quantile_cont(l_quantity, [0.25, 0.5, 0.75]) as q, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) as p from features)
select row_uid, case when l_quantity >= q[1] then 1 else -1 end::double as t1, case when l_quantity >= q[2] then 1 else -1 end::double as t2, case when l_quantity >= q[3] then 1 else -1 end::double as t3,
  round(2.0::double * ((l_extendedprice >= p[1])::int + (l_extendedprice >= p[2])::int + (l_extendedprice >= p[3])::int) / 3 - 1, 6) as hybrid from features, t""")
def _(spark, d):
    f = V.features(spark, d)
    q, p = transform.encoder_thresholds(f, ["l_quantity"], "thermometer", 3)["l_quantity"], transform.encoder_thresholds(f, ["l_extendedprice"], "hybrid", 2)["l_extendedprice"]
    t, h = transform.encode(F.col("l_quantity"), "thermometer", q, q[1]), transform.encode(F.col("l_extendedprice"), "hybrid", p, p[1])
    return f.select("row_uid", *[F.element_at(t, i + 1).alias(f"t{i + 1}") for i in range(3)], r6(F.element_at(h, 1), "hybrid"))


@query("b12_input_groups", "select unnest([0, 1, 2, 3, 4, 5]) as encoded, unnest([0, 0, 0, 1, 1, 1]) as feature")
def _(spark, d):
    groups = transform.input_groups(["l_quantity", "l_tax", "l_discount"], "thermometer", 3)
    return spark.createDataFrame([(i, groups[i]) for i in transform.encoded_of_first(groups, 2)], "encoded int, feature int")


@query("b16_full_probabilities", f"with {V.SQL_PREDICTIONS}, x as (select *, prob_benign + prob_flood_like + prob_unknown_like as t from predictions) select event_id, round(prob_benign / t, 6) as p_benign, 0.0::double as p_scan, round(prob_flood_like / t, 6) as p_flood, round(prob_unknown_like / t, 6) as p_unknown from x")
def _(spark, d):
    p = V.predictions(spark, d)
    full = transform.full_probabilities(F.array("prob_benign", "prob_flood_like", "prob_unknown_like"), ["benign", "flood_like"])
    return p.select("event_id", *[r6(F.element_at(full, i), n) for i, n in ((1, "p_benign"), (2, "p_scan"), (3, "p_flood"), (6, "p_unknown"))])


@query("b13_b20_rules", f"""with {V.SQL_PREDICTIONS}, x as (select *, event_id % 5 as sc, event_id % 4 as fl, event_id % 3 as be, event_id % 2 as un, cast(event_id % 6 as int) as lvl, case when event_id % 7 = 0 then true_label else 'benign' end as pl from predictions)
select event_id, list_position({_LABELS}, true_label) - 1 as label_place, round((abs(prob_benign - 0.5::double) + abs(prob_scan_like - 0.25::double)) / 2, 6) as distance, prob_scan_like <= 0.2 and prob_flood_like <= 0.1 as boolean_exit,
  round(prob_benign - (1 - prob_benign) - 0.1::double - 0.2::double - 0.3::double, 6) as exit_score,
  case when lvl < 2 then 'benign' when pl <> 'benign' then pl when sc >= fl and sc >= be and sc >= un then 'scan_like' when fl >= be and fl >= un then 'flood_like' when be >= un then 'beacon_like' else 'unknown_like' end as stateful from x""")
def _(spark, d):
    i, p = F.col("event_id"), V.predictions(spark, d)
    counters = {"scan": i % 5, "flood": i % 4, "beacon": i % 3, "unknown": i % 2}
    return p.select(
        "event_id", transform.encode_label(F.col("true_label"), V.PROBS).alias("label_place"), r6(transform.anomaly_distance([F.col("prob_benign"), F.col("prob_scan_like")], [0.5, 0.25]), "distance"),
        transform.boolean_exit({"prob_scan_like": 0.2, "prob_flood_like": 0.1}).alias("boolean_exit"), r6(transform.exit_score(F.col("prob_benign"), 0.1, 0.2, 0.3), "exit_score"),
        transform.stateful_label((i % 6).cast("int"), F.when(i % 7 == 0, F.col("true_label")).otherwise("benign"), counters).alias("stateful"),
    )


# --- evaluation ------------------------------------------------------------------------

def leveled(spark, d):
    p = F.col("prob_benign")
    return V.predictions(spark, d).withColumn("action_level", F.when(p < 0.15, 3).when(p < 0.3, 2).otherwise(0))


_EPISODES = f"""{V.SQL_PREDICTIONS}, r as (select *, row_number() over w as i, true_label <> 'benign' as a, coalesce(lag(true_label <> 'benign') over w, false) as pa, prob_benign < 0.3 and not coalesce(lag(prob_benign < 0.3) over w, false) as rising from predictions window w as (partition by source_file, device_id order by ts_s, event_id)),
e as (select *, sum((a and not pa)::int) over (partition by source_file, device_id order by i) as episode from r),
g as (select min(case when prob_benign < 0.3 then i end) - min(i) as dr, min(case when prob_benign < 0.3 then ts_s end) - min(ts_s) as ds, min(case when prob_benign < 0.15 then ts_s end) - min(ts_s) as ms from e where a group by source_file, device_id, episode)"""


@query("a26_episode_summary", f"with {_EPISODES} select count(*) as episodes, count(*) filter (where dr is null) as missed_alerts, count(*) filter (where ms is null) as missed_mitigations, round(quantile_cont(dr, 0.5), 4) as delay_rows_p50, round(quantile_cont(dr, 0.95), 4) as delay_rows_p95, round(quantile_cont(ds, 0.5), 2) as delay_seconds_p50, round(quantile_cont(ds, 0.95), 2) as delay_seconds_p95, round(quantile_cont(ms, 0.5), 2) as mitigation_p50 from g")
def _(spark, d):
    s = metrics.episode_summary(metrics.episodes(leveled(spark, d), ["source_file", "device_id"], ["ts_s", "event_id"], "ts_s"))
    digits = {"delay_rows_p50": 4, "delay_rows_p95": 4, "delay_seconds_p50": 2, "delay_seconds_p95": 2, "mitigation_p50": 2}
    return s.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in s.columns])


@query("a27_false_alerts_per_hour", f"with {_EPISODES}, h as (select sum(x) as hours from (select greatest((max(ts_s)-min(ts_s))/3600, 1/3600.0::double) as x from predictions group by source_file, device_id)), k as (select count(*) filter (where rising and not a) as n from r) select n as false_alert_events, round(hours, 4) as device_hours, round(n / hours, 8) as false_alerts_per_hour from h, k")
def _(spark, d):
    m = metrics.false_alerts_per_hour(leveled(spark, d), ["source_file", "device_id"], ["ts_s", "event_id"], "ts_s")
    return m.select("false_alert_events", F.round("device_hours", 4).alias("device_hours"), F.round("false_alerts_per_hour", 8).alias("false_alerts_per_hour"))


@query("a30_latency", "with x as (select value from events order by event_id desc limit 1000) select round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(avg(value), 6) as mean, count(*) as n from x")
def _(spark, d):
    m = metrics.latency_summary(table(spark, d, "events"), "event_id", "value", 1000)
    return m.select(*[r6(c) for c in ("p50", "p95", "mean")], "n")


@query("a31_selection_score", f"""with {_PER_CLASS}, lq as (select unnest({_LABELS}) as label, unnest({_PROB_LIST}) as score, true_label from sc), gg as (select label, score, sum((true_label = label)::int) as pos, sum((true_label <> label)::int) as neg from lq group by 1, 2),
cc as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by label) as p, sum(neg) over (partition by label) as n from gg window w as (partition by label order by score desc)),
ap as (select label, sum(pos/p*tp/(tp+fp)) as v from cc where p > 0 and n > 0 group by label), m as (select (select sum(f1) from pf) / 6 as f, (select sum(v) from ap) / 6 as a, (select avg((predicted_label <> 'benign')::int) from sc where true_label <> 'benign') as r)
select round(f, 6) as macro_f1, round(a, 6) as macro_auprc, round(r, 6) as attack_recall, round(0.5::double * f + 0.3::double * a + 0.2::double * r, 6) as selection_score from m""")
def _(spark, d):
    s = scored(spark, d)
    f1 = metrics.per_class(metrics.confusion(s)).agg((F.sum("f1") / len(V.PROBS)).alias("macro_f1"))
    rows = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"prob_{x}").alias("score"), (F.col("true_label") == x).alias("positive")) for x in V.PROBS])
    auprc = metrics.macro_auprc(metrics.ranking_metrics(s.select(F.inline(rows))), V.PROBS)
    recall = s.where("true_label <> 'benign'").agg(F.avg((F.col("predicted_label") != "benign").cast("double")).alias("attack_recall"))
    out = f1.crossJoin(auprc).crossJoin(recall)  # single rows
    score = metrics.selection_score(F.col("macro_f1"), F.col("macro_auprc"), F.col("attack_recall"), {"macro_f1": 0.5, "macro_auprc": 0.3, "attack_recall": 0.2})
    return out.select(r6("macro_f1"), r6("macro_auprc"), r6("attack_recall"), r6(score, "selection_score"))


@query("a33_experiment_summary", "with r as (select event_type, user_id % 5 as seed, avg(value) as v from events group by 1, 2) select event_type, count(v) as runs, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd, round(1.96::double * stddev_samp(v) / sqrt(count(v)), 6) as ci95 from r group by 1")
def _(spark, d):
    runs = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 5).alias("seed")).agg(F.avg("value").alias("v"))
    m = metrics.experiment_summary(runs, ["event_type"], "v")
    return m.select("event_type", "runs", r6("mean"), r6("sd"), r6("ci95"))


@query("s14_source_proof", "select count(*) as rows, count(distinct event_id) as ids, min(event_id) as min_id, max(event_id) as max_id, true as repeats from events")
def _(spark, d):
    from sentryflow.sources.inspect import proof

    e = table(spark, d, "events")
    a, b = proof(e, "event_id", "event_type"), proof(e.repartition(3), "event_id", "event_type").withColumnRenamed("fingerprint", "again").select("again")
    return a.crossJoin(b).select("rows", "ids", "min_id", "max_id", (F.col("fingerprint") == F.col("again")).alias("repeats"))  # single rows


# --- SQL of queries whose plans are in the catalogue --------------------------------------

@query("w17_exit_threshold", f"""with {V.SQL_PREDICTIONS}, s as (select true_label <> 'benign' as att, prob_benign - (1 - prob_benign) - 0.1::double as score from predictions), r as (select min(score) - 1e-6::double as lo, max(score) + 1e-6::double as hi, ceil(0.995::double * count(*) filter (where att)) as need from s),
e as (select max(score) as edge from (select score, row_number() over (order by score) as i from s where att), r where i <= need), g as (select lo + (hi - lo) * i / 200 as x from r, range(201) t(i) union all select score from s), bb as (select min(x) as best from g, e where x > edge)
select round(best, 6) as threshold, round(avg((score >= best)::int) filter (where not att), 6) as benign_exit, round(avg((score < best)::int) filter (where att), 6) as attack_recall from s, bb group by best""")
def _(spark, d):
    s = V.predictions(spark, d).withColumn("score", F.col("prob_benign") - (1 - F.col("prob_benign")) - 0.1)
    t = calibrate.exit_threshold(s, "score", F.col("true_label") != "benign", 0.995)
    return t.select(*[r6(c) for c in t.columns])


_C = (("sc", "scan_like"), ("fl", "flood_like"), ("be", "beacon_like"), ("un", "unknown_like"), ("bn", "benign"))


def _routed_sql(prev: str, lost: str) -> str:
    seen = lambda p: f"case st when 0 then {'true' if p == 'benign' else 'false'} when 1 then {'prob_benign' if p == 'benign' else '(1 - prob_benign) * 0.25::double'} >= 0.45 else prob_{p} >= 0.45 end"
    return ", ".join(f"greatest(0, least(15, cast({prev.format(c)} + case when {seen(p)} then 2 else -1 end - {lost} as int))) as {c}" for c, p in _C)


_ROUTE = f"""with recursive {V.SQL_PREDICTIONS}, o as (select *, row_number() over (partition by source_file, device_id order by ts_s, event_id) as i from predictions),
f as (select source_file, device_id, event_id, i, ts_s as since, score, st, {_routed_sql('0', '0')} from (select *, case when prob_benign > 0.88 then 1.0::double else prob_benign - (1 - prob_benign) - 0.1::double end as score, case when prob_benign > 0.88 then 0 when prob_benign - (1 - prob_benign) - 0.1::double >= 0.5 then 1 else 2 end as st from o where i = 1) z
 union all select source_file, device_id, event_id, i, since0 + 60 * lost as since, score, st, {_routed_sql('p{0}', 'lost')} from (select *, case when prob_benign > 0.88 and doubt <= 0 then 1.0::double else raw end as score, case when prob_benign > 0.88 and doubt <= 0 then 0 when raw >= 0.5 then 1 else 2 end as st
   from (select *, prob_benign - (1 - prob_benign) - 0.3::double * doubt - 0.1::double as raw from (select o.*, f.since as since0, greatest(0, floor((o.ts_s - f.since) / 60)) as lost, f.sc as psc, f.fl as pfl, f.be as pbe, f.un as pun, f.bn as pbn, greatest(0::double, least(1::double, (f.sc + f.fl + f.be + f.un - f.bn) / 60.0::double)) as doubt from f join o on o.source_file = f.source_file and o.device_id = f.device_id and o.i = f.i + 1) y) x) w)
select event_id, round(score, 6) as exit_score, st as exit_stage from f"""


@query("h6_cascade_route", _ROUTE)
def _(spark, d):
    r = temporal.route(cascade_input(spark, d), ["source_file", "device_id"], ["ts_s", "event_id"], "ts_s", threshold=0.5)
    return r.select("event_id", r6("exit_score"), "exit_stage")
