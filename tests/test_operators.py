import math

import pytest
from pyspark.sql import functions as F

from sentryflow.functions import scalars as S
from sentryflow.operators import calibrate, metrics, models, split, stats, temporal, transform, windows


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize("text,want", [(" Mirai--Scan ", "mirai_scan"), ("", "unknown"), ("__", "unknown"), ("A1", "a1"), (None, "unknown")])
def test_normalize_token(spark, text, want):
    assert one(spark, S.normalize_token(F.lit(text).cast("string"))) == want


def test_flags(spark):
    assert one(spark, S.has_flag(F.lit("RST"), "S", "SYN")) is False
    assert one(spark, S.has_flag(F.lit("RST"), "R", "RST")) is True
    assert one(spark, S.has_flag(F.lit("SA"), "S", "SYN")) is True
    assert one(spark, S.ack_only(F.lit("ACK|A"))) is False
    assert one(spark, S.ack_only(F.lit("ACK"))) is True


def test_counters_saturate_and_decay():
    probs = {"scan": 1.0, "flood": 0.0, "beacon": 0.0, "unknown": 0.0, "benign": 0.0}
    d = temporal.Device()
    for _ in range(20):
        d.update(probs, None)
    assert d.counters["scan"] == 15 and d.counters["benign"] == 0
    d = temporal.Device()
    for t in (0.0, 30.0, 61.0):
        d.update(probs, t)
    assert d.counters["scan"] == 5


def test_replay_is_the_fold(spark):
    rows = [("f", "d1", float(t), i, 1.0, 0.0) for i, t in enumerate((0, 30, 61))] + [("f", "d2", None, 9, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "s string, d string, ts double, i long, prob_scan_like double, prob_benign double")
    for c in ("flood_like", "beacon_like", "unknown_like"):
        df = df.withColumn(f"prob_{c}", F.lit(0.0))
    got = {r.i: r.state_scan for r in temporal.replay(df, ["s", "d"], ["ts", "i"], "ts").collect()}
    assert got == {0: 2, 1: 4, 2: 5, 9: 0}


def test_window_is_bounded(spark):
    rows = [("d", i, float(i), 100, "tcp", f"10.0.0.{i % 3}", 80, "SYN", True, 0.5, False) for i in range(8)]
    p = spark.createDataFrame(rows, "device_id string, seq long, ts_s double, length_bytes long, protocol string, destination_ip string, destination_port int, tcp_flags string, outbound boolean, flow_duration_seconds double, connection_failed boolean")
    f = windows.window_features(p, 60.0, max_events=4).orderBy("seq")
    assert len(f.columns) == 3 + 24
    last = f.collect()[-1]
    assert last.syn_ratio > 0.9 and last.packet_rate == pytest.approx(4 / 3) and last.new_destination_ratio == 0
    assert windows.out_of_order(p).first()[0] == 0


def test_quotas_are_largest_remainders(spark):
    c = spark.createDataFrame([("a", 10), ("b", 7), ("c", 3)], "label string, count long")
    got = {r.label: r.quota for r in split.quotas(c, "label", F.lit(14), F.lit(20)).collect()}
    assert sum(got.values()) == 14 and got == {"a": 7, "b": 5, "c": 2}


def test_positions_are_global(spark):
    df = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(1000)).alias("k"), "id")
    assert all(r.k == r.position for r in split.positions(df, "k", "id").collect())


def test_splits_cover_each_row_once(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("uid"), F.when(F.col("id") % 4 == 0, "scan_like").otherwise("benign").alias("label"), (F.col("id") % 5).cast("string").alias("dev"), F.concat(F.lit("x"), (F.col("id") % 3).cast("string")).alias("atk"), F.lit("f").alias("src"), "id")
    for s in (split.split_random(df, "uid", "label"), split.split_device(df, "uid", "dev"), split.split_attack(df, "uid", "label", "atk"), split.split_sequence(df, "src", "id"), split.split_block(df, "src", "id", 10)):
        got = s.select("uid", "split").collect()
        assert len(got) == len({r.uid for r in got}) == 200 and {r.split for r in got} == {"train", "validation", "test"}
    held = split.split_device(df, "uid", "dev").where("split = 'test'").select("dev").distinct().collect()
    assert [r.dev for r in held] == ["4"]


def test_quantiles_and_missing(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, float("nan")), (float("inf"), None), (4.0, None)], "a double, b double")
    got = {r.feature: r for r in stats.finite_counts(df, ["a", "b"]).collect()}
    assert (got["a"].finite, got["a"].missing, got["b"].finite) == (3, 1, 0)
    q = {r.feature: r.q for r in stats.quantiles(df, ["a"], [0.5]).collect()}
    assert q["a"] == [2.0]
    assert set(transform.feature_stats(df, ["a", "b"])) == {"a"}


def test_exit_threshold(spark):
    rows = [(p, i >= 3) for i, p in enumerate((0.99, 0.95, 0.91, 0.65, 0.20, 0.10))]
    df = spark.createDataFrame(rows, "p double, attack boolean").withColumn("score", F.col("p") - (1 - F.col("p")))
    r = calibrate.exit_threshold(df, "score", F.col("attack"), 1.0, 51).first()
    assert r.attack_recall == 1.0 and r.benign_exit == 1.0


def test_metrics_of_perfect_predictions(spark):
    df = spark.createDataFrame([("benign", "benign"), ("scan_like", "scan_like")], "true_label string, predicted_label string")
    s = metrics.summary(metrics.per_class(metrics.confusion(df))).first()
    assert (s.accuracy, s.macro_f1) == (1.0, 1.0) and s.mcc == pytest.approx(1.0)


def test_rank_metrics_group_ties(spark):
    df = spark.createDataFrame([("a", 0.5, True), ("a", 0.5, False), ("b", 0.1, True)], "label string, score double, positive boolean")
    got = metrics.ranking_metrics(df).collect()
    assert [(r.label, r.auroc, r.average_precision) for r in got] == [("a", 0.5, 0.5)]


def test_episode_delay(spark):
    rows = [("f", "d", float(i), i, t, lvl) for i, (t, lvl) in enumerate([("benign", 0), ("scan_like", 0), ("scan_like", 2), ("benign", 0), ("flood_like", 1)])]
    df = spark.createDataFrame(rows, "s string, d string, ts double, i long, true_label string, action_level int")
    got = {r.episode: (r.length, r.delay_rows, r.delay_seconds) for r in metrics.episodes(df, ["s", "d"], ["ts", "i"], "ts").collect()}
    assert got == {1: (2, 1, 1.0), 2: (1, None, None)}


def test_sign_and_packing(spark):
    assert [one(spark, models.sign(F.lit(v))) for v in (-2.0, -0.5, 0.0, 0.5, 2.0)] == [-1, -1, 1, 1, 1]
    assert models.pack_signs([1, -1, 1, 1]) == bytes([0b1101]) and models.packed_bytes(9) == 2


def test_thermometer_width(spark):
    x = spark.range(1).select(transform.encode(F.lit(0.5), "thermometer", [0.3, 0.6], 0.5).alias("x")).first()[0]
    assert x == [1.0, -1.0]


def test_dkw(spark):
    assert one(spark, stats.dkw(F.lit(1000))) == pytest.approx(math.sqrt(math.log(40) / 2000))
