"""Running totals, quantiles, splits, inspection and contracts against plain Python."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentryflow.operators import calibrate, metrics, models, order, split, stats, transform
from sentryflow.plans import contracts
from sentryflow.sources import inspect


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, rng.choice(["hot"] * 8 + ["a", None]), rng.randrange(40), None if i % 50 == 0 else float(rng.randrange(30))) for i in range(600)]
    return data, spark.createDataFrame(data, "id long, g string, n long, v double").cache()


def test_running_totals_of_a_hot_group(spark, rows):
    data, df = rows
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.id: r.total for r in order.running(df, ["g"], ["n", "id"], {"total": "n"}).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want, sums = {}, {}
    for i, g, n, _ in sorted(data, key=lambda r: (r[2], r[0])):
        sums[g] = sums.get(g, 0) + n
        want[i] = sums[g]
    assert got == want
    assert order.running(df.limit(0), ["g"], ["n", "id"], {"total": "n"}).count() == 0


def test_quantiles_and_values(rows):
    data, df = rows
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.q): r.x for r in order.quantile_steps(df, ["g"], "v", qs).collect()}
    for g in ("hot", "a", None):
        own = [v for _, k, _, v in data if k == g and v is not None]
        for q in qs:
            assert got[g, q] == pytest.approx(np.quantile(own, q))
    own = sorted(v for *_, v in data if v is not None)
    for k in (1, 7, 300, len(own), len(own) + 5):
        assert order.value_at(df, "v", k) == own[min(k, len(own)) - 1]
        assert order.value_at(df, "v", k, descending=True) == own[::-1][min(k, len(own)) - 1]
    assert order.value_at(df.limit(0), "v", 1) is None


def test_digest_does_not_depend_on_partitions(rows):
    _, df = rows
    h = df.select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    digests = {tuple(stats.ordered_digest(h.repartition(n), "h").first()) for n in (1, 3, 9)}
    assert len(digests) == 1 and next(iter(digests))[0] == 600
    assert stats.ordered_digest(h.limit(0), "h").first().n == 0


def test_sweeps_against_every_threshold(spark, rows):
    rng = random.Random(2)
    data = [(rng.random(), rng.random() if i % 20 else None, rng.random() < 0.6) for i in range(400)] + [(0.05, 0.5, True), (0.99, 0.5, True), (0.0, 0.5, False), (1.0, 0.5, False), (0.3, 0.5, True)]
    df = spark.createDataFrame(data, "p double, x double, b boolean")
    got = {r.confidence: r.rate for r in calibrate.confidence_sweep(df, "p", "x", 0.4).collect()}
    for i in range(189):
        c = round(0.05 + 0.005 * i, 3)
        assert got[c] == pytest.approx(sum(p < c and x is not None and x >= 0.4 for p, x, _ in data) / len(data))
    sweep = {r.q: r for r in calibrate.fast_path_sweep(df, ["p", "x"], F.col("b"), 0.9).collect()}
    assert len(sweep) == 50
    for q, r in sweep.items():
        tp = np.quantile([p for p, _, b in data if b], q)
        tx = np.quantile([x for _, x, b in data if b and x is not None], q)
        inside = [x is not None and p <= tp and x <= tx for p, x, _ in data]
        assert r.benign_exit == pytest.approx(np.mean([i for i, (_, _, b) in zip(inside, data) if b]))
        assert r.attack_recall == pytest.approx(np.mean([not i for i, (_, _, b) in zip(inside, data) if not b]))


def test_inspection_reasons(spark):
    data = [("Normal", " d1 ", "1.5", True), (" ", None, "x", True), ("DDoS", "", "2", True), ("DDoS", "d2", "inf", True), ("DDoS", "d2", "nan", False), (None, "d3", "3", True), *[("Normal", "d1", str(i), True) for i in range(40)]]
    df = spark.createDataFrame(data, "label string, device string, time string, fits boolean")
    out = inspect.inspected(df, "label", "device", "time", fits="fits")
    assert {r.reason: r.rows for r in inspect.reason_counts(out).collect()} == {"accepted": 41, "invalid_label": 2, "invalid_device": 1, "invalid_timestamp": 1, "column_count_mismatch": 1}
    assert {(r.behavior, r.device): r.rows for r in inspect.class_device_counts(out).collect()} == {("benign", "d1"): 41}
    with pytest.raises(ValueError, match="invalid_label"):
        inspect.require_accepted(out)
    assert inspect.reason_counts(inspect.inspected(df.limit(0), "label", "device", "time")).count() == 0
    dates = spark.createDataFrame([("Normal", "2024-01-01 00:00:00"), ("Normal", "2024-02-30"), ("Normal", None)], "label string, time string")
    assert {r.reason: r.rows for r in inspect.reason_counts(inspect.inspected(dates, "label", time="time")).collect()} == {"accepted": 1, "invalid_timestamp": 2}


def test_inspected_files_with_rows_of_other_widths(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Label, Device\nNormal,d1\nDDoS\nDDoS,d2,extra\n")
    rows = inspect.read_inspected(spark, str(tmp_path), ["Label", " Device"])
    got = {r.reason: r.rows for r in inspect.reason_counts(inspect.inspected(rows, "Label", "Device", fits="__fits")).collect()}
    assert got == {"accepted": 1, "column_count_mismatch": 2}


def test_union_budget_and_caps(spark, rows):
    _, df = rows
    a = spark.createDataFrame([(1, 2.0, "s")], "id long, X double, src string")
    b = spark.createDataFrame([("t", 5, 3.0, 4.0)], "src string, ID long, x double, y double")
    u = inspect.union_features([a, b], ["id", "src"])
    assert u.columns == ["id", "src", "X", "y"] and sorted(map(tuple, u.collect()), key=str) == sorted([(1, "s", 2.0, None), (5, "t", 3.0, 4.0)], key=str)
    with pytest.raises(ValueError):
        inspect.union_features([a, b.drop("src")], ["id", "src"])
    assert inspect.within_budget(df, 600).count() == 600
    with pytest.raises(MemoryError):
        inspect.within_budget(df, 599)
    assert {r.g: r["count"] for r in inspect.capped(df, "g", "id", 30).groupBy("g").count().collect()} == {"hot": 30, "a": 30, None: 30}
    late = spark.createDataFrame([(i, float(i if i != 50 else 10)) for i in range(100)], "o long, t double")
    assert inspect.out_of_order_rows(late, "o", "t").first().n_late == 1 and inspect.out_of_order_rows(late.limit(0), "o", "t").first().n_late in (0, None)


def test_batches_leave_no_single_row(spark):
    df = spark.createDataFrame([(s, i) for s, n in (("a", 9), ("b", 8), ("c", 1), ("d", 5)) for i in range(n)], "shard string, i long")
    got = {}
    for r in split.batch_plan(df, "shard", ["i"], 4).collect():
        got.setdefault(r.shard, {}).setdefault(r.batch, []).append(r.i)
    sizes = {s: [len(b[k]) for k in sorted(b)] for s, b in got.items()}
    assert sizes == {"a": [4, 3, 2], "b": [4, 4], "c": [1], "d": [3, 2]}


def test_coverage_and_members(spark):
    df = spark.createDataFrame([(1, "s", "train"), (2, "s", "test"), (3, "t", "validation")], "id long, src string, split string")
    cover = split.source_coverage(df, "src")
    assert sorted(map(tuple, cover.collect())) == [("s", 1, 0, 1, 2), ("t", 0, 1, 0, 1)]
    expected = spark.createDataFrame([("s", 2), ("t", 2), ("u", 1)], "src string, rows long")
    assert sorted(r.src for r in split.coverage_differs(cover, expected, "src").collect()) == ["t", "u"]
    with pytest.raises(ValueError):
        split.manifest(df.unionByName(df.withColumn("split", F.lit("test"))), "random", "id", "src", "src")
    m = split.manifest(df, "time", "id", "src", "src")
    assert m["temporal_continuity"] and m["natural_evaluation_distribution"] and not split.manifest(df, "sequence", "id", "src", "src", out_of_core=True)["temporal_continuity"]


def test_config_rules():
    good = {"dataset": {"storage": "csv", "chunk_size": 10}, "split": {"strategy": "random"}, "model": {"type": "logistic_regression"}}
    assert contracts.problems(good) == []
    bad = contracts.merged(good, {"dataset": {"storage": "parquet", "chunk_size": True, "max_loaded_rows": 0}, "split": {"train_fraction": 0.9, "held_out_attacks": ["x"]}, "preprocess": {"thermometer_bits": 5}, "model": {"type": "fp32_mlp"}, "temporal": {"action_thresholds": [1, 0, 0, 0, 0]}, "training": {"selection_weights": {"macro_f1": 1.0}}, "cascade": {"device_criticality": {"d": 2}}, "evaluation": {"fixed_fpr_targets": [0]}})
    assert len(contracts.problems(bad)) == 11 and bad["model"] == {"type": "fp32_mlp"} and good["dataset"]["storage"] == "csv"
    with pytest.raises(ValueError):
        contracts.checked(bad)
    assert contracts.same_science(good, bad) == ["dataset", "split", "preprocess", "model", "training", "temporal", "cascade"] and contracts.same_science(good, dict(good)) == []
    assert contracts.public({"a": {"_b": 1, "c": [{"_d": 1, "e": 2}]}}) == {"a": {"c": [{"e": 2}]}}
    with pytest.raises(ValueError):
        contracts.shared_schema(["a"], ["b"], ["a"], "v1", "v1")
    assert contracts.materialised_columns(["a", "b", "c"], ["b"], ["c", "b", "d", "c"]) == (["b", "c"], ["d"])


def test_prediction_contract(spark, tmp_path):
    ok = spark.createDataFrame([(i, 1, *[1 / 6] * 6, i) for i in range(9)], "id long, exit_stage int, " + ", ".join(f"prob_{x} double" for x in contracts.LABELS) + ", storage_position long")
    assert not any(contracts.prediction_problems(ok, "id").first())
    back = spark.read.parquet(contracts.write_predictions(ok.orderBy(F.desc("id")), f"{tmp_path}/p", "id"))
    assert back.count() == 9
    bad = ok.unionByName(ok.limit(1).withColumns({"exit_stage": F.lit(3), "prob_benign": F.lit(float("nan"))}))
    assert tuple(contracts.prediction_problems(bad, "id").first()) == (1, 1, 1)
    with pytest.raises(ValueError):
        contracts.write_predictions(bad, f"{tmp_path}/q", "id")


def test_encoders_and_probabilities(spark):
    assert transform.input_groups(["a", "b"], "thermometer", 3) == [0, 0, 0, 1, 1, 1] and transform.encoded_of_first([0, 0, 1, 2], 2) == [0, 1, 2]
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    assert transform.encoder_thresholds(df, ["x"], "hybrid", 2) == {"x": [25.0, 50.0, 75.0]} and transform.encoder_thresholds(df, ["x"], "none") == {"x": []}
    full = spark.range(1).select(transform.full_probabilities(F.array(F.lit(0.0), F.lit(0.0)), ["scan_like"]).alias("p")).first().p
    assert full == [0.0] * 6
    with pytest.raises(ValueError):
        metrics.selection_score(F.lit(1), F.lit(1), F.lit(1), {"macro_f1": 0.9, "macro_auprc": 0.3, "attack_recall": 0.2})
    assert spark.range(1).select(models.focal_loss(F.lit(0.5)).alias("x")).first().x == pytest.approx(0.25 * np.log(2))


def test_batch_inference_is_the_fitted_linear_model(spark):
    rng = random.Random(3)
    data = [(rng.gauss(2 * (i % 2), 1), rng.gauss(0, 1), "scan_like" if i % 2 else "benign") for i in range(300)]
    df = spark.createDataFrame(data, "a double, b double, label string")
    for fit in (models.fit_logistic, models.fit_forest):
        model = fit(df, ["a", "b"], "label")
        got = models.predict(model, df).collect()
        assert len(got) == 300 and all(r.predicted_label == model[1][int(np.argmax(r.probabilities[: len(model[1])]))] for r in got)
        assert np.mean([r.predicted_label == r.label for r in got]) > 0.75


def test_models_by_type_keep_their_predictions_when_saved(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 10), float(i * 7 % 5), "benign" if i % 10 < 4 else "scan_like" if i % 10 < 7 else "flood_like") for i in range(120)], "a double, b double, y string")
    for kind, options in (("logistic_regression", {}), ("random_forest", {"trees": 5}), ("fp32_mlp", {"hidden": (8,), "iterations": 60})):
        model = models.fit(kind, df, ["a", "b"], "y", **options)
        got = models.predict(model, df).orderBy("a", "b").collect()
        assert sum(r.y == r.predicted_label for r in got) >= 110, kind
        assert all(sum(r.probabilities) == pytest.approx(1) for r in got)
        again = models.predict(models.load(spark, models.save(model, f"{tmp_path}/{kind}")), df).orderBy("a", "b").collect()
        assert [r.predicted_label for r in again] == [r.predicted_label for r in got]
    gate = models.predict(models.fit_gate(df, ["a", "b"], "y", 1), df).collect()
    assert {r.predicted_label for r in gate} <= {"attack", "benign"} and sum((r.y == "benign") == (r.predicted_label == "benign") for r in gate) >= 110
    with pytest.raises(ValueError, match="xgboost"):
        models.fit("xgboost", df, ["a", "b"], "y")


def test_random_split_orders_only_the_rows_at_the_edges(spark, monkeypatch):
    rng = random.Random(7)
    data = [(None if i % 97 == 0 else f"u{i % 5900}", rng.choice(["a"] * 7 + ["b", "b", "c"]) if i else "once", i) for i in range(6000)]
    df = spark.createDataFrame(data, "uid string, y string, i int")
    seen, real = [], split.running
    monkeypatch.setattr(split, "running", lambda rows, *a: (seen.append(rows.count()), real(rows, *a))[1])
    got = split.split_random(df, "uid", "y").collect()
    assert sorted(r.i for r in got) == list(range(6000)) and sum(seen) < 60

    def shares(counts, target):
        n = sum(counts.values())
        base = {k: c * target // n for k, c in counts.items()}
        for k in sorted(counts, key=lambda k: (-(counts[k] * target % n), k))[: target - sum(base.values())]:
            base[k] += 1
        return base

    counts = collections.Counter(y for _, y, _ in data)
    train, val = shares(counts, 4200), shares(counts, 900)
    for y in counts:
        ids = sorted((u is None, hashlib.sha256(f"2309\0{u}".encode()).hexdigest(), u or "") for u, k, _ in data if k == y)
        parts = {p: sorted((r.uid is None, hashlib.sha256(f"2309\0{r.uid}".encode()).hexdigest(), r.uid or "") for r in got if r.y == y and r.split == p) for p in ("train", "validation", "test")}
        a, b = train[y], train[y] + val[y]
        assert (parts["train"], parts["validation"], parts["test"]) == (ids[:a], ids[a:b], ids[b:])


def test_random_split_of_equal_or_missing_ids_keeps_the_quotas(spark):
    for uid in (F.lit("same"), F.lit(None).cast("string")):
        df = spark.range(1000).select(uid.alias("uid"), F.lit("a").alias("y"), "id")
        got = split.split_random(df, "uid", "y").collect()
        assert collections.Counter(r.split for r in got) == {"train": 700, "validation": 150, "test": 150} and len({r.id for r in got}) == 1000
    assert split.split_random(df.limit(0), "uid", "y").count() == 0


def test_a_fit_reads_its_rows_once(spark):
    df = spark.createDataFrame([(float(i % 10), float(i * 7 % 5), "benign" if i % 10 < 5 else "scan_like") for i in range(120)], "a double, b double, y string")
    for fit in (models.fit_logistic, models.fit_forest, models.fit_mlp):
        read = spark.sparkContext.accumulator(0)

        def counted(batches, read=read):
            for b in batches:
                read.add(b.num_rows)
                yield b

        model = fit(df.mapInArrow(counted, df.schema), ["a", "b"], "y")
        assert read.value == 120 and models.predict(model, df).count() == 120
