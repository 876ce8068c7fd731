import json

import pytest
from pyspark.sql import functions as F

from sentryflow.operators import temporal, windows
from sentryflow.streaming import devices

PACKET = "device_id string, seq long, ts_s double, length_bytes long, protocol string, destination_ip string, destination_port int, tcp_flags string, outbound boolean, flow_duration_seconds double, connection_failed boolean"


def packets(n=60):
    return [(f"d{i % 3}", i, i * 1.7 + (i % 5), 60 + 37 * (i % 9), ["tcp", "UDP ", "icmp"][i % 3 - i % 2], f"10.0.0.{i * i % 7}", 80 + i % 4, ["SYN", "ACK", "RST", "", "SA"][i % 5], i % 3 != 0, i % 40 * 1.0, i % 4 == 0) for i in range(n)]


def stream(spark, df, tmp, batches):
    """Files of ascending time, one a trigger."""
    src = f"{tmp}/in"
    rows = sorted(df.collect(), key=lambda r: (r.ts_s, r.seq))
    size = -(-len(rows) // batches)
    for i in range(batches):
        spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").json(src)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(src)


def test_stream_features_equal_batch(spark, tmp_path):
    df = spark.createDataFrame(packets(), PACKET)
    got = devices.run_available(devices.stream_features(stream(spark, df, tmp_path, 3), 20.0, 8), f"{tmp_path}/out", f"{tmp_path}/cp")
    want = {r.seq: r for r in windows.window_features(df, 20.0, 8).collect()}
    rows = got.collect()
    assert len(rows) == len(want) == 60
    for r in rows:
        for f in devices.FEATURES:
            assert r[f] == pytest.approx(want[r.seq][f], abs=1e-9), (r.seq, f)


def test_stream_risk_equals_replay(spark, tmp_path):
    df = spark.createDataFrame([(f"d{i % 3}", i, 13.0 * i, (i * 7 % 10) / 10, (i * 3 % 10) / 10) for i in range(40)], "device_id string, seq long, ts_s double, prob_scan_like double, prob_benign double")
    for c in ("flood_like", "beacon_like", "unknown_like"):
        df = df.withColumn(f"prob_{c}", F.lit(0.1))
    got = devices.run_available(devices.stream_risk(stream(spark, df, tmp_path, 4)), f"{tmp_path}/out", f"{tmp_path}/cp")
    cols = ["seq", "state_scan", "state_benign"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, temporal.replay(df, ["device_id"], ["ts_s", "seq"], "ts_s").select(*cols).collect()))


def test_window_bounds_and_restart():
    w = devices.SlidingWindow(60.0, 4, 2)
    marks = [int(m == "syn") for m in devices.MARKS]
    for i in range(8):
        f = w.add(float(i), 100, f"h{i % 3}", 80, marks)
    assert len(w.events) == 4 and len(w.known) == 2 and f["syn_ratio"] > 0.9 and f["rst_ratio"] == 0 and len(f) == 24
    again = devices.SlidingWindow.load(json.dumps(json.loads(w.dump())), 60.0, 4, 2)
    assert again.features() == f and again.add(9.0, 1, "h0", 1, marks) == w.add(9.0, 1, "h0", 1, marks)
    with pytest.raises(ValueError):
        devices.SlidingWindow(60.0, 0)


def test_late_rows_fail_or_go():
    import pandas as pd

    rows = pd.DataFrame({"ts_s": [5.0, 2.0, 4.0], "seq": [1, 2, 3]})
    assert devices._in_order([rows], None, "error")["seq"].tolist() == [2, 3, 1]
    assert devices._in_order([rows], 3.0, "drop")["seq"].tolist() == [3, 1]
    with pytest.raises(ValueError):
        devices._in_order([rows], 3.0, "error")


def test_stream_route_equals_batch_over_triggers(spark, tmp_path):
    rows = [(f"d{i % 3}", i, 13.0 * i, (i * 7 % 10) / 10, (i * 3 % 11) / 10, i % 6 == 0, (i * 8 % 11) / 10) for i in range(60)]
    df = spark.createDataFrame(rows, "device_id string, seq long, ts_s double, prob_scan_like double, prob_benign double, boolean boolean, p_tiny double")
    for c in ("flood_like", "beacon_like", "unknown_like"):
        df = df.withColumn(f"prob_{c}", F.lit(0.1))
    got = {r.seq: (r.exit_score, r.exit_stage) for r in devices.run_available(devices.stream_route(stream(spark, df, tmp_path, 3), 0.2), f"{tmp_path}/out", f"{tmp_path}/cp").collect()}
    want = {r.seq: (r.exit_score, r.exit_stage) for r in temporal.route(df, ["device_id"], ["ts_s", "seq"], "ts_s", threshold=0.2).collect()}
    assert got == want and len(got) == 60 and {s for _, s in got.values()} == {0, 1, 2}
