import json

import pytest

from sentryflow.__main__ import main
from sentryflow.sources import demo


def test_demo(spark):
    df = demo.demo(spark, 4000)
    rows = df.collect()
    assert len(rows) == 4000 and len(df.columns) == 28 and all(v is not None for r in rows for v in r)
    assert sorted(map(tuple, demo.demo(spark, 4000).repartition(3).collect())) == sorted(map(tuple, rows))
    share = lambda x: sum(r.behavior_label == x for r in rows) / 4000
    mean = lambda c, x="benign": sum(r[c] for r in rows if r.behavior_label == x) / (4000 * share(x))
    assert share("benign") == pytest.approx(0.67, abs=0.03) and share("unknown_like") == pytest.approx(0.03, abs=0.012)
    assert mean("ack_only_ratio") == pytest.approx(0.2, abs=0.02) and mean("syn_ratio") == pytest.approx(1 / 16, abs=0.01) and mean("periodicity_score") == pytest.approx(0.2, abs=0.02)
    assert mean("tcp_ratio") == pytest.approx(5 / 8.4, abs=0.02) and mean("syn_ratio", "scan_like") == pytest.approx(0.75, abs=0.03) and mean("burst_score", "flood_like") > 5
    with pytest.raises(ValueError):
        demo.demo(spark, 10)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "p.csv").write_text("device_id,timestamp,length_bytes,protocol,destination_ip,destination_port,flow_id\nd,1.5,60,tcp,h,80,f1\nd,2.5,61,udp,h,81,f2\n")
    main(["stream-features", "--input", str(tmp_path / "p.csv"), "--output", str(tmp_path / "f")])
    assert json.loads(capsys.readouterr().out)["columns"] == 27
    assert sorted(float(r.tcp_ratio) for r in spark.read.option("header", True).csv(str(tmp_path / "f")).collect()) == [0.5, 1.0]


def test_replay_command(spark, tmp_path):
    rows = [("f", "d", i, None if i == 1 else 30.0 * i, 0.1, 0.9, 0.0, 0.0, 0.0) for i in range(3)]
    names = "source_file string, device_id string, sequence_index long, ts_s double, prob_benign double, prob_scan_like double, prob_flood_like double, prob_beacon_like double, prob_unknown_like double"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "in"))
    main(["replay", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out")])
    got = {r.sequence_index: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert [got[i].state_scan for i in range(3)] == [2, 4, 5] and got[2].action_level > 0 and got[2].action
