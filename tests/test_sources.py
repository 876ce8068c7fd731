import pytest

from sentryflow.sources import tables as T


def test_headers():
    assert T.normalize_columns(["\ufeffa ", " B", "é"]) == ["a", "B", "é"]
    for bad in (["a", " A"], ["a", " "], ["a\x01"], []):
        with pytest.raises(ValueError):
            T.normalize_columns(bad)
    assert T.is_sidecar("botiot", "Data_Names.CSV") and not T.is_sidecar("csv", "data_names.csv")
    assert T.resolve_role(["Attack", "LABEL"], "label") == "LABEL"
    assert T.resolve_role(["Attack", "LABEL"], "label", "attack") == "Attack"
    assert T.resolve_role(["x"], "time") is None


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_device_directories(spark, tmp_path):
    write(tmp_path / "cam" / "benign_traffic.csv", "mean,std\n1,2\n3,x\n")
    write(tmp_path / "cam" / "mirai_attacks" / "scan.csv", "mean,std\n5,6\n")
    write(tmp_path / "cam" / "mirai_attacks" / "udp x.csv", "mean,std\n5,6\n")
    write(tmp_path / "demonstrate_structure.csv", "mean,std\n9,9\n")
    got = T.device_directories(spark, str(tmp_path))
    rows = sorted((r.device_id, r.raw_attack, r.behavior_label, r["mean"], r["std"]) for r in got.collect() if r["std"])
    assert rows == [("cam", "benign", "benign", 1.0, 2.0), ("cam", "mirai_scan", "scan_like", 5.0, 6.0), ("cam", "mirai_udp_x", "flood_like", 5.0, 6.0)]
    assert got.count() == 4


def test_flow_records(spark, tmp_path):
    lines = "".join(f"{'DDoS,TCP' if i % 2 else 'Normal,Normal'},10.0.0.{i % 4 + 1},{i + 0.5},{100 + i},{'' if i < 28 else 1}\n" for i in range(40))
    write(tmp_path / "flows.csv", "category,subcategory,saddr,stime,bytes,rate\n" + lines)
    write(tmp_path / "data_names.csv", "category,subcategory,saddr,stime,bytes,rate\n")
    got = T.flow_records(spark, str(tmp_path))
    assert got.columns == ["source_path", "device_id", "ts_s", "raw_attack", "behavior_label", "bytes", "rate"]
    assert {(r.behavior_label, r.raw_attack, r["count"]) for r in got.groupBy("behavior_label", "raw_attack").count().collect()} == {("benign", "normal", 20), ("flood_like", "tcp", 20)}
    assert got.where("rate is null").count() == 28 and got.agg({"ts_s": "max"}).first()[0] == 39.5
    other = T.flow_records(spark, str(tmp_path), {"tcp": "scan_like"})
    assert other.where("behavior_label = 'scan_like'").count() == 20


def test_labelled_records_and_times(spark, tmp_path):
    write(tmp_path / "a.csv", "when,kind,v\n2026-01-01T00:00:10Z,scan,1\nnever,zzz,2\n2026-01-01T00:00:20Z,,3\n")
    rows = T.labelled_records(spark, str(tmp_path), "Kind", time="when").orderBy("v").collect()
    assert [(r.behavior_label, r.ts_s) for r in rows] == [("scan_like", 1767225610.0), ("unknown_like", None), ("unknown_like", 1767225620.0)]
    with pytest.raises(ValueError):
        T.labelled_records(spark, str(tmp_path), "nothing")


def test_packets_and_manifest(spark, tmp_path):
    write(tmp_path / "p.csv", "device_id,timestamp,length_bytes,protocol,destination_ip,destination_port,outbound,flow_id\nd,1.5,60,tcp,h,80,out,f1\nd,2.5,61,udp,h,81,,f2\n")
    rows = T.packet_records(T.read_csv(spark, str(tmp_path))).orderBy("ts_s").collect()
    assert [(r.ts_s, r.length_bytes, r.outbound, r.connection_failed, r.flow_id) for r in rows] == [(1.5, 60, True, False, "f1"), (2.5, 61, True, False, "f2")]
    assert T.manifest(spark, str(tmp_path)).count() == 1
    with pytest.raises(ValueError):
        T.packet_records(T.read_csv(spark, str(tmp_path)).drop("protocol"))
