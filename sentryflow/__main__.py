"""Command line: ``python -m sentryflow make-demo | stream-features | replay``; prints one JSON line."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession, functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sentryflow")
    commands = p.add_subparsers(dest="command", required=True)
    demo = commands.add_parser("make-demo", help="write a synthetic labelled table")
    demo.add_argument("--rows", type=int, default=12_000)
    demo.add_argument("--seed", type=int, default=2309)
    features = commands.add_parser("stream-features", help="packet metadata (CSV) to the 24 window features")
    features.add_argument("--window-seconds", type=float, default=60.0)
    features.add_argument("--max-events-per-device", type=int, default=2048)
    replay = commands.add_parser("replay", help="risk state and actions of scored rows (Parquet)")
    for c in (features, replay):
        c.add_argument("--input", required=True)
    for c in (demo, features, replay):
        c.add_argument("--output", required=True)
    return p


def result(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from sentryflow.operators import temporal, windows
    from sentryflow.sources import demo, tables

    if a.command == "make-demo":
        return demo.demo(spark, a.rows, a.seed)
    if a.command == "stream-features":
        packets = tables.packet_records(tables.read_csv(spark, a.input))
        if windows.out_of_order(packets).first()[0]:
            raise ValueError("packets of a device must come in order of time")
        extra = [c for c in tables.PASSED_ON if c in packets.columns]
        made = windows.window_features(packets, a.window_seconds, a.max_events_per_device)
        return made.join(packets.select("seq", *extra), "seq").withColumnRenamed("ts_s", "timestamp").drop("seq")
    scored = spark.read.parquet(a.input)
    order = ["ts_s", "sequence_index"] if scored.where("ts_s is null").isEmpty() else ["sequence_index"]
    states = temporal.replay(scored, ["source_file", "device_id"], order, "ts_s")
    keys = ["source_file", "device_id", "sequence_index"]
    return temporal.with_risk(scored.join(states.select(*keys, *[F.col(f"state_{c}") for c in temporal.COUNTERS]), keys), "prob_benign")


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sentryflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = result(spark, a)
    if a.command == "replay":
        out.write.parquet(a.output)
    else:
        out.write.option("header", True).csv(a.output)
    print(json.dumps({"command": a.command, "output": a.output, "columns": len(out.columns)}))


if __name__ == "__main__":
    main()
