"""Stateful per-device operators for Structured Streaming.

State is bounded: five counters and a time (``stream_risk``), or a window of at
most ``max_events`` events and ``max_known`` destinations (``stream_features``).
A device's rows of one micro-batch are sorted by time and arrival before they
are folded, so limit the rows of a trigger (``maxFilesPerTrigger``).  State lives
in the query's checkpoint and comes back after a lost executor.

An event older than the device's last fails the query (``late="error"``) or is
left out (``late="drop"``).  Rows with null device form a device of their own; a
null time is an error for windows and no time at all for risk.
"""

from __future__ import annotations

import json
import math
from collections import Counter, OrderedDict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sentryflow.functions.scalars import ack_only, has_flag
from sentryflow.operators.temporal import COUNTERS, Device, exit_step

FEATURES = [
    "packet_rate", "byte_rate", "burst_score", "tcp_ratio", "udp_ratio", "icmp_ratio", "syn_ratio", "rst_ratio", "ack_only_ratio",
    "unique_destination_ip_ratio", "unique_destination_port_ratio", "new_destination_ratio", "repeated_destination_score", "repeated_port_score",
    "interarrival_mean", "interarrival_jitter", "interarrival_stability", "periodicity_score", "outbound_packet_ratio", "outbound_byte_ratio",
    "short_flow_ratio", "long_flow_ratio", "small_packet_ratio", "failed_connection_score",
]
#: An event as kept in state: time, bytes, destination, port, then 0/1 marks that windows only count.
MARKS = ["tcp", "udp", "icmp", "syn", "rst", "ack", "out", "short", "long", "small", "bad"]


class SlidingWindow:
    """Counts over a device's recent events, changed by what enters and what leaves."""

    def __init__(self, seconds: float = 60.0, max_events: int = 2048, max_known: int = 512):
        if min(max_events, max_known) <= 0:
            raise ValueError("window capacities must be positive")
        self.seconds, self.max_events, self.max_known = float(seconds), max_events, max_known
        self.events: deque = deque()
        self.known: OrderedDict = OrderedDict()
        self.sums = np.zeros(len(MARKS) + 3, np.int64)  # marks, then new destinations, bytes, outbound bytes
        self.seen = {"dst": Counter(), "port": Counter(), "second": Counter()}

    def _count(self, e, sign: int) -> None:
        ts, size, dst, port, marks, new = e
        self.sums += sign * np.array([*marks, new, size, size * marks[MARKS.index("out")]], np.int64)
        for counter, value in zip(self.seen.values(), (dst, port, math.floor(ts))):
            counter[value] += sign
            if not counter[value]:
                del counter[value]

    def add(self, ts: float, size: int, dst, port, marks) -> dict[str, float]:
        new = int(dst not in self.known)
        self.known[dst] = None
        self.known.move_to_end(dst)
        if len(self.known) > self.max_known:
            self.known.popitem(last=False)
        self.events.append(e := (ts, size, dst, port, tuple(marks), new))
        self._count(e, 1)
        while len(self.events) > self.max_events or self.events[0][0] < ts - self.seconds:
            self._count(self.events.popleft(), -1)
        return self.features()

    def features(self) -> dict[str, float]:
        n = len(self.events)
        times = np.array([e[0] for e in self.events])
        gaps = np.diff(times)
        gap, jitter = (gaps.mean(), gaps.std()) if n > 1 else (0.0, 0.0)
        steady = 1 / (1 + jitter / max(gap, 1e-6)) if n > 1 else 0.0
        took = max(times[-1] - times[0], 1e-3) if n > 1 else self.seconds
        *counts, size, size_out = self.sums.tolist()
        part = {k: v / n for k, v in zip([*MARKS, "new"], counts)}
        kinds = {k: len(c) / n for k, c in self.seen.items()}
        values = [
            n / took, size / took, max(self.seen["second"].values()) * kinds["second"], part["tcp"], part["udp"], part["icmp"], part["syn"], part["rst"], part["ack"],
            kinds["dst"], kinds["port"], part["new"], 1 - kinds["dst"], 1 - kinds["port"],
            gap, jitter, steady, steady if n > 3 else 0.0, part["out"], size_out / max(size, 1),
            part["short"], part["long"], part["small"], part["bad"],
        ]
        return {k: float(v) for k, v in zip(FEATURES, values)}

    def dump(self) -> str:
        return json.dumps([list(self.events), list(self.known)])

    @classmethod
    def load(cls, text: str, *args) -> "SlidingWindow":
        w = cls(*args)
        events, known = json.loads(text)
        for ts, size, dst, port, marks, new in events:
            w.events.append(e := (ts, size, dst, port, tuple(marks), new))
            w._count(e, 1)
        w.known.update(dict.fromkeys(known))
        return w


def _in_order(chunks, last: float | None, late: str) -> pd.DataFrame:
    rows = pd.concat(list(chunks)).sort_values(["ts_s", "seq"], kind="stable")
    if last is not None and (old := rows["ts_s"] < last).any():
        if late == "error":
            raise ValueError("an event is older than one of its device that was already processed")
        rows = rows[~old]
    return rows


def _marked(packets: DataFrame) -> DataFrame:
    proto, flags = F.lower(F.trim("protocol")), F.col("tcp_flags")
    marks = {
        "tcp": proto == "tcp", "udp": proto == "udp", "icmp": proto == "icmp",
        "syn": has_flag(flags, "S", "SYN"), "rst": has_flag(flags, "R", "RST"), "ack": ack_only(flags), "out": F.col("outbound"),
        "short": F.col("flow_duration_seconds") < 1, "long": F.col("flow_duration_seconds") > 30, "small": F.col("length_bytes") < 128, "bad": F.col("connection_failed"),
    }
    return packets.select(
        "device_id", F.col("ts_s").cast("double"), F.col("seq").cast("long"), F.coalesce(F.col("length_bytes").cast("long"), F.lit(0)).alias("size"), F.col("destination_ip").alias("dst"),
        F.coalesce(F.col("destination_port").cast("long"), F.lit(0)).alias("port"), *[F.coalesce(c, F.lit(False)).cast("int").alias(k) for k, c in marks.items()],
    )


def stream_features(packets: DataFrame, window_seconds: float = 60.0, max_events: int = 2048, max_known: int = 512, *, late: str = "error") -> DataFrame:
    """device_id, seq, ts_s and the 24 window features, one row an event (append mode)."""

    def run(key, chunks, state):
        text, last = state.get if state.exists else (None, None)
        w = SlidingWindow.load(text, window_seconds, max_events, max_known) if text else SlidingWindow(window_seconds, max_events, max_known)
        rows = _in_order(chunks, last, late)
        if rows["ts_s"].isna().any():
            raise ValueError("an event has no time")
        out = []
        for r in rows.itertuples(index=False):
            f = w.add(float(r.ts_s), int(r.size), r.dst, int(r.port), [int(getattr(r, m)) for m in MARKS])
            out.append((key[0], r.seq, r.ts_s, *f.values()))
        if out:
            state.update((w.dump(), float(out[-1][2])))
        yield pd.DataFrame(out, columns=["device_id", "seq", "ts_s", *FEATURES])

    schema = "device_id string, seq long, ts_s double, " + ", ".join(f"{f} double" for f in FEATURES)
    return _marked(packets).groupBy("device_id").applyInPandasWithState(run, schema, "window string, last double", "append", "NoTimeout")


def stream_risk(scored: DataFrame, prob: str = "prob_{}", *, late: str = "error", **options) -> DataFrame:
    """device_id, seq, ts_s and the five counters after each row (append mode); ``options`` as in ``Device.update``."""
    columns = {c: prob.format(c if c == "benign" else f"{c}_like") for c in COUNTERS}
    rows = scored.select("device_id", F.col("ts_s").cast("double"), F.col("seq").cast("long"), *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(k) for k, v in columns.items()])

    def run(key, chunks, state):
        device, last = Device(), None
        if state.exists:
            *counts, device.since, last = state.get
            device.counters = dict(zip(COUNTERS, counts))
        out = []
        for r in _in_order(chunks, last, late).itertuples(index=False):
            ts = None if pd.isna(r.ts_s) else float(r.ts_s)
            device.update({c: getattr(r, c) for c in COUNTERS}, ts, **options)
            last = last if ts is None else ts
            out.append((key[0], r.seq, ts, *(device.counters[c] for c in COUNTERS)))
        state.update((*(device.counters[c] for c in COUNTERS), device.since, last))
        yield pd.DataFrame(out, columns=["device_id", "seq", "ts_s", *(f"state_{c}" for c in COUNTERS)])

    schema = "device_id string, seq long, ts_s double, " + ", ".join(f"state_{c} int" for c in COUNTERS)
    kept = ", ".join(f"{c} int" for c in COUNTERS) + ", since double, last double"
    return rows.groupBy("device_id").applyInPandasWithState(run, schema, kept, "append", "NoTimeout")


def stream_route(scored: DataFrame, threshold: float, *, late: str = "error", **options) -> DataFrame:
    """device_id, seq, ts_s, exit_score and exit_stage (append mode): ``temporal.route`` with state, as a stream.

    Columns needed beside id and time: ``boolean``, ``p_tiny`` and ``prob_<label>`` of the main model; a null
    probability counts as 0 and a null ``boolean`` as false.  ``options`` as in ``temporal.exit_step``.
    """
    share = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rows = scored.select(
        "device_id", F.col("ts_s").cast("double"), F.col("seq").cast("long"), F.coalesce("boolean", F.lit(False)).alias("boolean"), share("p_tiny").alias("p_tiny"),
        *[share(f"prob_{c if c == 'benign' else c + '_like'}").alias(c) for c in COUNTERS],
    )

    def run(key, chunks, state):
        device, last = Device(), None
        if state.exists:
            *counts, device.since, last = state.get
            device.counters = dict(zip(COUNTERS, counts))
        out = []
        for r in _in_order(chunks, last, late).itertuples(index=False):
            ts = None if pd.isna(r.ts_s) else float(r.ts_s)
            score, stage = exit_step(device, ts, bool(r.boolean), r.p_tiny, {c: getattr(r, c) for c in COUNTERS}, threshold=threshold, **options)
            last = last if ts is None else ts
            out.append((key[0], r.seq, ts, score, stage))
        state.update((*(device.counters[c] for c in COUNTERS), device.since, last))
        yield pd.DataFrame(out, columns=["device_id", "seq", "ts_s", "exit_score", "exit_stage"])

    kept = ", ".join(f"{c} int" for c in COUNTERS) + ", since double, last double"
    return rows.groupBy("device_id").applyInPandasWithState(run, "device_id string, seq long, ts_s double, exit_score double, exit_stage int", kept, "append", "NoTimeout")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all that is there now into Parquet at ``path``; a later call goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
