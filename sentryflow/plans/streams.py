"""Registered streaming queries; each returns what its batch twin does, so it has the same SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentryflow.operators import temporal
from sentryflow.plans import views as V
from sentryflow.plans import evaluation  # noqa: F401  its SQL is used here
from sentryflow.plans.catalog import ORACLES, WINDOW, query, r6, rounded_features
from sentryflow.sources.streams import stream_table
from sentryflow.staging import new_path
from sentryflow.streaming import devices


@query("h1_stream_features", ORACLES["w2_window_features"])
def _(spark, d):
    stream = devices.stream_features(V.packets(spark, d, stream_table), WINDOW)
    return rounded_features(devices.run_available(stream, new_path(spark, "h1-out"), new_path(spark, "h1-state")))


@query("h3_stream_risk", ORACLES["h3_h4_temporal_replay"])
def _(spark, d):
    scored = V.predictions(spark, d, stream_table).withColumn("seq", F.col("event_id"))
    states = devices.run_available(devices.stream_risk(scored), new_path(spark, "h3-out"), new_path(spark, "h3-state"))
    joined = V.predictions(spark, d).join(states.select(F.col("seq").alias("event_id"), *[f"state_{c}" for c in temporal.COUNTERS]), "event_id")
    return temporal.with_risk(joined, "prob_benign").select("event_id", *[f"state_{c}" for c in temporal.COUNTERS], r6("risk_score"), "action_level")


@query("h6_stream_route", ORACLES["h6_cascade_route"])
def _(spark, d):
    scored = V.predictions(spark, d, stream_table).withColumn("seq", F.col("event_id")).withColumn("p_tiny", F.col("prob_benign")).withColumn("boolean", F.col("prob_benign") > 0.88)
    routed = devices.run_available(devices.stream_route(scored, 0.5), new_path(spark, "h6-out"), new_path(spark, "h6-state"))
    return routed.select(F.col("seq").alias("event_id"), r6("exit_score"), "exit_stage")
