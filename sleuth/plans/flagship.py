"""The flagship query: correlated incident windows with their anomaly counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuth.operators import anomalies as A
from sleuth.operators import correlate as G
from sleuth.plans.ordering import _keep
from sleuth.sources.tables import agent_events

AGENT = ["agent_id"]


def correlated_incidents(spark: SparkSession, sf_dir: str, window_seconds: float = 600) -> DataFrame:
    """Per agent and anchored group: window, size, sources, max risk and the
    number of anomalies whose carrier event falls in the group."""
    ev = agent_events(spark, sf_dir)
    labelled = _keep(G.assign_groups(ev, window_seconds, AGENT, columns=["timestamp", "source", "event_type", "risk_score"]))
    members = labelled.select("id", "agent_id", "group_id")
    anoms = A.detect_anomalies(ev, partition_by=AGENT, high_frequency_threshold=0.001).select("id", "type")
    per_group_anoms = (
        anoms.join(members, "id")
        .groupBy("agent_id", "group_id")
        .agg(F.count(F.lit(1)).alias("anomalies"), F.array_sort(F.collect_set("type")).alias("anomaly_types"))
    )
    groups = G.summarize_groups(labelled, AGENT)  # one labelling pass feeds both
    return (
        groups.join(per_group_anoms, ["agent_id", "group_id"], "left")
        .select(
            "agent_id",
            "group_id",
            "window_start",
            "window_end",
            "event_count",
            F.array_join("sources", ",").alias("sources"),
            "max_risk",
            F.coalesce("anomalies", F.lit(0)).alias("anomalies"),
            F.array_join(F.coalesce("anomaly_types", F.array().cast("array<string>")), ",").alias("anomaly_types"),
        )
    )
