"""Report sections as DataFrames of lines, incident summaries.

Listing sections that the studied tool caps (timeline: 50 rows, groups: 10)
are top-k frames plus one "N more" row; unbounded sections (deviations,
anomalies, evidence) are numbered with the distributed sequence, never with
a single-task window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sleuth.functions.columns import first_non_empty, fmt1, prefix, severity_rank
from sleuth.operators.timeline import TEXT_ORDER
from sleuth.plans.ordering import SEQ, _keep, drop_layout, sequence

# Report caps and empty-section sentences.
TIMELINE_TOP = 50
GROUPS_TOP = 10
EMPTY = {
    "timeline": "No events recorded.",
    "groups": "No correlated event groups.",
    "deviations": "No policy deviations detected.",
    "anomalies": "No anomalies detected.",
    "evidence": "No evidence collected.",
}
# Headings of the sections after the report's own header.
HEADINGS = {
    1: "Timeline Summary",
    2: "Correlated Event Groups",
    3: "Policy Deviations",
    4: "Anomalies Detected",
    5: "Evidence Chain of Custody",
    6: "Raw Evidence",
}
RAW_EVIDENCE = "> Full evidence chain available in the database."
RECOMMENDATIONS = [
    ("anomalies", "Review the detected anomalies and their triggering events"),
    ("deviations", "Tighten the agent policy for the observed deviations"),
    ("blocked", "Investigate repeated blocked actions of the agent"),
    ("critical", "Escalate: critical-severity events were recorded"),
]


def report_header(df: DataFrame, incident_id: str = "INC-UNKNOWN", generated_at: str | None = None) -> DataFrame:
    """event count, sorted distinct sources, incident id, generation time."""
    agg = df.agg(F.count(F.lit(1)).alias("event_count"), F.array_sort(F.collect_set(F.coalesce("source", F.lit("?")))).alias("_src"))
    return agg.select(
        F.lit(incident_id).alias("incident_id"),
        (F.lit(generated_at) if generated_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("generated_at"),
        "event_count",
        F.array_join("_src", ", ").alias("sources"),
    )


def report_timeline(df: DataFrame, top: int = TIMELINE_TOP) -> DataFrame:
    """First ``top`` events (text order) as table rows, plus a remainder row."""
    head = df.orderBy(*TEXT_ORDER).limit(top)
    rows = head.select(
        F.row_number().over(Window.orderBy(*TEXT_ORDER)).cast("long").alias("row_no"),  # at most `top` rows
        F.coalesce("source", F.lit("?")).alias("source"),
        F.coalesce("severity", F.lit("?")).alias("severity"),
        prefix(first_non_empty("title", "event_type", default="?"), 60).alias("event"),
        prefix(F.coalesce("timestamp", F.lit("?")), 19).alias("time"),
        F.coalesce(F.col("risk_score"), F.lit(0.0)).alias("risk"),
        F.lit(0).cast("long").alias("more"),
    )
    more = df.agg((F.count(F.lit(1)) - top).alias("more")).where(F.col("more") > 0).select(
        F.lit(top + 1).cast("long").alias("row_no"),
        F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("string").alias("severity"),
        F.lit(None).cast("string").alias("event"),
        F.lit(None).cast("string").alias("time"),
        F.lit(None).cast("double").alias("risk"),
        F.col("more").cast("long").alias("more"),
    )
    return rows.unionByName(more)


def report_groups(groups: DataFrame, top: int = GROUPS_TOP) -> DataFrame:
    """First ``top`` correlation groups plus a remainder row."""
    order = ["group_seq"]
    head = groups.orderBy(*order).limit(top)
    rows = head.select(
        F.row_number().over(Window.orderBy(*order)).cast("long").alias("row_no"),
        prefix("window_start", 19).alias("start"),
        prefix("window_end", 19).alias("end"),
        "event_count",
        "max_risk",
        F.array_join("sources", ", ").alias("sources"),
        F.lit(0).cast("long").alias("more"),
    )
    more = groups.agg((F.count(F.lit(1)) - top).alias("more")).where(F.col("more") > 0).select(
        F.lit(top + 1).cast("long").alias("row_no"),
        F.lit(None).cast("string").alias("start"),
        F.lit(None).cast("string").alias("end"),
        F.lit(None).cast("long").alias("event_count"),
        F.lit(None).cast("double").alias("max_risk"),
        F.lit(None).cast("string").alias("sources"),
        F.col("more").cast("long").alias("more"),
    )
    return rows.unionByName(more)


def _numbered(df: DataFrame, order: Sequence[Column | str], text: Column, section: int) -> DataFrame:
    s = drop_layout(sequence(df.withColumn("_text", text), order))
    return s.select(F.lit(section).alias("section_no"), F.col(SEQ).alias("line_no"), F.col("_text").alias("text"))


def _lines(head: DataFrame, section: int, first: int, lines: Column) -> DataFrame:
    """An array of lines of a one-row frame as rows, numbered from ``first`` on."""
    out = head.select(F.posexplode(lines).alias("_i", "text"))
    return out.select(F.lit(section).alias("section_no"), (F.col("_i") + first).cast("long").alias("line_no"), "text")


def _with_header(body: DataFrame, count: DataFrame, section: int, header: Sequence[Column], empty: str) -> DataFrame:
    """Heading, the lines above the body (or the sentence of an empty section), body.
    Lines before the body have numbers up to 0."""
    blank = F.lit("")
    above = F.when(F.col("n") > 0, F.array(*header)).otherwise(F.array(F.lit(empty), blank))
    lines = F.concat(F.array(blank, F.lit(f"## {HEADINGS[section]}"), blank), above)
    return _lines(count, section, -9, lines).unionByName(body)


def report_lines_deviations(devs: DataFrame, section: int = 3) -> DataFrame:
    body = _numbered(devs, ["phase", "timestamp", "id", "sub"], F.format_string("- **[%s]** %s", "type", "description"), section)
    cnt = devs.agg(F.count(F.lit(1)).alias("n"))
    return _with_header(body, cnt, section, [F.format_string("**%d deviation(s) found**", F.col("n")), F.lit("")], EMPTY["deviations"])


def report_lines_anomalies(anoms: DataFrame, section: int = 4) -> DataFrame:
    text = F.format_string(
        "- **[severity: %s] (score: %s)** %s", F.coalesce("anomaly_severity", F.lit("?")), fmt1(F.coalesce("score", F.lit(0.0))), "description"
    )
    body = _numbered(anoms, ["phase", SEQ, "sub"], text, section)
    cnt = anoms.agg(F.count(F.lit(1)).alias("n"))
    return _with_header(body, cnt, section, [F.format_string("**%d anomaly(ies) found**", F.col("n")), F.lit("")], EMPTY["anomalies"])


def report_lines_evidence(chain: DataFrame, section: int = 5) -> DataFrame:
    text = F.format_string(
        "| %s | %s… | %s | %s |",
        F.coalesce("evidence_id", F.lit("?")),
        prefix(F.coalesce("hash", F.lit("?")), 16),
        F.coalesce("collector", F.lit("?")),
        prefix(F.coalesce("timestamp", F.lit("?")), 19),
    )
    body = _numbered(chain.withColumnRenamed(SEQ, "entry_seq"), ["chain_id", "entry_seq"], text, section)
    cnt = chain.agg(F.count(F.lit(1)).alias("n"))
    header = [F.format_string("**%d evidence entries**", F.col("n")), F.lit(""), F.lit("| ID | Hash | Collector | Timestamp |"), F.lit("|---|---|---|---|")]
    return _with_header(body, cnt, section, header, EMPTY["evidence"])


def report_lines_timeline(df: DataFrame, section: int = 1) -> DataFrame:
    t = report_timeline(df)
    text = F.when(
        F.col("more") > 0, F.format_string("| ... | *%d more events* | | | | |", F.col("more"))
    ).otherwise(F.format_string("| %d | %s | %s | %s | %s | %s |", "row_no", "source", "severity", "event", "time", fmt1("risk")))
    body = t.select(F.lit(section).alias("section_no"), F.col("row_no").cast("long").alias("line_no"), text.alias("text"))
    cnt = df.agg(F.count(F.lit(1)).alias("n"))
    return _with_header(body, cnt, section, [F.lit("| # | Source | Severity | Event | Timestamp | Risk |"), F.lit("|---|---|---|---|---|---|")], EMPTY["timeline"])


def report_lines_groups(groups: DataFrame, section: int = 2) -> DataFrame:
    g = report_groups(groups)
    text = F.when(F.col("more") > 0, F.format_string("- … %d more groups", F.col("more"))).otherwise(
        F.format_string("- Window: %s → %s | %d events | Risk: %s | Sources: %s", "start", "end", "event_count", fmt1("max_risk"), "sources")
    )
    body = g.select(F.lit(section).alias("section_no"), F.col("row_no").cast("long").alias("line_no"), text.alias("text"))
    cnt = groups.agg(F.count(F.lit(1)).alias("n"))
    return _with_header(body, cnt, section, [F.format_string("**%d correlated group(s) found**", F.col("n")), F.lit("")], EMPTY["groups"])


def report_markdown(
    timeline: DataFrame,
    groups: DataFrame,
    anomalies: DataFrame,
    deviations: DataFrame,
    chain: DataFrame | None = None,
    incident_id: str = "INC-UNKNOWN",
    generated_at: str | None = None,
) -> DataFrame:
    """The whole document as (section_no, line_no, text); order by the first two."""
    header = F.array(
        F.lit("# Agent Forensics Report"),
        F.lit(""),
        F.concat(F.lit("**Report generated**: "), "generated_at"),
        F.concat(F.lit("**Incident ID**: "), "incident_id"),
        F.concat(F.lit("**Total events**: "), F.col("event_count").cast("string")),
        F.concat(F.lit("**Sources**: "), "sources"),
        F.lit(""),
        F.lit("---"),
    )
    # every section counts its findings and lists them: each frame is computed once
    groups, anomalies, deviations = _keep(groups), _keep(anomalies), _keep(deviations)
    chain = None if chain is None else _keep(chain)
    one = timeline.sparkSession.range(1)
    if chain is None:
        no_rows = one.where("false").select(F.lit(5).alias("section_no"), F.col("id").alias("line_no"), F.lit("").alias("text"))
        evidence = _with_header(no_rows, one.select(F.lit(0).alias("n")), 5, [F.lit("")], EMPTY["evidence"])
    else:
        evidence = report_lines_evidence(chain)
    parts = [
        _lines(report_header(timeline, incident_id, generated_at), 0, 0, header),
        report_lines_timeline(timeline),
        report_lines_groups(groups),
        report_lines_deviations(deviations),
        report_lines_anomalies(anomalies),
        evidence,
        _lines(one, 6, -9, F.array(F.lit(""), F.lit(f"## {HEADINGS[6]}"), F.lit(""), F.lit(RAW_EVIDENCE))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report_json(
    timeline: DataFrame,
    groups: DataFrame,
    anomalies: DataFrame,
    deviations: DataFrame,
    chain: DataFrame | None = None,
    members: DataFrame | None = None,
    incident_id: str = "INC-UNKNOWN",
    generated_at: str | None = None,
) -> DataFrame:
    """One JSON document per item, tagged with its section (JSON lines): the header,
    then the items of each section. ``members`` (labelled events of
    ``assign_groups``) gives the groups' events, one row each, under ``group_events``."""

    def tag(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("json"))

    header = report_header(timeline, incident_id, generated_at)
    header = header.withColumn("sources", F.when(F.col("sources") == "", F.array().cast("array<string>")).otherwise(F.split("sources", ", ")))
    parts = [tag(header, "header"), tag(timeline, "timeline"), tag(groups, "groups"), tag(anomalies, "anomalies"), tag(deviations, "deviations")]
    if members is not None:
        parts.append(tag(members, "group_events"))
    if chain is not None:
        parts.append(tag(chain, "evidence_chain"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def incident_summary(events: DataFrame, anomalies: DataFrame, deviations: DataFrame) -> DataFrame:
    """Per incident: title, worst severity, summary text, anomaly and deviation
    counts and recommendations (partial aggregates joined on the incident id)."""
    ev = events.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.max(severity_rank("severity")).alias("_rank"),
        F.count_if(F.coalesce("blocked", F.lit(False))).alias("blocked_count"),
        F.array_sort(F.collect_set("source")).alias("_src"),
    )
    an = anomalies.groupBy("incident_id").agg(F.count(F.lit(1)).alias("anomalies_count"))
    dv = deviations.groupBy("incident_id").agg(F.count(F.lit(1)).alias("deviations_count"))
    j = ev.join(an, "incident_id", "left").join(dv, "incident_id", "left").fillna(0, ["anomalies_count", "deviations_count"])
    sev = F.try_element_at(F.array(*[F.lit(s) for s in ("info", "low", "medium", "high", "critical")]), F.col("_rank") + 1)
    flags = {
        "anomalies": F.col("anomalies_count") > 0,
        "deviations": F.col("deviations_count") > 0,
        "blocked": F.col("blocked_count") > 0,
        "critical": F.col("_rank") >= 4,
    }
    recs = F.filter(F.array(*[F.when(flags[k], F.lit(text)) for k, text in RECOMMENDATIONS]), lambda x: x.isNotNull())
    return j.select(
        "incident_id",
        F.concat(F.lit("Incident "), F.col("incident_id")).alias("title"),
        F.coalesce(sev, F.lit("unknown")).alias("severity"),
        F.format_string("%d events from %s", F.col("event_count"), F.array_join("_src", ", ")).alias("timeline_summary"),
        "event_count",
        F.col("anomalies_count").cast("long").alias("anomalies_count"),
        F.col("deviations_count").cast("long").alias("deviations_count"),
        recs.alias("recommendations"),
    )


def analysis_view(findings: DataFrame, text_len: int = 60) -> DataFrame:
    """Listing rows of anomalies or deviations: type, severity, score, and the
    description cut to ``text_len`` characters (60 for anomalies, 80 for
    deviations in the studied CLI)."""
    cols = findings.columns
    sev = F.col("anomaly_severity") if "anomaly_severity" in cols else F.lit(None).cast("string")
    score = F.col("score") if "score" in cols else F.lit(None).cast("double")
    return findings.select(
        "type",
        sev.alias("severity"),
        score.alias("score"),
        prefix(F.coalesce("description", F.lit("")), text_len).alias("text"),
        *[c for c in ("id", "agent_id", "phase", "sub") if c in cols],
    )


def analysis_bundle(
    events: DataFrame,
    high_frequency_threshold: float = 0.5,
    rare_event_types: Sequence[str] = (),
    policy=None,
    partition_by: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """What the analyze command reports: event count, anomalies, deviations and
    the compliance summary, all derived from one persisted event frame."""
    from sleuth.operators import anomalies as A
    from sleuth.operators import compliance as C
    from sleuth.operators import deviations as D

    ev = _keep(events)
    return {
        "event_count": ev.agg(F.count(F.lit(1)).alias("event_count")),
        "anomalies": A.detect_anomalies(ev, high_frequency_threshold, rare_event_types, partition_by),
        "deviations": D.diff_behavior(ev, None, policy, partition_by),
        "compliance": C.compliance_summary(ev, partition_by),
    }
