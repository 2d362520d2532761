"""Query registry: every operator as a query over the driver tables, and the
equivalent DuckDB SQL used as the correctness oracle.

Each query reads whole tables (no row caps); limits appear only where the
limit *is* the feature (a page of the timeline, the recent-20 panel, the
report's top-50 / top-10 sections).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sleuth.functions.columns import normalize_timestamp, safe_json, sha256_hex, strip_ws
from sleuth.operators import anomalies as A
from sleuth.operators import compliance as C
from sleuth.operators import correlate as G
from sleuth.operators import deviations as D
from sleuth.operators import evidence as E
from sleuth.operators import replay as R
from sleuth.operators import reports as P
from sleuth.operators import timeline as TL
from sleuth.plans.ordering import with_position
from sleuth.sources import readers as RD
from sleuth.sources import sinks as SK
from sleuth.sources.tables import AS_OF, agent_events, read_table, stream_agent_events

Q = Callable[[SparkSession, str], DataFrame]
AGENT = ["agent_id"]
TL_COLS = ["id", "timestamp", "source", "event_type", "severity", "risk_score", "blocked"]
SPLIT_DAY = "2024-01-11"
CHAIN_TIME = "2024-01-01T00:00:00+00:00"
DOC_PATH_RULES = ["MIT License", "token", "@", "license", "src3"]
EVENT_POLICY = {"blocked_tools": ["error"], "blocked_paths": ["user/12", "USER 7"], "max_risk_score": 9.0}


def _ae(spark: SparkSession, d: str) -> DataFrame:
    return agent_events(spark, d)


# --------------------------------------------------------------------------- timeline
def q_timeline_first_100(s, d):
    return TL.query_events(_ae(s, d), limit=100).select(*TL_COLS)


def q_timeline_offset_page(s, d):
    return TL.query_events(_ae(s, d), limit=50, offset=200).select(*TL_COLS)


def q_timeline_from_offset(s, d):
    """The last tenth of the log: an offset without a limit."""
    ev = _ae(s, d)
    return TL.query_events(ev, offset=ev.count() * 9 // 10).select(*TL_COLS)


def q_timeline_deep_page(s, d):
    """The last 50 rows of the log, sought by position."""
    ev = _ae(s, d)
    return TL.seek(ev, TL.TEXT_ORDER, max(0, ev.count() - 50)).orderBy(*TL.TEXT_ORDER).limit(50).select(*TL_COLS)


def q_query_by_source(s, d):
    return TL.query_events(_ae(s, d), source="agentgate").select(*TL_COLS)


def q_query_by_type(s, d):
    return TL.query_events(_ae(s, d), event_type="error").select(*TL_COLS)


def q_query_by_severity(s, d):
    return TL.query_events(_ae(s, d), severity="critical").select(*TL_COLS)


def q_query_by_min_risk(s, d):
    return TL.query_events(_ae(s, d), min_risk=8.0).select(*TL_COLS)


def q_query_combined(s, d):
    return TL.query_events(_ae(s, d), source="mcpguard", event_type="view", severity="high", min_risk=7.0).select(*TL_COLS)


def q_build_timeline(s, d):
    return TL.build_timeline(_ae(s, d)).select("seq", "id", "timestamp")


def q_build_timeline_first_500(s, d):
    return TL.build_timeline(_ae(s, d), limit=500).select("seq", "id", "timestamp")


def q_distinct_sources(s, d):
    return TL.sources(_ae(s, d))


def q_distinct_event_types(s, d):
    return TL.event_types(_ae(s, d))


def q_severity_counts(s, d):
    return TL.severity_counts(_ae(s, d))


def q_severity_distribution(s, d):
    return TL.severity_distribution(_ae(s, d))


def q_event_count(s, d):
    return TL.event_count(_ae(s, d))


def q_dashboard_stats(s, d):
    return TL.dashboard_stats(_ae(s, d))


def q_recent_events(s, d):
    return TL.recent_events(_ae(s, d)).select(*TL_COLS)


def q_timeline_view(s, d):
    return TL.timeline_view(_ae(s, d)).select("row_no", "id", "source", "severity", "event", "target", "status", "time")


def q_timeline_points(s, d):
    return TL.timeline_points(_ae(s, d))


def q_risk_series(s, d):
    return TL.risk_series(_ae(s, d))


def q_list_incidents(s, d):
    return TL.list_incidents(_ae(s, d)).select("incident_id", "event_count", F.array_join("sources", ",").alias("sources"))


def q_incident_summary(s, d):
    ev = _ae(s, d)
    anoms = A.high_risk(ev)
    devs = D.risk_limit(ev, 5.0)
    out = P.incident_summary(ev, anoms, devs)
    return out.withColumn("recommendations", F.array_join("recommendations", "; "))


def q_report_header(s, d):
    return P.report_header(_ae(s, d), incident_id="INC-ALL", generated_at=AS_OF)


# --------------------------------------------------------------------------- anomalies
ANOM_COLS = ["id", "type", "anomaly_severity", "score"]


def q_anomalies_high_risk(s, d):
    return A.high_risk(_ae(s, d)).select(*ANOM_COLS)


def q_anomalies_rare_type(s, d):
    return A.rare_event_type(_ae(s, d), ["signup"]).select(*ANOM_COLS)


def q_anomalies_burst(s, d):
    return A.high_frequency(_ae(s, d)).select(*ANOM_COLS)


def q_anomalies_burst_by_agent(s, d):
    return A.high_frequency(_ae(s, d), 0.001, AGENT).select(*ANOM_COLS, "agent_id")


def q_anomalies_repetition(s, d):
    return A.repetition(_ae(s, d), first_only=False).select(*ANOM_COLS)


def q_anomalies_repetition_by_agent(s, d):
    return A.repetition(_ae(s, d), AGENT, first_only=False).select(*ANOM_COLS, "agent_id")


def q_anomalies_first_repetition_by_agent(s, d):
    return A.repetition(_ae(s, d), AGENT, first_only=True).select(*ANOM_COLS, "agent_id")


def q_anomalies_blocked_chain(s, d):
    return A.blocked_chain(_ae(s, d)).select(*ANOM_COLS, "run_length", "at_end")


def q_anomalies_blocked_chain_by_agent(s, d):
    return A.blocked_chain(_ae(s, d), AGENT).select(*ANOM_COLS, "run_length", "at_end", "agent_id")


def q_anomalies_all(s, d):
    return A.detect_anomalies(_ae(s, d), rare_event_types=["signup"]).select(*ANOM_COLS, "phase", "sub")


# --------------------------------------------------------------------------- correlation / replay
GROUP_COLS = ["group_id", "window_start", "window_end", "event_count", "max_risk"]


def _groups(df: DataFrame) -> DataFrame:
    return df.select(*GROUP_COLS, F.array_join("sources", ",").alias("sources"), F.array_join("types", ",").alias("types"))


def q_correlate_groups(s, d):
    return _groups(G.correlate(_ae(s, d), 3600))


def q_correlate_groups_600(s, d):
    return _groups(G.correlate(_ae(s, d), 600))


def q_correlate_by_agent(s, d):
    return _groups(G.correlate(_ae(s, d), 600, AGENT))


def q_replay_delays_by_agent(s, d):
    return R.replay_schedule(_ae(s, d), speed=2.0, partition_by=AGENT).select("id", "agent_id", "replay_delay_us", "replay_offset_us")


def q_replay_offsets(s, d):
    return R.replay_schedule(_ae(s, d), speed=2.0).select("id", "replay_delay_us", "replay_offset_us")


def q_replay_first_100(s, d):
    return R.replay_schedule(_ae(s, d), speed=1.0, limit=R.REPLAY_LIMIT).select("id", "replay_delay_us")


# --------------------------------------------------------------------------- deviations / policy
def _split(s, d):
    ev = _ae(s, d)
    expected = ev.where(F.col("timestamp") < SPLIT_DAY)
    # one derived expected type: every expected signup also expects a shutdown
    expected = expected.unionByName(expected.where(F.col("event_type") == "signup").withColumn("event_type", F.lit("shutdown")))
    return ev.where(F.col("timestamp") >= SPLIT_DAY), expected


def q_diff_missing(s, d):
    act, exp = _split(s, d)
    return D.missing_actions(act, exp, AGENT).select("agent_id", "event_type", "n_expected", "n_actual", "id")


def q_diff_extra(s, d):
    act, exp = _split(s, d)
    return D.extra_actions(act, exp, AGENT).select("agent_id", "event_type", "id")


def q_diff_all(s, d):
    act, exp = _split(s, d)
    return D.diff_behavior(act, exp, EVENT_POLICY, AGENT).select("type", "event_side", "phase", "sub", "id", "agent_id")


def q_policy_tools(s, d):
    return D.blocked_tool(_ae(s, d), ["purchase", "signup"]).select("id", "rule", "event_type")


def _docs_as_events(s, d):
    return read_table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("target"), F.col("text").alias("description"))


def q_policy_paths(s, d):
    return D.blocked_path(_docs_as_events(s, d), DOC_PATH_RULES).select("id", "rule")


def q_policy_rule_list(s, d):
    """A thousand paths in an order of their own: many contain one another."""
    rules = [f"USER/{i * 7919 % 1000}" for i in range(1000)]
    return D.blocked_path(_ae(s, d), rules).select("id", "rule")


def q_policy_risk(s, d):
    return D.risk_limit(_ae(s, d), 5.0).select("id", "rule", "risk_score")


def q_policy_all(s, d):
    pv = D.policy_violations(_ae(s, d), EVENT_POLICY)
    return pv.select("id", "sub", F.coalesce("rule", F.lit("")).alias("rule"))


# --------------------------------------------------------------------------- compliance
FACT_COLS = ["events", "source_count", "blocked_count", "has_anomalies"]


def q_compliance_facts(s, d):
    return C.compliance_facts(_ae(s, d)).select(*FACT_COLS)


def q_compliance_facts_by_agent(s, d):
    return C.compliance_facts(_ae(s, d), AGENT).select("agent_id", *FACT_COLS)


def q_compliance_checks(s, d):
    return C.compliance_checks(_ae(s, d)).select("check_no", "id", "title", "category", "status", "details")


def q_compliance_checks_by_agent(s, d):
    return C.compliance_checks(_ae(s, d), AGENT).select("agent_id", "check_no", "id", "status", "details")


def q_compliance_summary(s, d):
    return C.compliance_summary(_ae(s, d))


def q_compliance_summary_by_agent(s, d):
    return C.compliance_summary(_ae(s, d), AGENT)


def q_tool_policy(s, d):
    return C.tool_policy(_ae(s, d), AGENT)


def q_adjusted_rate(s, d):
    rep = C.tool_decisions(C.compliance_report(_ae(s, d), AGENT), rate_limit=100)
    return rep.select("agent_id", "failed", "rate_limit", C.has_anomalies(rep).alias("anomalous"))


def q_policy_from_checks(s, d):
    """A check per agent and event type: details that name a tool, an anomaly, nothing."""
    n, risk = F.count(F.lit(1)), F.max("risk_score")
    kind = F.col("event_type")
    details = (F.when(kind == "click", F.concat(F.lit("READ_FILE used "), n.cast("string"), F.lit(" times")))
               .when(kind == "view", F.when(risk >= 9, F.lit("calls HTTP_request")).otherwise(F.lit("quiet")))
               .when(kind == "error", F.when(n % 5 == 0, F.lit("Anomalous delete_file")).otherwise(F.lit("none")))
               .when(kind == "purchase", F.lit("sql_query, write_file")))
    checks = _ae(s, d).groupBy("agent_id", "event_type").agg(F.when(n % 3 == 0, "pass").otherwise("fail").alias("status"), details.alias("details"))
    out = C.policy_from_checks(checks, AGENT)
    return out.select("agent_id", "failed", "anomalous", F.array_join("deny", ",").alias("deny"), F.array_join("allow", ",").alias("allow"), "rate_limit")


def q_policy_text(s, d):
    return C.policy_lines(_ae(s, d))


# --------------------------------------------------------------------------- export
def q_security_event_payload(s, d):
    p = SK.to_security_event(_ae(s, d), keep=("id",))
    return p.select("id", "event_type", "severity", "message", "source", "tool", "blocked",
                    F.col("details.risk_score").alias("risk_score"), F.col("details.source").alias("origin"))


def q_compliance_payload(s, d):
    rep = C.compliance_report(_ae(s, d))
    return SK.compliance_payload(rep).select("source", F.to_json("raw").alias("raw"))


def _out(s, name: str) -> str:
    from sleuth.streaming.alerts import stream_output_dir

    return f"{stream_output_dir(s)}/{name}"


def q_compliance_payload_file(s, d):
    """Every agent's payload written as JSON lines, read back as rows of checks."""
    path = _out(s, "payload")
    SK.export_compliance_payload(C.compliance_report(_ae(s, d), AGENT), path, AGENT)
    check = "struct<id: string, title: string, category: string, status: string, details: string>"
    back = s.read.schema(f"agent_id string, source string, raw struct<framework: string, status: string, passed: long, total_checks: long, checks: array<{check}>>").json(path)
    return back.select("agent_id", "source", "raw.framework", F.col("raw.status").alias("verdict"), "raw.passed", "raw.total_checks", F.explode("raw.checks").alias("c")).select(
        "agent_id", "source", "framework", "verdict", "passed", "total_checks", "c.id", "c.title", "c.category", "c.status", "c.details")


def q_policy_file(s, d):
    path = _out(s, "policy")
    SK.write_policy(C.policy_lines(_ae(s, d)), path)
    return s.read.text(path).groupBy(F.col("value").alias("text")).agg(F.count(F.lit(1)).alias("n"))


def q_report_file_evidence(s, d):
    """The report's evidence section written as text, and its lines read back."""
    path = _out(s, "report")
    SK.write_report(P.report_lines_evidence(_conversation_chain(s, d)), path)
    return s.read.text(path).groupBy(F.col("value").alias("text")).agg(F.count(F.lit(1)).alias("n"))


def q_report_lines_anomalies(s, d):
    return P.report_lines_anomalies(A.detect_anomalies(_ae(s, d))).select("line_no", "text")


def q_stream_ingest(s, d):
    """Guard log files of all events, ingested as a stream into the event table."""
    from sleuth.streaming.ingest import stream_ingest

    logs, table = _out(s, "logs"), _out(s, "table")
    _lines_for(_ae(s, d)).select("value").repartition(8).write.text(logs)
    stream_ingest(s, logs, table, _out(s, "checkpoint"), as_of=AS_OF).awaitTermination()
    return s.read.parquet(table).select("source", "event_type", "severity", "title", "description", "target", "blocked", "risk_score", "timestamp", "agent_id", "incident_id")


# --------------------------------------------------------------------------- evidence
def _conversation_chain(s, d):
    conv = read_table(s, d, "conversations")
    return E.build_chain(
        conv,
        "conv_id",
        "turn",
        evidence_id=F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")),
        data_hash=sha256_hex("text"),
        collector=F.col("role"),
        collected_at=F.lit(CHAIN_TIME),
    )


def q_evidence_chain_texts(s, d):
    """Chains by source whose ids are whole texts (quotes, line breaks, letters
    beyond ASCII), with a NULL and an odd collector and metadata."""
    docs = read_table(s, d, "documents")
    who = F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit('"é\u2028\\'), F.col("lang")))
    chain = E.build_chain(docs, "source", "doc_id", F.col("text"), sha256_hex("text"), who, F.lit(CHAIN_TIME),
                          F.create_map(F.lit("lang"), F.col("lang"), F.lit("ñ"), F.lit(None).cast("string")))
    return chain.select("chain_id", "seq", "parent_hash", "entry_hash")


def q_evidence_chain_appends(s, d):
    """The conversations' chains, stored in three appends and read back."""
    from sleuth.streaming.alerts import stream_output_dir

    path = f"{stream_output_dir(s)}/chains"
    conv = read_table(s, d, "conversations")
    third = F.ntile(3).over(Window.partitionBy("conv_id").orderBy("turn"))  # a conversation's turns are few
    parts = conv.withColumn("_part", third)
    for k in (1, 2, 3):
        E.append_chain(
            parts.where(F.col("_part") == k), path, "conv_id", "turn",
            F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")),
            sha256_hex("text"), F.col("role"), F.lit(CHAIN_TIME), expected=k - 1,
        )
    return E.read_chain(s, path).select("chain_id", "seq", "evidence_id", "hash", "parent_hash", "entry_hash")


def q_evidence_nested_metadata(s, d):
    """Chains by user whose metadata has several levels, numbers of each kind and lists."""
    ev = _ae(s, d)
    meta = F.struct(
        F.struct(F.col("risk_score").alias("risk"), (F.col("risk_score") / 1e7).alias("part"), F.col("blocked").alias("blocked")).alias("z"),
        F.array(F.col("id"), F.lit(None).cast("long")).alias("ids"),
        F.struct(F.array(F.struct(F.col("event_type").alias("é"), F.lit(1e20).alias("a"))).alias("rows")).alias("b"),
        F.lit(None).cast("string").alias("none"),
    )
    chain = E.build_chain(ev, "agent_id", "id", F.col("id").cast("string"), sha256_hex("event_type"), F.col("source"), F.lit(CHAIN_TIME), meta)
    return chain.select("chain_id", "seq", "metadata_json", "parent_hash", "entry_hash")


def q_evidence_get_chain(s, d):
    return E.get_chain(_conversation_chain(s, d), "1").select("chain_id", "seq", "evidence_id", "parent_hash", "entry_hash")


def q_normalize_times(s, d):
    """Epoch seconds, texts with an offset (replaced by UTC), and texts that are no time."""
    ev = _ae(s, d)
    as_of = F.to_timestamp(F.lit(AS_OF))
    micros = lambda c: F.unix_micros(normalize_timestamp(c, as_of))
    offset = F.concat(F.expr("rtrim('Z', timestamp)"), F.lit("+02:00"))
    return ev.select("id", micros(F.col("epoch")).alias("from_number"), micros(F.col("id")).alias("from_int"),
                     micros(offset).alias("from_offset"), micros(F.col("event_type")).alias("from_word"))


def q_safe_json(s, d):
    """Objects as maps; texts that are no object give an empty map."""
    ev = _ae(s, d).select("id", F.when(F.col("id") % 3 == 0, F.col("title")).otherwise(F.to_json(F.struct("event_type", F.col("id").alias("n")))).alias("t"))
    m = safe_json("t")
    return ev.select("id", F.size(m).alias("n_keys"), F.try_element_at(m, F.lit("event_type")).alias("event_type"), F.try_element_at(m, F.lit("n")).alias("n"))


def q_replay_on_batch(s, d):
    slow = lambda df: df.where(F.col("replay_delay_us") > 5e8)
    return R.replay_schedule(_ae(s, d), speed=2.0, on_batch=slow).select("id", "replay_delay_us")


def q_evidence_hashes(s, d):
    return E.hash_evidence(read_table(s, d, "documents"), "text").select("doc_id", "hash")


def q_evidence_chain(s, d):
    return _conversation_chain(s, d).select("chain_id", "seq", "evidence_id", "hash", "parent_hash", "entry_hash")


def q_evidence_verify(s, d):
    return E.verify_chain(_conversation_chain(s, d))


def _tampered(s, d):
    ch = _conversation_chain(s, d)
    return ch.withColumn("entry_hash", F.when(F.col("seq") == 2, F.sha2(F.col("entry_hash"), 256)).otherwise(F.col("entry_hash")))


def q_evidence_tampered(s, d):
    return E.chain_errors(_tampered(s, d))


def q_evidence_tampered_verify(s, d):
    return E.verify_chain(_tampered(s, d))


# --------------------------------------------------------------------------- readers
def q_generic_plain_lines(s, d):
    lines = RD.lines_from_text(read_table(s, d, "documents"), "doc_id", "text")
    plain = RD.parse_plain(lines, as_of=AS_OF)
    return plain.select(F.col("_file").cast("long").alias("doc_id"), F.col("_lineno").alias("lineno"),
                        F.get_json_object("raw_json", "$.line").alias("line"))


def _format_lines(s, d) -> DataFrame:
    """Four pseudo log files per agent, one per format, rendered from its events."""
    ev = _ae(s, d).select("agent_id", "id", "timestamp", "event_type", "risk_score")  # what the lines have
    pos = with_position(ev, ["timestamp", "id"], AGENT, out="pos")
    uid = F.col("agent_id")
    json_line = F.to_json(F.struct("timestamp", "event_type", F.col("risk_score").alias("risk"), "id"))
    csv_line = F.concat_ws(",", "timestamp", "event_type", F.col("id").cast("string"))
    sys_line = F.format_string("%s host-%s app[%d]: %s at %s", F.date_format(F.to_timestamp_ntz("timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")), "MMM d HH:mm:ss"), uid, F.col("id"), F.col("event_type"), F.col("timestamp"))
    plain_line = F.format_string("%s event %d for user %s", F.col("event_type"), F.col("id"), uid)
    rendered = pos.select(
        uid,
        "pos",
        F.explode(F.array(
            F.struct(F.lit("jsonl").alias("fmt"), json_line.alias("value"), F.col("pos").alias("lineno")),
            F.struct(F.lit("csv").alias("fmt"), csv_line.alias("value"), (F.col("pos") + 1).alias("lineno")),
            F.struct(F.lit("syslog").alias("fmt"), sys_line.alias("value"), F.col("pos").alias("lineno")),
            F.struct(F.lit("plain").alias("fmt"), plain_line.alias("value"), F.col("pos").alias("lineno")),
        )).alias("l"),
    ).select(F.concat(F.col("l.fmt"), F.lit("/"), uid).alias("file"), F.col("l.lineno").cast("long").alias("lineno"), F.col("l.value").alias("value"))
    headers = ev.select(uid).distinct().select(
        F.concat(F.lit("csv/"), uid).alias("file"), F.lit(1).cast("long").alias("lineno"), F.lit("timestamp,event_type,id").alias("value")
    )
    return rendered.unionByName(headers)


def q_detect_format(s, d):
    return RD.detect_format(_format_lines(s, d))


def q_parse_jsonl(s, d):
    lines = _format_lines(s, d).where(F.col("file").startswith("jsonl/"))
    ev, _ = RD.parse_jsonl(lines, as_of=AS_OF)
    return ev.select(F.col("_file").alias("file"), F.col("_lineno").alias("lineno"), "timestamp",
                     F.get_json_object("raw_json", "$.event_type").alias("event_type"),
                     F.get_json_object("raw_json", "$.id").cast("long").alias("id"))


def q_parse_syslog(s, d):
    lines = _format_lines(s, d).where(F.col("file").startswith("syslog/"))
    ev = RD.parse_syslog(lines, as_of=AS_OF)
    return ev.select(F.col("_file").alias("file"), F.col("_lineno").alias("lineno"), "timestamp", F.col("_hostname").alias("hostname"),
                     F.get_json_object("raw_json", "$.application").alias("application"),
                     F.get_json_object("raw_json", "$.message").alias("message"))


def q_parse_generic_auto(s, d):
    ev, _ = RD.parse_generic_lines(_format_lines(s, d), as_of=AS_OF)
    return ev.select(F.col("_file").alias("file"), F.col("_lineno").alias("lineno"), F.col("_format").alias("format"), "source", "event_type",
                     "severity", "confidence", "blocked", "risk_score", "timestamp", F.round("epoch", 6).alias("epoch"), "title", "target")


def q_parse_csv(s, d):
    lines = _format_lines(s, d).where(F.col("file").startswith("csv/"))
    ev = RD.parse_csv(lines, as_of=AS_OF)
    return ev.select(F.col("_file").alias("file"), F.col("_lineno").alias("lineno"), "timestamp",
                     F.get_json_object("raw_json", "$.event_type").alias("event_type"),
                     F.get_json_object("raw_json", "$.id").cast("long").alias("id"))


def q_csv_quoted_records(s, d):
    """All documents written as comma-separated files, texts quoted with their line
    breaks, and read back as records over several lines."""
    from sleuth.streaming.alerts import stream_output_dir

    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    docs = read_table(s, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text")
    body = docs.select(F.concat_ws(",", "doc_id", quoted(F.col("text")), F.coalesce("source", F.lit(""))).alias("value"))
    path = f"{stream_output_dir(s)}/csv"
    # a file for each task: a header and its records
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    body = body.withColumn("value", F.concat(F.when(first, F.lit("time,text,source\n")).otherwise(""), "value"))
    body.write.option("maxRecordsPerFile", 0).text(path)
    events, _ = RD.parse_csv_lines(RD.read_lines(s, path), as_of=AS_OF)
    raw = F.from_json("raw_json", "text string, source string")
    return events.select(F.col("timestamp").cast("long").alias("doc_id"), F.sha2(raw["text"], 256).alias("text_sha256"),
                         F.char_length(raw["text"]).alias("n_chars"), raw["source"].alias("source"))


def _guard_lines(s, d) -> DataFrame:
    return _lines_for(_ae(s, d))


def _lines_for(ev: DataFrame) -> DataFrame:
    """Guard audit-log lines (one JSON object per event), one file per agent."""
    raw = F.to_json(F.struct("event_type", "severity", "title", "description", "target", "blocked", "timestamp", "risk_score", "agent_id", "incident_id"))
    return ev.select(F.concat(F.lit("guard/"), F.col("agent_id")).alias("file"), F.col("id").alias("lineno"), raw.alias("value"))


def q_guard_log_roundtrip(s, d):
    ev, _ = RD.parse_guard_lines(_guard_lines(s, d), as_of=AS_OF)
    return ev.select(F.col("_lineno").alias("id"), "source", "event_type", "severity", "blocked", "risk_score", "timestamp", "epoch", "agent_id")


def _gate_lines(ev: DataFrame) -> DataFrame:
    raw = F.to_json(F.struct(F.col("event_type").alias("signal_type"), F.round(F.col("risk_score") * 10).cast("int").alias("weight"),
                             F.lit("deny").alias("action"), F.col("target").alias("path"), F.col("timestamp"),
                             F.format_string("%.1f", F.col("risk_score")).alias("score")))
    return ev.select(F.lit("gate").alias("file"), F.col("id").alias("lineno"), raw.alias("value"))


def q_event_table(s, d):
    """Events appended in two writes to a table of files, and read back."""
    from sleuth.streaming.alerts import stream_output_dir

    path = f"{stream_output_dir(s)}/events"
    ev = _ae(s, d).withColumn("_from", F.col("id")).drop("id")
    for source in (F.col("source") == "mcpguard", F.col("source") != "mcpguard"):
        SK.append_events(ev.where(source), path, as_of=AS_OF, order=("timestamp", "_from"))
    return SK.read_event_table(s, path).select("id", "source", "event_type", "severity", "timestamp", "risk_score", "blocked", "agent_id")


def q_gate_signals(s, d):
    lines = _gate_lines(_ae(s, d).where(F.col("source") == "agentgate"))
    out, _ = RD.parse_gate_lines(lines, as_of=AS_OF)
    return out.select(F.col("_lineno").alias("id"), "source", "event_type", "blocked", "target", "timestamp", F.col("_signal_type").alias("signal_type"),
                      F.col("_weight").alias("weight"), F.col("_score").alias("score"), F.col("_action").alias("action"), F.col("_user_agent").alias("user_agent"))


def q_quarantine(s, d):
    lines = RD.lines_from_text(read_table(s, d, "documents"), "doc_id", "text")
    _, rejected = RD.parse_guard_lines(lines, as_of=AS_OF)
    return rejected.select(F.col("file").cast("long").alias("doc_id"), "lineno", "reason")


def q_quarantine_long_lines(s, d):
    lines = RD.lines_from_text(read_table(s, d, "documents"), "doc_id", "text")
    _, rejected = RD.parse_generic_lines(lines, "plain", AS_OF, line_cap=120)
    return rejected.select(F.col("file").cast("long").alias("doc_id"), "lineno", "reason", F.sha2("value", 256).alias("line_sha256"))


def q_ingest_counts(s, d):
    guard, _ = RD.parse_guard_lines(_guard_lines(s, d), as_of=AS_OF)
    return RD.ingest_counts(guard)


def q_ingest_batch(s, d):
    """Three readers' events and rejected lines written in one go, and counted."""
    from sleuth.streaming.alerts import stream_output_dir

    ev = _ae(s, d)
    words = RD.lines_from_text(read_table(s, d, "documents"), "doc_id", "text").withColumn("file", F.concat(F.lit("words/"), F.col("file").cast("string")))
    gate = _gate_lines(ev.where(F.col("source") == "agentgate")).unionByName(words.select("file", "lineno", "value"))
    parsed = {
        "guard": RD.parse_guard_lines(_lines_for(ev.where(F.col("source") == "mcpguard")), as_of=AS_OF),
        "gate": RD.parse_gate_lines(gate, as_of=AS_OF),
        "generic": RD.parse_generic_lines(_format_lines(s, d), as_of=AS_OF),
    }
    return SK.ingest_events(parsed, f"{stream_output_dir(s)}/ingested", AS_OF)


# --------------------------------------------------------------------------- reports
def q_report_timeline(s, d):
    return P.report_timeline(_ae(s, d))


def q_report_groups(s, d):
    return P.report_groups(G.correlate(_ae(s, d), 60))


def _findings(s, d):
    """Events, groups' events, anomalies, deviations (with expected events and a
    policy) and the custody chain, as the report takes them."""
    ev = _ae(s, d)
    actual, expected = _split(s, d)
    return ev, G.assign_groups(ev, 60), A.detect_anomalies(ev), D.diff_behavior(actual, expected, EVENT_POLICY, AGENT), _conversation_chain(s, d)


def q_report_markdown(s, d):
    ev, labelled, anoms, devs, chain = _findings(s, d)
    return P.report_markdown(ev, G.summarize_groups(labelled), anoms, devs, chain, incident_id="INC-ALL", generated_at=AS_OF)


def q_report_json(s, d):
    ev, labelled, anoms, devs, chain = _findings(s, d)
    return P.report_json(ev, G.summarize_groups(labelled), anoms, devs, chain, labelled, incident_id="INC-ALL", generated_at=AS_OF)


def q_union_sources(s, d):
    ev = _ae(s, d)
    guard, _ = RD.parse_guard_lines(_lines_for(ev.where(F.col("source") == "mcpguard")), as_of=AS_OF)
    gate, _ = RD.parse_gate_lines(_gate_lines(ev.where(F.col("source") == "agentgate")), as_of=AS_OF)
    generic, _ = RD.parse_generic_lines(_format_lines(s, d), as_of=AS_OF)
    return RD.union_sources(guard, gate, generic).select(
        F.col("_lineno").alias("lineno"), "source", "event_type", "severity", "confidence", "blocked", "risk_score", "timestamp", F.round("epoch", 6).alias("epoch"))


def _taxonomy(s):
    # a user-supplied mapping (source, key) -> category, severity, base risk
    rows = [
        ("mcpguard", "error", "tool_failure", "high", "medium", 7.0, "Tool failure"),
        ("mcpguard", "click", "ui_action", "low", "low", 1.0, "UI action"),
        ("mcpguard", "view", "data_access", "info", "low", 0.5, "Data access"),
    ]
    return s.createDataFrame(rows, "source string, key string, category string, severity string, confidence string, base_risk double, title string")


def q_guard_log_taxonomy(s, d):
    ev = _ae(s, d).where(F.col("source") == "mcpguard")
    out, _ = RD.parse_guard_lines(_lines_for(ev), taxonomy=_taxonomy(s), as_of=AS_OF)
    return out.select(F.col("_lineno").alias("id"), "event_type", "severity", "confidence", "title", "risk_score")


def q_analysis_view(s, d):
    ev = _ae(s, d)
    anoms = A.detect_anomalies(ev, 0.001, rare_event_types=["signup"], partition_by=AGENT)
    return P.analysis_view(anoms, 60).select("type", "severity", "score", "text", "id", "agent_id")


# --------------------------------------------------------------------------- streaming
def _streamed(s, stream: DataFrame) -> DataFrame:
    from sleuth.streaming.alerts import run_to_table, stream_output_dir

    out = stream_output_dir(s)
    run_to_table(stream, f"{out}/data", f"{out}/checkpoint")
    return s.read.schema(stream.schema).parquet(f"{out}/data")


def q_stream_high_risk(s, d):
    from sleuth.streaming.alerts import stateless_alerts

    return _streamed(s, stateless_alerts(stream_agent_events(s, d))).select("id", "type", "score")


def q_stream_bursts_by_agent(s, d):
    from sleuth.streaming.alerts import sequence_alerts

    out = _streamed(s, sequence_alerts(stream_agent_events(s, d), 0.001))
    return out.where(F.col("type") == "high_frequency").select("id", "type", "score", "agent_id")


def q_stream_chains_by_agent(s, d):
    from sleuth.streaming.alerts import sequence_alerts

    out = _streamed(s, sequence_alerts(stream_agent_events(s, d), 0.001))
    return out.where(F.col("type") == "blocked_chain").select("id", "score", "run_length", "agent_id")


SLICES = 20  # files that the event table is dealt to
BATCH_SLICES = 4  # files of a batch of the stream


def _out_of_order(s, d):
    """The events as a stream of ``SLICES`` files in order of time, but for some rows that
    stand a file earlier or later, and one in 101 that comes five files later; last a row
    far in the future, which lets the watermark pass all others."""
    from sleuth.streaming.alerts import stream_output_dir

    path = f"{stream_output_dir(s)}/in"
    ev = _ae(s, d).select("agent_id", "id", "timestamp", "epoch", "blocked", "event_ts")
    lo, hi = ev.agg(F.min("epoch"), F.max("epoch")).first()
    k = F.floor((F.col("epoch") - lo) / ((hi - lo) / (SLICES - 5) + 1)).cast("int")
    shift = F.when(F.col("id") % 101 == 0, 5).when(F.col("id") % 7 == 0, 1).when(F.col("id") % 7 == 1, -1).otherwise(0)
    dealt = ev.withColumn("_file", F.greatest(F.lit(0), k + shift))
    # dealt by all tasks in one pass; then each slice is written as one file, in order
    dealt.write.partitionBy("_file").parquet(f"{path}_dealt")
    schema = T.StructType([*ev.schema.fields, T.StructField("_file", T.IntegerType())])
    slices = s.read.schema(schema).parquet(f"{path}_dealt")
    # a batch's slices at once, each in a folder of its own; batches one after another, as files are read by age
    put = lambda i: slices.where(F.col("_file") == i).drop("_file").coalesce(1).write.parquet(f"{path}/{i:02d}")
    with ThreadPoolExecutor(BATCH_SLICES) as pool:
        for i in range(0, SLICES, BATCH_SLICES):
            list(pool.map(put, range(SLICES)[i : i + BATCH_SLICES]))
    end = ev.limit(1).select(F.lit("").alias("agent_id"), F.lit(-1).cast("long").alias("id"), F.lit("9999").alias("timestamp"), F.lit(4e9).alias("epoch"),
                             F.lit(False).alias("blocked"), F.timestamp_seconds(F.lit(4e9)).alias("event_ts"))
    end.coalesce(1).write.parquet(f"{path}/end")
    return s.readStream.schema(ev.schema).option("maxFilesPerTrigger", BATCH_SLICES).parquet(f"{path}/*"), (hi - lo) / (SLICES - 5) + 1


def _ordered_stream(s, d, slices_late: float):
    from sleuth.streaming.alerts import ordered_alerts, read_alerts, start_alerts, stream_output_dir

    stream, width = _out_of_order(s, d)
    out = stream_output_dir(s)
    found = ordered_alerts(stream, f"{int(width * slices_late * 1000)} milliseconds", 4e8, 0.001)
    start_alerts(found, out, f"{out}/checkpoint").awaitTermination()
    return read_alerts(s, out)


def q_stream_ordered_alerts(s, d):
    alerts, _ = _ordered_stream(s, d, 7.0)  # nothing is later than that
    return alerts.select("id", "type", "score", "run_length", "agent_id")


def q_stream_late_rows(s, d):
    _, late = _ordered_stream(s, d, 2.0)
    return late.select("id", "agent_id", "timestamp")


QUERIES: dict[str, Q] = {k[2:]: v for k, v in sorted(globals().items()) if k.startswith("q_") and callable(v)}
