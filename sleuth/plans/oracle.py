"""DuckDB SQL oracles for the registry (tables are pre-registered views).

Written independently of the Spark plans: plain window functions, recursive
CTEs for the sequential definitions (anchored groups, hash chains).
"""

from __future__ import annotations

from sleuth.sources.tables import AGENT_EVENTS_SQL, AS_OF

# Fixed values, stated here and not taken from the operators that they check.
CHECKS = [
    ("GOVERN-1", "Risk Management Process Established", "Govern"),
    ("GOVERN-2", "Roles and Responsibilities", "Govern"),
    ("MAP-1", "Agent Function and Purpose", "Map"),
    ("MAP-2", "Known Limitations Documented", "Map"),
    ("MEASURE-1", "Agent Behaviour Monitoring", "Measure"),
    ("MEASURE-2", "Anomaly Detection Active", "Measure"),
    ("MEASURE-3", "Incident Response Capability", "Measure"),
    ("MANAGE-1", "Policy Enforcement", "Manage"),
    ("MANAGE-2", "Evidence Chain of Custody", "Manage"),
    ("MANAGE-3", "Forensic Readiness", "Manage"),
]
ALWAYS_PASS = {
    "GOVERN-1": "Agent lifecycle risk management is in place via the guard and gate layers",
    "GOVERN-2": "Roles defined in the project metadata and security policy",
    "MAP-1": "Agent function documented in incident report",
    "MAP-2": "Limitations documented via policy deviations and anomalies",
    "MEASURE-3": "Incident reports can be generated via the report operators",
    "MANAGE-2": "SHA-256 chain of custody maintained via the evidence operators",
}
KNOWN_TOOLS = ["write_file", "http_request", "execute_command", "delete_file", "network_scan", "sql_query", "modify_system"]
DANGEROUS_TOOLS = ["exec", "shell", "sudo", "curl", "wget", "sql"]
SAFE_TOOLS = ["read_file", "get_weather", "search_web", "get_time", "calculate", "translate", "summarize", "list_directory"]

W = f"WITH ae AS ({AGENT_EVENTS_SQL})\n"
WR = f"WITH RECURSIVE ae AS ({AGENT_EVENTS_SQL})\n"
TL = "id, timestamp, source, event_type, severity, risk_score, blocked"


def _page(where: str = "", limit: int | None = None, offset: int = 0) -> str:
    w = f"WHERE {where}" if where else ""
    off = f" OFFSET {offset}" if offset else ""
    page = f" LIMIT {limit}" if limit is not None else ""
    return W + f"SELECT {TL} FROM ae {w} ORDER BY timestamp, id{page}{off}"


def _burst(threshold: float, by_agent: bool) -> str:
    part = "PARTITION BY agent_id " if by_agent else ""
    extra = ", agent_id" if by_agent else ""
    return W + f"""
SELECT id, 'high_frequency' AS type, 'medium' AS anomaly_severity, least(10.0, 3.0 / (epoch - e0) * 2) AS score{extra}
FROM (SELECT id, agent_id, epoch, lag(epoch, 2) OVER ({part}ORDER BY timestamp, id) AS e0 FROM ae)
WHERE e0 IS NOT NULL AND e0 <> 0 AND epoch <> 0 AND epoch - e0 > 0 AND 3.0 / (epoch - e0) > {threshold}"""


def _rep_hits(by_agent: bool) -> str:
    part = "PARTITION BY agent_id " if by_agent else ""
    lags = ", ".join(f"lag(event_type, {j}) OVER ({part}ORDER BY timestamp, id) AS t{j}" for j in range(1, 5))
    eq = " AND ".join(f"t{j} IS NOT DISTINCT FROM event_type" for j in range(1, 5))
    return f"""(SELECT * FROM (SELECT id, agent_id, event_type, {lags},
                row_number() OVER ({part}ORDER BY timestamp, id) AS rn FROM ae) WHERE rn >= 5 AND {eq})"""


def _repetition(by_agent: bool, first_only: bool) -> str:
    extra = ", agent_id" if by_agent else ""
    hits = _rep_hits(by_agent)
    if first_only:
        grp = "PARTITION BY agent_id" if by_agent else ""
        hits = f"(SELECT * FROM (SELECT *, row_number() OVER ({grp} ORDER BY rn) AS k FROM {hits}) WHERE k = 1)"
    return W + f"SELECT id, 'repetition' AS type, 'medium' AS anomaly_severity, CAST(7.0 AS DOUBLE) AS score{extra} FROM {hits}"


def _chains_body(by_agent: bool) -> str:
    key = "agent_id" if by_agent else "0"
    return f"""
o AS (SELECT *, {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY timestamp, id) AS rn FROM ae),
g AS (SELECT *, rn - row_number() OVER (PARTITION BY k, blocked ORDER BY timestamp, id) AS grp FROM o),
runs AS (SELECT k, grp, count(*) AS n, max(rn) AS last_rn FROM g WHERE blocked GROUP BY k, grp HAVING count(*) >= 3),
chains AS (
  SELECT coalesce(nx.id, lst.id) AS id, 'blocked_chain' AS type, 'high' AS anomaly_severity,
         least(10.0, CAST(2 * runs.n AS DOUBLE)) AS score, runs.n AS run_length, nx.id IS NULL AS at_end,
         lst.agent_id AS agent_id
  FROM runs JOIN o lst ON lst.k = runs.k AND lst.rn = runs.last_rn
  LEFT JOIN o nx ON nx.k = runs.k AND nx.rn = runs.last_rn + 1)"""


def _chains(by_agent: bool) -> str:
    extra = ", agent_id" if by_agent else ""
    return W + "," + _chains_body(by_agent) + f"\nSELECT id, type, anomaly_severity, score, run_length, at_end{extra} FROM chains"


def _walk(window: float, by_agent: bool) -> str:
    """Recursive anchored-group walk; defines CTE `grp(k, rn, gid)` over `o`."""
    key = "agent_id" if by_agent else "0"
    return f""",
o AS (SELECT *, {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY epoch, timestamp, id) AS rn FROM ae),
walk(k, rn, gid, grn, aep) AS (
  SELECT k, rn, id, rn, epoch FROM o WHERE rn = 1
  UNION ALL
  SELECT o.k, o.rn,
         CASE WHEN o.epoch - w.aep <= {window} THEN w.gid ELSE o.id END,
         CASE WHEN o.epoch - w.aep <= {window} THEN w.grn ELSE o.rn END,
         CASE WHEN o.epoch - w.aep <= {window} THEN w.aep ELSE o.epoch END
  FROM walk w JOIN o ON o.k = w.k AND o.rn = w.rn + 1),
groups AS (
  SELECT w.k, w.gid AS group_id, min(w.grn) AS grn, min(nullif(o.timestamp, '')) AS window_start, max(nullif(o.timestamp, '')) AS window_end,
         count(*) AS event_count, max(coalesce(o.risk_score, 0.0)) AS max_risk,
         string_agg(DISTINCT coalesce(o.source, '?'), ',' ORDER BY coalesce(o.source, '?')) AS sources,
         string_agg(DISTINCT coalesce(o.event_type, '?'), ',' ORDER BY coalesce(o.event_type, '?')) AS types
  FROM walk w JOIN o ON o.k = w.k AND o.rn = w.rn GROUP BY w.k, w.gid)"""


def _correlate(window: float, by_agent: bool) -> str:
    return WR + _walk(window, by_agent) + """
SELECT group_id, coalesce(window_start, '') AS window_start, coalesce(window_end, '') AS window_end, event_count, max_risk, sources, types
FROM groups"""


def _replay(by_agent: bool, speed: float) -> str:
    part = "PARTITION BY agent_id " if by_agent else ""
    extra = ", agent_id" if by_agent else ""
    w = f"OVER ({part}ORDER BY epoch, timestamp, id)"
    return W + f"""
SELECT id{extra},
       CASE WHEN p IS NULL THEN 0.0 ELSE round((epoch - p) * 1e6) / {speed} END AS replay_delay_us,
       round((epoch - f) * 1e6) / {speed} AS replay_offset_us
FROM (SELECT id, agent_id, epoch, lag(epoch) {w} AS p, first_value(epoch) {w} AS f FROM ae)"""


SPLIT = """,
act AS (SELECT * FROM ae WHERE timestamp >= '2024-01-11'),
exp0 AS (SELECT * FROM ae WHERE timestamp < '2024-01-11'),
exp AS (SELECT agent_id, event_type, timestamp, id FROM exp0
        UNION ALL SELECT agent_id, 'shutdown', timestamp, id FROM exp0 WHERE event_type = 'signup'),
ec AS (SELECT agent_id, event_type, count(*) AS n_expected FROM exp GROUP BY agent_id, event_type),
fe AS (SELECT agent_id, event_type, id, row_number() OVER (PARTITION BY agent_id, event_type ORDER BY timestamp, id) AS r FROM exp),
ac AS (SELECT agent_id, event_type, count(*) AS n_actual FROM act GROUP BY agent_id, event_type),
missing AS (
  SELECT ec.agent_id, ec.event_type, ec.n_expected, coalesce(ac.n_actual, 0) AS n_actual, fe.id
  FROM ec LEFT JOIN ac ON ac.agent_id = ec.agent_id AND ac.event_type = ec.event_type
  JOIN fe ON fe.agent_id = ec.agent_id AND fe.event_type = ec.event_type AND fe.r = 1
  WHERE coalesce(ac.n_actual, 0) < ec.n_expected),
extra AS (
  SELECT a.agent_id, a.event_type, a.id FROM act a
  WHERE NOT EXISTS (SELECT 1 FROM exp e WHERE e.agent_id = a.agent_id AND e.event_type = a.event_type))"""


def _path_case(rules: list[str], target: str, text: str) -> str:
    whens = " ".join(
        f"WHEN contains(lower(coalesce({target}, '')), '{r.lower()}') OR contains(lower(coalesce({text}, '')), '{r.lower()}') THEN '{r}'"
        for r in rules
    )
    return f"CASE {whens} END"


def _policy_union(src: str, tools: list[str], paths: list[str], max_risk: float) -> str:
    tl = ", ".join(f"'{t}'" for t in tools)
    return f"""
  SELECT id, agent_id, 0 AS sub, 'blocked_tool' AS rule FROM {src} WHERE event_type IN ({tl})
  UNION ALL
  SELECT id, agent_id, 1 AS sub, r AS rule FROM (SELECT *, {_path_case(paths, 'target', 'description')} AS r FROM {src}) WHERE r IS NOT NULL
  UNION ALL
  SELECT id, agent_id, 2 AS sub, 'risk_limit' AS rule FROM {src} WHERE risk_score > {max_risk}"""


FACTS = """
  SELECT {by} count(*) AS events, count(DISTINCT coalesce(source, '')) AS source_count,
         count(*) FILTER (WHERE coalesce(blocked, false)) AS blocked_count,
         coalesce(bool_or(coalesce(risk_score, 0.0) >= 5.0), false) AS has_anomalies
  FROM ae {group}"""


def _facts(by_agent: bool) -> str:
    return FACTS.format(by="agent_id," if by_agent else "", group="GROUP BY agent_id" if by_agent else "")


def _checks_sql(by_agent: bool) -> str:
    rows = []
    details = {
        "MEASURE-1": ("events > 0", "CAST(events AS VARCHAR) || ' events logged from ' || CAST(source_count AS VARCHAR) || ' sources'",
                      "'No events recorded — monitoring may be inactive'"),
        "MEASURE-2": ("has_anomalies", "'Anomalies detected in agent behaviour'", "'No anomaly detection triggers observed'"),
        "MANAGE-1": ("blocked_count > 0", "CAST(blocked_count AS VARCHAR) || ' blocked actions indicate policy enforcement'",
                     "'No blocked actions — policy enforcement may be inactive'"),
        "MANAGE-3": ("events > 0", "CAST(events AS VARCHAR) || ' events retained in the event table'", "'No forensic evidence retained'"),
    }
    sel_key = "agent_id, " if by_agent else ""
    for i, (cid, title, cat) in enumerate(CHECKS):
        if cid in ALWAYS_PASS:
            status, det = "'pass'", "'" + ALWAYS_PASS[cid].replace("'", "''") + "'"
        else:
            cond, ok, bad = details[cid]
            status, det = f"CASE WHEN {cond} THEN 'pass' ELSE 'fail' END", f"CASE WHEN {cond} THEN {ok} ELSE {bad} END"
        rows.append(f"SELECT {sel_key}CAST({i} AS BIGINT) AS check_no, '{cid}' AS id, '{title}' AS title, '{cat}' AS category, {status} AS status, {det} AS details FROM facts")
    return W + ", facts AS (" + _facts(by_agent) + ")\n, checks AS (" + "\nUNION ALL\n".join(rows) + ")\n"


def _summary(by_agent: bool) -> str:
    key = "agent_id, " if by_agent else ""
    grp = "GROUP BY agent_id" if by_agent else ""
    return _checks_sql(by_agent) + f"""
SELECT {key}'nist_ai_rmf' AS framework, CAST(count(*) AS BIGINT) AS total_checks,
       CAST(count(*) FILTER (WHERE status = 'pass') AS BIGINT) AS passed,
       CAST(count(*) FILTER (WHERE status = 'fail') AS BIGINT) AS failed,
       CASE WHEN count(*) FILTER (WHERE status = 'fail') = 0 THEN 'pass'
            WHEN count(*) FILTER (WHERE status = 'pass') / count(*) >= 0.7 THEN 'partial' ELSE 'fail' END AS status
FROM checks {grp}"""


CHAIN = """,
base AS (SELECT CAST(conv_id AS VARCHAR) AS chain_id, turn,
                'conv-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS evidence_id,
                sha256(text) AS hash, role AS collector,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations),
parts AS (SELECT *, '{"action": "collected", "collector": "' || collector || '", "evidence_id": "' || evidence_id
                 || '", "hash": "' || hash || '", "metadata": {}, "parent_hash": "' AS pre,
                 '", "timestamp": "2024-01-01T00:00:00+00:00"}' AS suf FROM base),
ch AS (SELECT chain_id, pos, turn, evidence_id, hash, pre, suf, repeat('0', 64) AS parent_hash,
              sha256(pre || repeat('0', 64) || suf) AS entry_hash FROM parts WHERE pos = 0
       UNION ALL
       SELECT p.chain_id, p.pos, p.turn, p.evidence_id, p.hash, p.pre, p.suf, c.entry_hash, sha256(p.pre || c.entry_hash || p.suf)
       FROM ch c JOIN parts p ON p.chain_id = c.chain_id AND p.pos = c.pos + 1)"""


def _chain_checks(tampered: bool) -> str:
    eh = "CASE WHEN turn = 2 THEN sha256(entry_hash) ELSE entry_hash END" if tampered else "entry_hash"
    return WR + CHAIN + f""",
t AS (SELECT *, {eh} AS eh FROM ch),
v AS (SELECT chain_id, pos,
             sha256(pre || parent_hash || suf) <> eh AS bad_hash,
             pos >= 1 AND parent_hash IS DISTINCT FROM lag(eh) OVER (PARTITION BY chain_id ORDER BY pos) AS bad_link,
             pos = 0 AND parent_hash <> repeat('0', 64) AS bad_first FROM t),
errs AS (SELECT chain_id, 0 AS kind, pos, 'Entry ' || pos || ': hash mismatch (tamper detected)' AS message FROM v WHERE bad_hash
         UNION ALL SELECT chain_id, 1, pos, 'Entry ' || pos || ': parent_hash chain broken' FROM v WHERE bad_link
         UNION ALL SELECT chain_id, 2, pos, 'Entry 0: first entry parent_hash must be zero-hash' FROM v WHERE bad_first)
"""


def _verify(tampered: bool) -> str:
    return _chain_checks(tampered) + """
SELECT v.chain_id, count(*) AS entries,
       CAST(coalesce(sum(CAST(bad_hash AS INT) + CAST(bad_link AS INT) + CAST(bad_first AS INT)), 0) AS BIGINT) AS error_count,
       coalesce(sum(CAST(bad_hash AS INT) + CAST(bad_link AS INT) + CAST(bad_first AS INT)), 0) = 0 AS valid
FROM v GROUP BY v.chain_id"""


POS = "row_number() OVER (PARTITION BY agent_id ORDER BY timestamp, id)"

SEVERITY_WORST = "CASE max(CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE -1 END) WHEN 0 THEN 'info' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' WHEN 4 THEN 'critical' ELSE 'unknown' END"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["timeline_first_100"] = _page(limit=100)
    q["timeline_offset_page"] = _page(limit=50, offset=200)
    q["timeline_from_offset"] = _page() + " OFFSET (SELECT count(*) * 9 // 10 FROM ae)"
    q["timeline_deep_page"] = _page(limit=50) + " OFFSET (SELECT greatest(0, count(*) - 50) FROM ae)"
    q["query_by_source"] = _page("source = 'agentgate'")
    q["query_by_type"] = _page("event_type = 'error'")
    q["query_by_severity"] = _page("severity = 'critical'")
    q["query_by_min_risk"] = _page("risk_score >= 8.0")
    q["query_combined"] = _page("source = 'mcpguard' AND event_type = 'view' AND severity = 'high' AND risk_score >= 7.0")
    q["build_timeline"] = W + "SELECT row_number() OVER (ORDER BY timestamp, id) AS seq, id, timestamp FROM ae"
    q["distinct_sources"] = W + "SELECT DISTINCT source FROM ae"
    q["distinct_event_types"] = W + "SELECT DISTINCT event_type FROM ae"
    q["severity_counts"] = W + "SELECT severity, count(*) AS cnt FROM ae GROUP BY severity"
    q["severity_distribution"] = W + "SELECT coalesce(severity, 'info') AS severity, count(*) AS cnt FROM ae GROUP BY 1"
    q["event_count"] = W + "SELECT count(*) AS event_count FROM ae"
    q["dashboard_stats"] = W + """SELECT count(*) AS event_count, count(DISTINCT source) AS source_count,
        count(DISTINCT event_type) AS type_count, count(*) FILTER (WHERE blocked) AS blocked_count FROM ae"""
    q["recent_events"] = W + f"SELECT {TL} FROM (SELECT * FROM ae ORDER BY timestamp DESC, id DESC LIMIT 20)"
    q["timeline_view"] = W + """SELECT CAST(row_number() OVER (ORDER BY timestamp, id) AS BIGINT) AS row_no, id, source, severity,
        left(coalesce(nullif(title, ''), nullif(event_type, ''), '?'), 30) AS event,
        left(coalesce(nullif(target, ''), '—'), 25) AS target,
        CASE WHEN blocked THEN 'BLOCKED' ELSE 'OK' END AS status, left(timestamp, 19) AS time
        FROM ae"""
    q["timeline_points"] = W + """SELECT id, timestamp AS ts, title AS event, source, severity, event_type AS type,
        CASE severity WHEN 'critical' THEN 'red' WHEN 'high' THEN 'orange' WHEN 'medium' THEN 'gold' WHEN 'low' THEN 'green'
                      WHEN 'info' THEN 'blue' ELSE 'gray' END AS color FROM ae"""
    q["risk_series"] = W + "SELECT id, timestamp AS ts, risk_score AS risk, title AS label FROM ae"
    q["list_incidents"] = W + """SELECT incident_id, count(*) AS event_count,
        string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM ae GROUP BY incident_id"""
    q["incident_summary"] = W + f"""SELECT incident_id, 'Incident ' || incident_id AS title, {SEVERITY_WORST} AS severity,
        CAST(count(*) AS VARCHAR) || ' events from ' || string_agg(DISTINCT source, ', ' ORDER BY source) AS timeline_summary,
        count(*) AS event_count, count(*) FILTER (WHERE risk_score >= 8.0) AS anomalies_count,
        count(*) FILTER (WHERE risk_score > 5.0) AS deviations_count,
        concat_ws('; ',
          CASE WHEN count(*) FILTER (WHERE risk_score >= 8.0) > 0 THEN 'Review the detected anomalies and their triggering events' END,
          CASE WHEN count(*) FILTER (WHERE risk_score > 5.0) > 0 THEN 'Tighten the agent policy for the observed deviations' END,
          CASE WHEN count(*) FILTER (WHERE blocked) > 0 THEN 'Investigate repeated blocked actions of the agent' END,
          CASE WHEN bool_or(severity = 'critical') THEN 'Escalate: critical-severity events were recorded' END) AS recommendations
        FROM ae GROUP BY incident_id"""
    q["report_header"] = W + f"""SELECT 'INC-ALL' AS incident_id, '{AS_OF}' AS generated_at, count(*) AS event_count,
        string_agg(DISTINCT coalesce(source, '?'), ', ' ORDER BY coalesce(source, '?')) AS sources FROM ae"""
    # anomalies
    q["anomalies_high_risk"] = W + """SELECT id, 'high_risk' AS type, CASE WHEN risk_score >= 9.0 THEN 'critical' ELSE 'high' END AS anomaly_severity,
        risk_score AS score FROM ae WHERE risk_score >= 8.0"""
    q["anomalies_rare_type"] = W + "SELECT id, 'rare_event_type' AS type, 'high' AS anomaly_severity, CAST(8.0 AS DOUBLE) AS score FROM ae WHERE event_type IN ('signup')"
    q["anomalies_burst"] = _burst(0.5, False)
    q["anomalies_burst_by_agent"] = _burst(0.001, True)
    q["anomalies_repetition"] = _repetition(False, False)
    q["anomalies_repetition_by_agent"] = _repetition(True, False)
    q["anomalies_first_repetition_by_agent"] = _repetition(True, True)
    q["anomalies_blocked_chain"] = _chains(False)
    q["anomalies_blocked_chain_by_agent"] = _chains(True)
    first_rep = f"(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY rn) AS kk FROM {_rep_hits(False)}) WHERE kk = 1)"
    q["anomalies_all"] = W + "," + _chains_body(False) + f"""
SELECT id, 'rare_event_type' AS type, 'high' AS anomaly_severity, CAST(8.0 AS DOUBLE) AS score, 0 AS phase, 0 AS sub FROM ae WHERE event_type IN ('signup')
UNION ALL SELECT id, 'high_risk', CASE WHEN risk_score >= 9.0 THEN 'critical' ELSE 'high' END, risk_score, 0, 1 FROM ae WHERE risk_score >= 8.0
UNION ALL SELECT id, 'high_frequency', 'medium', least(10.0, 3.0 / (epoch - e0) * 2), 1, 0
  FROM (SELECT id, epoch, lag(epoch, 2) OVER (ORDER BY timestamp, id) AS e0 FROM ae)
  WHERE e0 IS NOT NULL AND e0 <> 0 AND epoch <> 0 AND epoch - e0 > 0 AND 3.0 / (epoch - e0) > 0.5
UNION ALL SELECT id, 'repetition', 'medium', CAST(7.0 AS DOUBLE), 2, 0 FROM {first_rep}
UNION ALL SELECT id, type, anomaly_severity, score, 3, 0 FROM chains"""
    # correlation / replay
    q["correlate_groups"] = _correlate(3600, False)
    q["correlate_groups_600"] = _correlate(600, False)
    q["correlate_by_agent"] = _correlate(600, True)
    q["replay_delays_by_agent"] = _replay(True, 2.0)
    q["replay_offsets"] = _replay(False, 2.0)
    q["replay_first_100"] = W + """, f AS (SELECT * FROM ae ORDER BY timestamp, id LIMIT 100)
SELECT id, CASE WHEN p IS NULL THEN 0.0 ELSE round((epoch - p) * 1e6) / 1.0 END AS replay_delay_us
FROM (SELECT id, epoch, lag(epoch) OVER (ORDER BY epoch, timestamp, id) AS p FROM f)"""
    # deviations / policy
    q["diff_missing"] = W + SPLIT + "\nSELECT agent_id, event_type, n_expected, n_actual, id FROM missing"
    q["diff_extra"] = W + SPLIT + "\nSELECT agent_id, event_type, id FROM extra"
    q["diff_all"] = W + SPLIT + """,
pol AS (""" + _policy_union("act", ["error"], ["user/12", "USER 7"], 9.0) + """)
SELECT 'missing_action' AS type, 'expected' AS event_side, 0 AS phase, 0 AS sub, id, agent_id FROM missing
UNION ALL SELECT 'extra_action', 'actual', 1, 0, id, agent_id FROM extra
UNION ALL SELECT 'policy_violation', 'actual', 2, sub, id, agent_id FROM pol"""
    q["policy_tools"] = W + "SELECT id, 'blocked_tool' AS rule, event_type FROM ae WHERE event_type IN ('purchase', 'signup')"
    rules = ["MIT License", "token", "@", "license", "src3"]
    q["policy_paths"] = f"SELECT id, rule FROM (SELECT doc_id AS id, {_path_case(rules, 'source', 'text')} AS rule FROM documents) WHERE rule IS NOT NULL"
    q["policy_rule_list"] = W + """
SELECT id, 'USER/' || (min(i) * 7919 % 1000) AS rule FROM ae, range(1000) AS r(i)
WHERE contains(lower(coalesce(target, '')), 'user/' || (i * 7919 % 1000)) OR contains(lower(coalesce(description, '')), 'user/' || (i * 7919 % 1000))
GROUP BY id"""
    q["policy_risk"] = W + "SELECT id, 'risk_limit' AS rule, risk_score FROM ae WHERE risk_score > 5.0"
    q["policy_all"] = W + "SELECT id, sub, rule FROM (" + _policy_union("ae", ["error"], ["user/12", "USER 7"], 9.0) + ")"
    # compliance
    q["compliance_facts"] = W + _facts(False)
    q["compliance_facts_by_agent"] = W + _facts(True)
    q["compliance_checks"] = _checks_sql(False) + "SELECT check_no, id, title, category, status, details FROM checks"
    q["compliance_checks_by_agent"] = _checks_sql(True) + "SELECT agent_id, check_no, id, status, details FROM checks"
    q["compliance_summary"] = _summary(False)
    q["compliance_summary_by_agent"] = _summary(True)
    allow = ", ".join(f"('{t}')" for t in SAFE_TOOLS)
    deny = ", ".join(f"('{t}')" for t in DANGEROUS_TOOLS)
    rate = "CASE WHEN failed >= 5 THEN 20 WHEN failed >= 3 THEN 33 ELSE 100 END"
    q["tool_policy"] = "WITH s AS (" + _summary(True).replace("WITH ae AS", "WITH ae AS", 1) + f""")
SELECT agent_id, tool, 'allow' AS decision, {rate} AS rate_limit FROM s, (VALUES {allow}) t(tool)
UNION ALL SELECT agent_id, tool, 'deny', {rate} FROM s, (VALUES {deny}) t(tool)"""
    q["adjusted_rate"] = "WITH s AS (" + _summary(True) + f""")
SELECT agent_id, failed, {rate} AS rate_limit, true AS anomalous FROM s"""
    # export
    q["security_event_payload"] = W + """SELECT id, coalesce(event_type, 'unknown') AS event_type, coalesce(severity, 'info') AS severity,
        coalesce(nullif(title, ''), nullif(description, ''), 'No message') AS message, 'forensics' AS source,
        coalesce(target, '') AS tool, coalesce(blocked, false) AS blocked, coalesce(risk_score, 0.0) AS risk_score,
        coalesce(source, 'unknown') AS origin FROM ae"""
    # evidence
    q["evidence_hashes"] = "SELECT doc_id, sha256(text) AS hash FROM documents"
    q["evidence_get_chain"] = "WITH RECURSIVE dummy AS (SELECT 1)" + CHAIN + """
SELECT chain_id, turn AS seq, evidence_id, parent_hash, entry_hash FROM ch WHERE chain_id = '1'"""
    q["normalize_times"] = W + f"""SELECT id, CAST(round(epoch * 1e6) AS BIGINT) AS from_number, id * 1000000 AS from_int,
        CAST(round(epoch * 1e6) AS BIGINT) AS from_offset, epoch_us(TIMESTAMP '{AS_OF[:19]}') AS from_word FROM ae"""
    q["safe_json"] = W + """SELECT id, CASE WHEN id % 3 = 0 THEN 0 ELSE 2 END::INT AS n_keys, CASE WHEN id % 3 = 0 THEN NULL ELSE event_type END AS event_type,
        CASE WHEN id % 3 = 0 THEN NULL ELSE id::VARCHAR END AS n FROM ae"""
    q["replay_on_batch"] = W + """SELECT id, us / 2 AS replay_delay_us FROM (
        SELECT id, round((epoch - lag(epoch) OVER (ORDER BY epoch, timestamp, id)) * 1e6) AS us FROM ae) WHERE us / 2 > 5e8"""
    quoted = r"""'"' || array_to_string(list_transform(string_split(text, ''), lambda c: CASE
            WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r' WHEN c = chr(9) THEN '\t'
            WHEN c = '' THEN '' WHEN unicode(c) BETWEEN 32 AND 126 THEN c ELSE printf('\u%04x', unicode(c)) END), '') || '"'"""
    q["evidence_chain_texts"] = r"""WITH RECURSIVE parts AS (
  SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
         '{"action": "collected", "collector": ' || CASE WHEN doc_id % 5 = 0 THEN 'null' ELSE '"\"\u00e9\u2028\\' || lang || '"' END
         || ', "evidence_id": ' || """ + quoted + r""" || ', "hash": "' || sha256(text) || '", "metadata": {"lang": "' || lang
         || '", "\u00f1": null}, "parent_hash": "' AS pre, '", "timestamp": "2024-01-01T00:00:00+00:00"}' AS suf FROM documents),
ch AS (SELECT source, doc_id, pos, repeat('0', 64) AS parent_hash, sha256(pre || repeat('0', 64) || suf) AS entry_hash FROM parts WHERE pos = 0
       UNION ALL SELECT p.source, p.doc_id, p.pos, c.entry_hash, sha256(p.pre || c.entry_hash || p.suf)
       FROM ch c JOIN parts p ON p.source = c.source AND p.pos = c.pos + 1)
SELECT source AS chain_id, doc_id AS seq, parent_hash, entry_hash FROM ch"""
    q["evidence_chain"] = "WITH RECURSIVE dummy AS (SELECT 1)" + CHAIN + "\nSELECT chain_id, turn AS seq, evidence_id, hash, parent_hash, entry_hash FROM ch"
    q["evidence_chain_appends"] = q["evidence_chain"]
    # numbers as Python writes them: at least one decimal, an exponent of two digits from 1e16 and below 1e-4
    q["evidence_nested_metadata"] = "WITH RECURSIVE ae AS (" + AGENT_EVENTS_SQL + r"""),
m AS (SELECT agent_id, id, source, event_type, row_number() OVER (PARTITION BY agent_id ORDER BY id) - 1 AS pos,
             '{"b": {"rows": [{"a": 1e+20, "\u00e9": "' || event_type || '"}]}, "ids": [' || id || ', null], "none": null, "z": {"blocked": ' || blocked::VARCHAR
             || ', "part": ' || (risk_score / 1e7)::VARCHAR || ', "risk": ' || risk_score::VARCHAR || '}}' AS meta FROM ae),
parts AS (SELECT *, '{"action": "collected", "collector": "' || source || '", "evidence_id": "' || id || '", "hash": "' || sha256(event_type)
                 || '", "metadata": ' || meta || ', "parent_hash": "' AS pre, '", "timestamp": "2024-01-01T00:00:00+00:00"}' AS suf FROM m),
ch AS (SELECT agent_id, id, pos, meta, repeat('0', 64) AS parent_hash, sha256(pre || repeat('0', 64) || suf) AS entry_hash FROM parts WHERE pos = 0
       UNION ALL SELECT p.agent_id, p.id, p.pos, p.meta, c.entry_hash, sha256(p.pre || c.entry_hash || p.suf)
       FROM ch c JOIN parts p ON p.agent_id = c.agent_id AND p.pos = c.pos + 1)
SELECT agent_id AS chain_id, id AS seq, meta AS metadata_json, parent_hash, entry_hash FROM ch"""
    q["evidence_verify"] = _verify(False)
    q["evidence_tampered_verify"] = _verify(True)
    q["evidence_tampered"] = _chain_checks(True) + "SELECT chain_id, kind, pos, message FROM errs"
    # readers
    q["generic_plain_lines"] = r"""SELECT doc_id, lineno, line FROM (
        SELECT doc_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line, lineno FROM (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS lineno
          FROM documents)) WHERE length(line) > 0"""
    fmts = "(VALUES ('jsonl'), ('csv'), ('syslog'), ('plain')) t(f)"
    q["detect_format"] = W + f"SELECT DISTINCT f || '/' || agent_id AS file, f AS format FROM ae, {fmts}"
    q["parse_jsonl"] = W + f"SELECT 'jsonl/' || agent_id AS file, {POS} AS lineno, timestamp, event_type, id FROM ae"
    q["csv_quoted_records"] = """SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, length(coalesce(text, '')) AS n_chars, coalesce(source, '') AS source FROM documents"""
    q["parse_csv"] = W + f"SELECT 'csv/' || agent_id AS file, {POS} + 1 AS lineno, timestamp, event_type, id FROM ae"
    q["parse_syslog"] = W + f"""SELECT 'syslog/' || agent_id AS file, {POS} AS lineno,
        strftime(epoch_us_to_ts, '%b %-d %H:%M:%S') AS timestamp, 'host-' || agent_id AS hostname, 'app' AS application,
        event_type || ' at ' || timestamp AS message
        FROM (SELECT *, make_timestamp(CAST(round(epoch * 1e6) AS BIGINT)) AS epoch_us_to_ts FROM ae)"""
    # a generic line becomes an event with the table's defaults; syslog times have no year and no epoch
    sys_time = "strftime(make_timestamp(CAST(round(epoch * 1e6) AS BIGINT)), '%b %-d %H:%M:%S')"
    defaults = """'generic' AS source, 'unknown' AS event_type, 'info' AS severity, 'low' AS confidence, false AS blocked,
        CAST(0 AS DOUBLE) AS risk_score"""
    generic = f"""SELECT f || '/' || agent_id AS file, {POS} + CASE f WHEN 'csv' THEN 1 ELSE 0 END AS lineno, f AS format, {defaults},
        CASE f WHEN 'syslog' THEN {sys_time} WHEN 'plain' THEN '{AS_OF}' ELSE timestamp END AS timestamp,
        CASE f WHEN 'syslog' THEN 0.0 WHEN 'plain' THEN CAST(epoch_us(TIMESTAMP '{AS_OF[:19]}') AS DOUBLE) / 1e6 ELSE round(epoch, 6) END::DOUBLE AS epoch,
        '' AS title, '' AS target FROM (SELECT * FROM ae, {fmts})"""
    q["parse_generic_auto"] = W + generic.replace(POS, POS.replace("PARTITION BY agent_id", "PARTITION BY f, agent_id"))
    q["guard_log_roundtrip"] = W + "SELECT id, 'mcpguard' AS source, event_type, severity, blocked, risk_score, timestamp, epoch, agent_id FROM ae"
    q["event_table"] = W + """SELECT CAST(row_number() OVER (ORDER BY CASE source WHEN 'mcpguard' THEN 0 ELSE 1 END, timestamp, id) AS BIGINT) AS id,
        source, event_type, severity, timestamp, risk_score, blocked, agent_id FROM ae"""
    q["gate_signals"] = W + """SELECT id, 'agentgate' AS source, 'policy_violation' AS event_type, true AS blocked, target, timestamp, event_type AS signal_type,
        CAST(round(risk_score * 10) AS BIGINT) AS weight, CAST(0 AS BIGINT) AS score, 'deny' AS action, '' AS user_agent FROM ae WHERE source = 'agentgate'"""
    cols = "lineno, source, event_type, severity, confidence, blocked, risk_score, timestamp, epoch"
    q["union_sources"] = W + f"""SELECT id AS lineno, source, event_type, severity, 'low' AS confidence, blocked, risk_score, timestamp, round(epoch, 6) AS epoch
        FROM ae WHERE source = 'mcpguard'
        UNION ALL SELECT id, source, 'policy_violation', 'info', 'low', true, CAST(0 AS DOUBLE), timestamp, round(epoch, 6) FROM ae WHERE source = 'agentgate'
        UNION ALL SELECT {cols} FROM ({q["parse_generic_auto"][len(W):]})"""
    q["guard_log_taxonomy"] = W + """SELECT id,
        CASE event_type WHEN 'error' THEN 'tool_failure' WHEN 'click' THEN 'ui_action' WHEN 'view' THEN 'data_access' ELSE event_type END AS event_type,
        CASE event_type WHEN 'error' THEN 'high' WHEN 'click' THEN 'low' WHEN 'view' THEN 'info' ELSE severity END AS severity,
        CASE event_type WHEN 'error' THEN 'medium' ELSE 'low' END AS confidence,
        CASE event_type WHEN 'error' THEN 'Tool failure' WHEN 'click' THEN 'UI action' WHEN 'view' THEN 'Data access' ELSE title END AS title,
        CASE event_type WHEN 'error' THEN 7.0 WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.5 ELSE risk_score END AS risk_score
        FROM ae WHERE source = 'mcpguard'"""
    rep_first = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY rn) AS kk FROM {_rep_hits(True)}) WHERE kk = 1)"
    q["analysis_view"] = W + "," + _chains_body(True) + f"""
SELECT 'rare_event_type' AS type, 'high' AS severity, CAST(8.0 AS DOUBLE) AS score,
       left('Rare event type ' || chr(39) || event_type || chr(39) || ' observed', 60) AS text, id, agent_id
FROM ae WHERE event_type = 'signup'
UNION ALL SELECT 'repetition', 'medium', CAST(7.0 AS DOUBLE),
       left('Same event repeated 5 times: ' || chr(39) || event_type || chr(39), 60), id, agent_id FROM {rep_first}
UNION ALL SELECT 'blocked_chain', 'high', score,
       left('Agent had ' || CAST(run_length AS VARCHAR) || ' consecutive blocked actions' || CASE WHEN at_end THEN ' at end' ELSE '' END, 60),
       id, agent_id FROM chains
UNION ALL SELECT 'high_risk', CASE WHEN risk_score >= 9 THEN 'critical' ELSE 'high' END, risk_score,
       left(printf('Risk score %.1f exceeds threshold', risk_score), 60), id, agent_id FROM ae WHERE risk_score >= 8
UNION ALL SELECT 'high_frequency', 'medium', least(10.0, 3.0 / (epoch - e0) * 2),
       left(printf('Burst of 3 events in %.1fs', epoch - e0), 60), id, agent_id
FROM (SELECT id, agent_id, epoch, lag(epoch, 2) OVER (PARTITION BY agent_id ORDER BY timestamp, id) AS e0 FROM ae)
WHERE epoch - e0 > 0 AND 3.0 / (epoch - e0) > 0.001"""
    q["quarantine"] = r"""SELECT doc_id, lineno, reason FROM (
  SELECT doc_id, lineno, line,
         CASE WHEN json_valid(line) AND starts_with(line, '{') THEN NULL
              WHEN json_valid(line) THEN 'not_an_object' ELSE 'malformed_json' END AS reason
  FROM (SELECT doc_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line, lineno FROM (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
                 generate_subscripts(string_split(text, chr(10)), 1) AS lineno FROM documents)))
WHERE length(line) > 0 AND reason IS NOT NULL"""
    known = ", ".join(f"'{t}'" for t in KNOWN_TOOLS)
    danger = ", ".join(f"'{t}'" for t in DANGEROUS_TOOLS)
    safe = ", ".join(f"'{t}'" for t in SAFE_TOOLS)
    q["policy_text"] = _checks_sql(False) + f""",
agg AS (SELECT count(*) FILTER (WHERE status = 'fail') AS failed,
               bool_or(contains(lower(coalesce(details, '')), 'anomal')) AS anom_detail,
               list(lower(coalesce(details, ''))) AS dets FROM checks),
lists AS (SELECT failed, CASE WHEN failed >= 5 THEN 20 WHEN failed >= 3 THEN 33 ELSE 100 END AS rate,
          list_sort(list_distinct(list_concat(
            list_filter([{known}], lambda t: len(list_filter(dets, lambda d: contains(d, t))) > 0),
            CASE WHEN anom_detail OR failed > 3 THEN [{danger}] ELSE []::VARCHAR[] END))) AS deny FROM agg),
l2 AS (SELECT *, list_sort(list_filter([{safe}], lambda t: NOT list_contains(deny, t))) AS allow FROM lists),
lines AS (SELECT list_concat(list_concat(list_concat(
            ['# Framework: nist_ai_rmf', 'rate_limit: ' || CAST(rate AS VARCHAR), 'allow:'],
            CASE WHEN len(allow) > 0 THEN list_transform(allow, lambda t: '  - ' || t) ELSE ['  # No safe tools identified'] END),
            ['deny:']),
            CASE WHEN len(deny) > 0 THEN list_transform(deny, lambda t: '  - ' || t) ELSE ['  # No tools denied'] END) AS ls FROM l2)
SELECT CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_no, unnest(ls) AS text FROM lines"""
    q["policy_from_checks"] = W + f""",
c AS (SELECT agent_id, CASE WHEN count(*) % 3 = 0 THEN 'pass' ELSE 'fail' END AS status, lower(CASE event_type
        WHEN 'click' THEN 'READ_FILE used ' || count(*) || ' times'
        WHEN 'view' THEN CASE WHEN max(risk_score) >= 9 THEN 'calls HTTP_request' ELSE 'quiet' END
        WHEN 'error' THEN CASE WHEN count(*) % 5 = 0 THEN 'Anomalous delete_file' ELSE 'none' END
        WHEN 'purchase' THEN 'sql_query, write_file' ELSE '' END) AS details FROM ae GROUP BY agent_id, event_type),
f AS (SELECT agent_id, count(*) FILTER (WHERE status = 'fail') AS failed, bool_or(contains(details, 'anomal')) AS mention FROM c GROUP BY agent_id),
g AS (SELECT agent_id, failed, mention OR failed > 3 AS anomalous FROM f),
den AS (SELECT DISTINCT agent_id, tool FROM c JOIN (SELECT unnest([{known}]) AS tool) t ON contains(c.details, t.tool)
        UNION SELECT agent_id, tool FROM g, (SELECT unnest([{danger}]) AS tool) WHERE anomalous),
ls AS (SELECT agent_id, list_sort(list(tool)) AS deny FROM den GROUP BY agent_id)
SELECT agent_id, failed, anomalous, coalesce(array_to_string(deny, ','), '') AS deny,
       array_to_string(list_sort(list_filter([{safe}], lambda t: NOT coalesce(list_contains(deny, t), false))), ',') AS allow,
       CASE WHEN failed >= 5 THEN 20 WHEN failed >= 3 THEN 33 ELSE 100 END AS rate_limit FROM g LEFT JOIN ls USING (agent_id)"""
    q["ingest_batch"] = W + f""", rej AS ({q["quarantine"]})
SELECT 'guard' AS reader, 'mcpguard' AS source, NULL AS reason, count(*) AS rows FROM ae WHERE source = 'mcpguard'
UNION ALL SELECT 'gate', 'agentgate', NULL, count(*) FROM ae WHERE source = 'agentgate'
UNION ALL SELECT 'generic', 'generic', NULL, 4 * count(*) FROM ae
UNION ALL SELECT 'gate', NULL, reason, count(*) FROM rej GROUP BY reason"""
    q["build_timeline_first_500"] = q["build_timeline"] + " ORDER BY timestamp, id LIMIT 500"
    q["compliance_payload_file"] = _checks_sql(True) + """,
s AS (SELECT agent_id, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) AS total_checks FROM checks GROUP BY agent_id)
SELECT c.agent_id, 'forensics' AS source, 'nist_ai_rmf' AS framework,
       CASE WHEN passed = total_checks THEN 'pass' WHEN passed / total_checks >= 0.7 THEN 'partial' ELSE 'fail' END AS verdict,
       passed, total_checks, id, title, category, status, details FROM checks c JOIN s ON s.agent_id = c.agent_id"""
    q["policy_file"] = "SELECT text, count(*) AS n FROM (" + q["policy_text"] + ") GROUP BY text"
    q["report_file_evidence"] = f"""SELECT text, count(*) AS n FROM (
  SELECT '| conv-' || conv_id || '-' || turn || ' | ' || left(sha256(text), 16) || '… | ' || role || ' | 2024-01-01T00:00:00 |' AS text FROM conversations
  UNION ALL SELECT unnest(['', '## Evidence Chain of Custody', '', '**' || count(*) || ' evidence entries**', '', '| ID | Hash | Collector | Timestamp |', '|---|---|---|---|'])
  FROM conversations) GROUP BY text"""
    q["report_lines_anomalies"] = W + "," + _chains_body(False) + f""",
a AS (SELECT id, 0 AS phase, CASE WHEN risk_score >= 9 THEN 'critical' ELSE 'high' END AS sev, risk_score AS score,
             printf('Risk score %.1f exceeds threshold', risk_score) AS body FROM ae WHERE risk_score >= 8
      UNION ALL SELECT id, 1, 'medium', least(10.0, 3.0 / (epoch - e0) * 2), printf('Burst of 3 events in %.1fs', epoch - e0)
      FROM (SELECT id, epoch, lag(epoch, 2) OVER (ORDER BY timestamp, id) AS e0 FROM ae) WHERE epoch - e0 > 0 AND 3.0 / (epoch - e0) > 0.5
      UNION ALL SELECT id, 2, 'medium', 7.0, 'Same event repeated 5 times: ' || chr(39) || event_type || chr(39) FROM {first_rep}
      UNION ALL SELECT id, 3, 'high', score, 'Agent had ' || run_length || ' consecutive blocked actions' || CASE WHEN at_end THEN ' at end' ELSE '' END FROM chains),
n AS (SELECT count(*) AS n FROM a)
SELECT row_number() OVER (ORDER BY phase, timestamp, id) AS line_no, printf('- **[severity: %s] (score: %.1f)** %s', sev, score, body) AS text
FROM a JOIN ae USING (id)
UNION ALL SELECT i - 9, t FROM (SELECT unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS i FROM (
  SELECT ['', '## Anomalies Detected', ''] || CASE WHEN n > 0 THEN ['**' || n || ' anomaly(ies) found**', ''] ELSE ['No anomalies detected.', ''] END AS ls FROM n))"""
    q["stream_ingest"] = W + """SELECT 'mcpguard' AS source, event_type, severity, title, description, target, blocked, risk_score, timestamp, agent_id, incident_id FROM ae"""
    q["quarantine_long_lines"] = r"""SELECT doc_id, lineno, 'too_long' AS reason, sha256(raw) AS line_sha256 FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS lineno FROM documents)
WHERE length(regexp_replace(raw, '^\s+|\s+$', '', 'g')) > 120"""
    q["ingest_counts"] = W + "SELECT 'mcpguard' AS source, count(*) AS events FROM ae"
    # streaming (same answers as the batch rules when events arrive in order)
    q["stream_high_risk"] = W + "SELECT id, 'high_risk' AS type, risk_score AS score FROM ae WHERE risk_score >= 8.0"
    q["stream_bursts_by_agent"] = "SELECT id, type, score, agent_id FROM (" + _burst(0.001, True) + ")"
    q["stream_ordered_alerts"] = f"""SELECT id, type, score, CAST(NULL AS BIGINT) AS run_length, agent_id FROM ({_burst(0.001, True)})
        UNION ALL SELECT id, CASE WHEN at_end THEN 'blocked_chain_open' ELSE type END, score, run_length, agent_id FROM ({_chains(True)})"""
    # four files a batch; a batch's watermark is the largest time before it less the delay
    q["stream_late_rows"] = W + """,
b AS (SELECT min(epoch) AS lo, (max(epoch) - min(epoch)) / 15 + 1 AS width FROM ae),
f AS (SELECT id, agent_id, timestamp, epoch_us(make_timestamp(CAST(round(epoch * 1e6) AS BIGINT))) AS us, width,
             greatest(0, CAST(floor((epoch - lo) / width) AS INTEGER)
                         + CASE WHEN id % 101 = 0 THEN 5 WHEN id % 7 = 0 THEN 1 WHEN id % 7 = 1 THEN -1 ELSE 0 END) // 4 AS batch FROM ae, b),
m AS (SELECT batch, max(us) // 1000 AS top FROM f GROUP BY batch)
SELECT id, agent_id, timestamp FROM f
WHERE ceil(us / 1000) <= (SELECT max(top) FROM m WHERE m.batch < f.batch) - CAST(floor(width * 2.0 * 1000) AS BIGINT)"""
    q["stream_chains_by_agent"] = W + "," + _chains_body(True) + "\nSELECT id, score, run_length, agent_id FROM chains WHERE NOT at_end"
    # reports
    q["report_timeline"] = W + """SELECT CAST(row_number() OVER (ORDER BY timestamp, id) AS BIGINT) AS row_no, source, severity,
        left(coalesce(nullif(title, ''), nullif(event_type, ''), '?'), 60) AS event, left(timestamp, 19) AS time,
        risk_score AS risk, CAST(0 AS BIGINT) AS more FROM (SELECT * FROM ae ORDER BY timestamp, id LIMIT 50)
        UNION ALL SELECT 51, NULL, NULL, NULL, NULL, NULL, count(*) - 50 FROM ae HAVING count(*) > 50"""
    q["report_groups"] = WR + _walk(60, False) + """
SELECT CAST(row_number() OVER (ORDER BY grn) AS BIGINT) AS row_no, left(window_start, 19) AS start, left(window_end, 19) AS "end",
       event_count, max_risk, replace(sources, ',', ', ') AS sources, CAST(0 AS BIGINT) AS more
FROM (SELECT * FROM groups ORDER BY grn LIMIT 10)
UNION ALL SELECT 11, NULL, NULL, NULL, NULL, NULL, count(*) - 10 FROM groups HAVING count(*) > 10"""
    return q
