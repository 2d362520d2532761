import json
import os
import tempfile

from pyspark.sql import functions as F

from sleuth.operators import anomalies as A
from sleuth.operators import correlate as G
from sleuth.operators import deviations as D
from sleuth.operators import replay as RP
from sleuth.operators import reports as P
from sleuth.operators import timeline as T
from sleuth.sources import sinks as S
from tests.conftest import make_events, ts


def _ev(spark, n=60):
    return make_events(spark, [dict(source="s%d" % (i % 2), severity=["low", "high"][i % 2], event_type="t%d" % (i % 3), risk_score=float(i % 11), timestamp=ts(i * 7), blocked=i % 4 == 0) for i in range(n)])


def test_query_filters_and_pages(spark):
    ev = _ev(spark)
    assert T.query_events(ev, source="s1").count() == 30
    assert T.query_events(ev, source="").count() == 60  # empty text = no filter
    assert T.query_events(ev, min_risk=0).count() == 60 and T.query_events(ev, min_risk=10).count() == 5
    page = [r["id"] for r in T.query_events(ev, limit=5, offset=10).collect()]
    assert page == [11, 12, 13, 14, 15]
    assert [r["id"] for r in T.recent_events(ev, 3).collect()] == [58, 59, 60]
    assert T.build_timeline(ev, limit=7).count() == 7


def test_stats(spark):
    ev = _ev(spark)
    st = T.dashboard_stats(ev).collect()[0]
    assert (st["event_count"], st["source_count"], st["type_count"], st["blocked_count"]) == (60, 2, 3, 15)
    assert [r["source"] for r in T.sources(ev).collect()] == ["s0", "s1"]
    assert {r["severity"]: r["cnt"] for r in T.severity_counts(ev).collect()} == {"low": 30, "high": 30}


def test_replay_delays(spark):
    ev = make_events(spark, [dict(timestamp=ts(t)) for t in (3, 1, 2)])
    r = RP.replay_schedule(ev, speed=0).orderBy("seq").collect()
    assert [x["id"] for x in r] == [2, 3, 1]
    assert [x["replay_delay"] for x in r] == [0.0, 100.0, 100.0]  # speed 0 divides by 0.01


def test_report_sections(spark):
    ev = _ev(spark)
    md = P.report_markdown(ev, G.correlate(ev, 60), A.detect_anomalies(ev), D.diff_behavior(ev, None, None), None, "INC-1", "2030-01-01T00:00:00Z")
    lines = [r["text"] for r in md.orderBy("section_no", "line_no").collect()]
    assert lines[0] == "# Agent Forensics Report" and "**Incident ID**: INC-1" in lines
    assert "| ... | *10 more events* | | | | |" in lines
    assert "No policy deviations detected." in lines and "No evidence collected." in lines
    heads = [x for x in lines if x.startswith("## ")]
    assert heads == ["## Timeline Summary", "## Correlated Event Groups", "## Policy Deviations", "## Anomalies Detected", "## Evidence Chain of Custody", "## Raw Evidence"]
    assert lines[lines.index("## Timeline Summary") - 1 :][:6] == ["", "## Timeline Summary", "", "| # | Source | Severity | Event | Timestamp | Risk |", "|---|---|---|---|---|---|", lines[lines.index("## Timeline Summary") + 4]]
    assert lines[lines.index("No evidence collected.") + 1] == "" and lines[-1].startswith("> Full evidence chain")
    rows = P.report_json(ev, G.correlate(ev, 60), A.detect_anomalies(ev), D.diff_behavior(ev, None, None), None, G.assign_groups(ev, 60), "INC-1", "2030-01-01T00:00:00Z").collect()
    header = [json.loads(r["json"]) for r in rows if r["section"] == "header"]
    assert header == [{"incident_id": "INC-1", "generated_at": "2030-01-01T00:00:00Z", "event_count": 60, "sources": ["s0", "s1"]}]
    members = [json.loads(r["json"]) for r in rows if r["section"] == "group_events"]
    groups = [json.loads(r["json"]) for r in rows if r["section"] == "groups"]
    assert len(members) == 60 and {g["group_id"] for g in groups} == {m["group_id"] for m in members}
    tl = P.report_timeline(ev).collect()
    assert len(tl) == 51 and max(r["more"] for r in tl) == 10


def test_append_events_and_exports(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "events")
    raw = spark.createDataFrame([("a", "2025-01-01T00:00:00Z", "f", 1), ("b", "2025-01-02T00:00:00Z", "f", 2)], "event_type string, timestamp string, _file string, _lineno long")
    S.append_events(raw, path, as_of="2030-01-01T00:00:00Z")
    table = S.append_events(raw, path, as_of="2030-01-01T00:00:00Z")
    assert sorted(r["id"] for r in table.collect()) == [1, 2, 3, 4]
    p = S.to_security_event(table.where(F.col("id") == 1)).collect()[0]
    assert p["message"] == "No message" and p["source"] == "forensics" and p["details"]["source"] == "unknown"
