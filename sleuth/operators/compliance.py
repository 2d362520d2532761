"""Compliance facts, the 10 framework checks, the summary and the tool policy.

Each group (``by`` keys, or the whole table) becomes one facts row; its
checks are an array column of 10 structs built from the facts, so checks,
summary and policy need no join and no further shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The check catalogue (id, title, category), the anomaly risk
# level and the tool lists of the policy. Detail texts are ours, except that
# MAP-2 must mention "anomalies" (the policy treats that as an anomaly flag)
# and that no detail names a known tool.
# ---------------------------------------------------------------------------
FRAMEWORK = "nist_ai_rmf"
ANOMALY_RISK = 5.0
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
DETAIL_MEASURE1_PASS = "{n} events logged from {sources} sources"
DETAIL_MEASURE1_FAIL = "No events recorded — monitoring may be inactive"
DETAIL_MEASURE2_PASS = "Anomalies detected in agent behaviour"
DETAIL_MEASURE2_FAIL = "No anomaly detection triggers observed"
DETAIL_MANAGE1_PASS = "{blocked} blocked actions indicate policy enforcement"
DETAIL_MANAGE1_FAIL = "No blocked actions — policy enforcement may be inactive"
DETAIL_MANAGE3_PASS = "{n} events retained in the event table"
DETAIL_MANAGE3_FAIL = "No forensic evidence retained"
KNOWN_TOOLS = ["write_file", "http_request", "execute_command", "delete_file", "network_scan", "sql_query", "modify_system"]
DANGEROUS_TOOLS = ["exec", "shell", "sudo", "curl", "wget", "sql"]
SAFE_TOOLS = ["read_file", "get_weather", "search_web", "get_time", "calculate", "translate", "summarize", "list_directory"]
PARTIAL_RATIO = 0.7
DEFAULT_RATE_LIMIT = 100


def compliance_facts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """events, distinct sources, blocked count, any risk >= 5 (exact counts)."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct(F.coalesce(F.col("source"), F.lit(""))).alias("source_count"),
        F.count_if(F.coalesce(F.col("blocked"), F.lit(False))).alias("blocked_count"),
        F.coalesce(F.bool_or(F.coalesce(F.col("risk_score"), F.lit(0.0)) >= ANOMALY_RISK), F.lit(False)).alias(
            "has_anomalies"
        ),
    )


def _check(cid: str, title: str, category: str, passed: Column, details: Column) -> Column:
    return F.struct(
        F.lit(cid).alias("id"),
        F.lit(title).alias("title"),
        F.lit(category).alias("category"),
        F.when(passed, F.lit("pass")).otherwise(F.lit("fail")).alias("status"),
        details.alias("details"),
    )


def _fmt(template: str, **cols: Column) -> Column:
    """Python-style ``{name}`` template -> concat of literals and columns."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if pre:
            parts.append(F.lit(pre))
        parts.append(cols[name].cast("string"))
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def checks_array(facts: DataFrame) -> Column:
    n, src, blk, anom = F.col("events"), F.col("source_count"), F.col("blocked_count"), F.col("has_anomalies")
    data_checks = {
        "MEASURE-1": (n > 0, F.when(n > 0, _fmt(DETAIL_MEASURE1_PASS, n=n, sources=src)).otherwise(F.lit(DETAIL_MEASURE1_FAIL))),
        "MEASURE-2": (anom, F.when(anom, F.lit(DETAIL_MEASURE2_PASS)).otherwise(F.lit(DETAIL_MEASURE2_FAIL))),
        "MANAGE-1": (blk > 0, F.when(blk > 0, _fmt(DETAIL_MANAGE1_PASS, blocked=blk)).otherwise(F.lit(DETAIL_MANAGE1_FAIL))),
        "MANAGE-3": (n > 0, F.when(n > 0, _fmt(DETAIL_MANAGE3_PASS, n=n)).otherwise(F.lit(DETAIL_MANAGE3_FAIL))),
    }
    items = []
    for cid, title, cat in CHECKS:
        if cid in ALWAYS_PASS:
            items.append(_check(cid, title, cat, F.lit(True), F.lit(ALWAYS_PASS[cid])))
        else:
            ok, det = data_checks[cid]
            items.append(_check(cid, title, cat, ok, det))
    return F.array(*items)


def compliance_report(df: DataFrame, by: Sequence[str] = (), framework: str = FRAMEWORK) -> DataFrame:
    """One row per group: facts, ``checks`` array, passed/failed/total/status."""
    facts = compliance_facts(df, by)
    facts = facts.withColumn("checks", checks_array(facts))
    passed = F.size(F.filter("checks", lambda c: c["status"] == "pass")).cast("long")
    total = F.size("checks").cast("long")
    out = facts.withColumn("passed", passed).withColumn("total_checks", total)
    out = out.withColumn("failed", F.col("total_checks") - F.col("passed"))
    status = (
        F.when(F.col("failed") == 0, "pass")
        .when(F.col("passed") / F.col("total_checks") >= PARTIAL_RATIO, "partial")
        .otherwise("fail")
    )
    return out.withColumn("status", status).withColumn("framework", F.lit(framework))


def compliance_checks(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rep = compliance_report(df, by)
    return rep.select(*by, F.posexplode("checks").alias("check_no", "c")).select(
        *by, F.col("check_no").cast("long").alias("check_no"), "c.id", "c.title", "c.category", "c.status", "c.details"
    )


def compliance_summary(df: DataFrame, by: Sequence[str] = (), framework: str = FRAMEWORK) -> DataFrame:
    rep = compliance_report(df, by, framework)
    return rep.select(*by, "framework", "total_checks", "passed", "failed", "status")


def has_anomalies(rep: DataFrame) -> Column:
    """Any check detail mentions an anomaly, or more than 3 checks failed."""
    mention = F.exists("checks", lambda c: F.contains(F.lower(F.coalesce(c["details"], F.lit(""))), F.lit("anomal")))
    return mention | (F.col("failed") > 3)


def adjusted_rate_limit(failed: Column, rate_limit: int = DEFAULT_RATE_LIMIT) -> Column:
    return (
        F.when(failed >= 5, F.lit(max(10, rate_limit // 5)))
        .when(failed >= 3, F.lit(max(30, rate_limit // 3)))
        .otherwise(F.lit(rate_limit))
    )


def tool_decisions(rep: DataFrame, rate_limit: int = DEFAULT_RATE_LIMIT) -> DataFrame:
    """Per group: ``deny`` (known tools named in check details, plus the
    dangerous tools when anomalous), ``allow`` (safe tools minus deny) and the
    adjusted rate limit; all sorted."""
    found = F.filter(
        F.array(*[F.lit(t) for t in KNOWN_TOOLS]),
        lambda t: F.exists("checks", lambda c: F.contains(F.lower(F.coalesce(c["details"], F.lit(""))), t)),
    )
    return _decided(rep, found, has_anomalies(rep), rate_limit)


def policy_from_checks(checks: DataFrame, by: Sequence[str] = (), rate_limit: int = DEFAULT_RATE_LIMIT) -> DataFrame:
    """The policy's decisions for any checks, one row each (``status``, ``details``): per
    group ``failed``, ``anomalous``, ``deny``, ``allow``, ``rate_limit`` as in
    ``tool_decisions``. One flag a tool is aggregated, no list of the group's checks."""
    text = F.lower(F.coalesce(F.col("details"), F.lit("")))
    named = F.array(*[F.bool_or(F.contains(text, F.lit(t))) for t in KNOWN_TOOLS])
    flags = checks.groupBy(*by).agg(
        F.count_if(F.coalesce(F.col("status"), F.lit("")) == "fail").alias("failed"),
        F.coalesce(F.bool_or(F.contains(text, F.lit("anomal"))), F.lit(False)).alias("_mention"),
        named.alias("_named"),
    )
    flags = flags.withColumn("anomalous", F.col("_mention") | (F.col("failed") > 3))
    known = F.array(*[F.lit(t) for t in KNOWN_TOOLS])
    found = F.filter(known, lambda t, i: F.coalesce(F.get("_named", i), F.lit(False)))
    return _decided(flags, found, F.col("anomalous"), rate_limit).drop("_mention", "_named")


def _decided(groups: DataFrame, found: Column, anomalous: Column, rate_limit: int) -> DataFrame:
    danger = F.when(anomalous, F.array(*[F.lit(t) for t in DANGEROUS_TOOLS])).otherwise(F.array().cast("array<string>"))
    deny = F.array_sort(F.array_distinct(F.concat(found, danger)))
    allow = F.array_sort(F.array_except(F.array(*[F.lit(t) for t in SAFE_TOOLS]), deny))
    return groups.withColumn("deny", deny).withColumn("allow", allow).withColumn(
        "rate_limit", adjusted_rate_limit(F.col("failed"), rate_limit)
    )


def tool_policy(df: DataFrame, by: Sequence[str] = (), rate_limit: int = DEFAULT_RATE_LIMIT) -> DataFrame:
    """Rows (by..., tool, decision, rate_limit) of the generated tool policy."""
    dec = tool_decisions(compliance_report(df, by), rate_limit)
    allow = dec.select(*by, F.explode("allow").alias("tool"), F.lit("allow").alias("decision"), "rate_limit")
    deny = dec.select(*by, F.explode("deny").alias("tool"), F.lit("deny").alias("decision"), "rate_limit")
    return allow.unionByName(deny)


def policy_lines(df: DataFrame, by: Sequence[str] = (), rate_limit: int = DEFAULT_RATE_LIMIT) -> DataFrame:
    """Text form of the policy per group: (by..., line_no, text)."""
    dec = tool_decisions(compliance_report(df, by), rate_limit)
    lines = F.concat(
        F.array(F.concat(F.lit("# Framework: "), F.col("framework"))),
        F.array(F.concat(F.lit("rate_limit: "), F.col("rate_limit").cast("string"))),
        F.array(F.lit("allow:")),
        F.when(F.size("allow") > 0, F.transform("allow", lambda t: F.concat(F.lit("  - "), t))).otherwise(
            F.array(F.lit("  # No safe tools identified"))
        ),
        F.array(F.lit("deny:")),
        F.when(F.size("deny") > 0, F.transform("deny", lambda t: F.concat(F.lit("  - "), t))).otherwise(
            F.array(F.lit("  # No tools denied"))
        ),
    )
    return dec.select(*by, F.posexplode(lines).alias("line_no", "text"))
