from pyspark.sql import functions as F

from sleuth.operators import compliance as C
from tests.conftest import make_events, ts


def test_empty_input_fails(spark):
    ev = make_events(spark, [dict(timestamp=ts(0))]).where(F.lit(False))
    s = C.compliance_summary(ev).collect()[0]
    assert (s["total_checks"], s["passed"], s["failed"], s["status"]) == (10, 6, 4, "fail")
    assert C.compliance_checks(ev).count() == 10


def test_all_pass_and_partial(spark):
    ev = make_events(spark, [dict(blocked=True, risk_score=6.0, timestamp=ts(0), source="s1"), dict(timestamp=ts(1), source="s2")])
    s = C.compliance_summary(ev).collect()[0]
    assert s["status"] == "pass" and s["passed"] == 10
    d = {r["id"]: r["details"] for r in C.compliance_checks(ev).collect()}
    assert d["MEASURE-1"] == "2 events logged from 2 sources" and d["MANAGE-1"].startswith("1 blocked")
    ev2 = make_events(spark, [dict(risk_score=1.0, timestamp=ts(0))])
    s2 = C.compliance_summary(ev2).collect()[0]
    assert (s2["failed"], s2["status"]) == (2, "partial")


def test_rate_limit_and_policy(spark):
    df = spark.createDataFrame([(6, 1), (3, 1), (0, 1)], "failed int, x int")
    got = [r[0] for r in df.select(C.adjusted_rate_limit(F.col("failed"), 100)).collect()]
    assert got == [20, 33, 100]
    ev = make_events(spark, [dict(blocked=True, risk_score=6.0, timestamp=ts(0))])
    pol = {(r["tool"], r["decision"]) for r in C.tool_policy(ev).collect()}
    # the MAP-2 detail always mentions anomalies, so the dangerous tools are denied
    assert ("shell", "deny") in pol and ("read_file", "allow") in pol and len(pol) == 14
    lines = [r["text"] for r in C.policy_lines(ev).orderBy("line_no").collect()]
    assert lines[1] == "rate_limit: 100" and "deny:" in lines
