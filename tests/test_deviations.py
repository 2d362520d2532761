import random

from sleuth.operators import deviations as D
from tests.conftest import make_events, ts


def _ev(spark, types):
    return make_events(spark, [dict(event_type=t, timestamp=ts(i)) for i, t in enumerate(types)])


def test_extra_and_missing(spark):
    extra = D.diff_behavior(_ev(spark, ["read", "write", "delete"]), _ev(spark, ["read", "write"])).collect()
    assert [(r["type"], r["event_type"]) for r in extra] == [("extra_action", "delete")]
    miss = D.diff_behavior(_ev(spark, ["read"]), _ev(spark, ["read", "write", "delete"])).collect()
    assert sorted(r["event_type"] for r in miss if r["type"] == "missing_action") == ["delete", "write"]
    assert D.diff_behavior(_ev(spark, ["read", "write"]), _ev(spark, ["read", "write"])).count() == 0


def test_missing_is_multiset_deficit(spark):
    m = D.missing_actions(_ev(spark, ["a"]), _ev(spark, ["a", "a", "b"])).collect()
    got = sorted((r["event_type"], r["n_expected"], r["n_actual"], r["id"]) for r in m)
    assert got == [("a", 2, 1, 1), ("b", 1, 0, 3)]


def test_policy_golden(spark):
    ev = make_events(spark, [dict(event_type="http_request", risk_score=9.0, timestamp=ts(0))])
    v = D.diff_behavior(ev, policy={"blocked_tools": ["http_request"], "max_risk_score": 5.0}).collect()
    assert len(v) == 2 and {r["rule"] for r in v} == {"blocked_tool", "risk_limit"}


def test_policy_defaults_and_empty(spark):
    ev = make_events(spark, [dict(risk_score=r, timestamp=ts(i)) for i, r in enumerate([1.0, 1.5, 0.0])])
    assert D.diff_behavior(ev, policy={}).count() == 0  # empty policy: no checks at all
    assert D.diff_behavior(ev, policy=None).count() == 0
    v = D.diff_behavior(ev, policy={"blocked_tools": []}).collect()  # default limit 1.0, strict >
    assert [r["risk_score"] for r in v] == [1.5]


def test_first_matching_path_wins(spark):
    ev = make_events(spark, [dict(target="/ETC/passwd", description="see /tmp", timestamp=ts(0)), dict(target="", description="nothing", timestamp=ts(1))])
    v = D.blocked_path(ev, ["/tmp", "/etc/"]).collect()
    assert [(r["id"], r["rule"]) for r in v] == [(1, "/tmp")]
    v2 = D.blocked_path(ev, ["/etc/", "/tmp"]).collect()
    assert [(r["id"], r["rule"]) for r in v2] == [(1, "/etc/")]


def test_null_type_counts_as_extra(spark):
    actual = make_events(spark, [dict(event_type="a", timestamp=ts(0))]).withColumn("event_type", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("string"))
    out = D.extra_actions(actual, _ev(spark, ["a"])).collect()
    assert len(out) == 1


def _plain_first(rules, target, text):
    t, d = (target or "").lower(), (text or "").lower()
    return next((r for r in rules if r.lower() in t or r.lower() in d), None)


def test_long_rule_lists_equal_a_scan_of_the_list(spark, monkeypatch):
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choice("abAB/é") for _ in range(n))
    rules = [word(rnd.randint(2, 9)) for _ in range(3000)]
    texts = [(i, rnd.choice([None, "", word(6)]), rnd.choice([None, word(12), word(3) * 50_000])) for i in range(200)]
    df = spark.createDataFrame(texts, "id long, target string, description string").repartition(3)
    for some in (rules, rules[2000:], [*rules[:1000:40], "", "zzz"]):
        assert len(some) > D.FEW_RULES
        got = {r.id: r.rule for r in D.blocked_path(df, some).select("id", "rule").collect()}
        want = {i: _plain_first(some, t, d) for i, t, d in texts}
        assert got == {i: r for i, r in want.items() if r is not None}
    monkeypatch.setattr(D, "RULE_BYTES", 3000)  # several automata: the earliest rule still wins
    assert len(D._slices(rules, D.RULE_BYTES)) > 4
    got = {r.id: r.rule for r in D.blocked_path(df, rules).select("id", "rule").collect()}
    want = {i: _plain_first(rules, t, d) for i, t, d in texts}
    assert got == {i: r for i, r in want.items() if r is not None}


def test_long_rule_lists_without_a_match_or_rows(spark):
    df = spark.createDataFrame([(1, "x", None)], "id long, target string, description string")
    rules = [f"rule-{i}" for i in range(50)]
    assert D.blocked_path(df, rules).count() == 0
    assert D.blocked_path(df.where("id > 1"), rules).count() == 0
    plan = D.blocked_path(df, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
