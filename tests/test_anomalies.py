import random
import re

from pyspark.sql import functions as F

from sleuth.operators import anomalies as A
from tests.conftest import make_events, ts
from tests import pyoracle as O

# Own events, inserted out of time order: risks around 8 and 9, three in a row within
# two seconds, and a run of blocked events that is still open at the end.
MIXED = [
    dict(source="proxy", event_type="query", blocked=False, timestamp=ts(40), risk_score=8.999),
    dict(source="proxy", event_type="query", blocked=True, timestamp=ts(42), risk_score=1.0),
    dict(source="guard", event_type="login", blocked=False, timestamp=ts(0), risk_score=7.999),
    dict(source="guard", event_type="login", blocked=False, timestamp=ts(20), risk_score=8.0),
    dict(source="guard", event_type="upload", blocked=True, timestamp=ts(41), risk_score=9.0),
    dict(source="proxy", event_type="upload", blocked=True, timestamp=ts(90), risk_score=None),
]


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_mixed_events(spark):
    ev = make_events(spark, MIXED)
    assert _rows(A.high_risk(ev), "id", "anomaly_severity", "score") == [(1, "high", 8.999), (4, "high", 8.0), (5, "critical", 9.0)]
    # by time: 3, 4, 1, 5, 2, 6; only 1, 5, 2 lie within two seconds
    assert _rows(A.high_frequency(ev), "id", "score") == [(2, 3.0)]
    ch = A.blocked_chain(ev).collect()
    assert [(c["id"], c["run_length"], c["score"], c["at_end"]) for c in ch] == [(6, 3, 6.0, True)] and ch[0]["description"].endswith(" at end")
    assert A.repetition(ev).count() == 0


def test_blocked_chain_golden(spark):
    ev = make_events(spark, [dict(event_type="a", blocked=True, timestamp=ts(i)) for i in range(4)])
    ch = A.blocked_chain(ev).collect()
    assert len(ch) == 1 and ch[0]["score"] == 8.0 and ch[0]["run_length"] == 4 and ch[0]["at_end"]
    b = _rows(A.high_frequency(ev), "id", "score")
    assert b == [(3, 3.0), (4, 3.0)]
    assert A.repetition(ev).count() == 0


def test_chain_exactly_three_then_carrier(spark):
    rows = [dict(event_type="x", blocked=b, timestamp=ts(i * 10)) for i, b in enumerate([True, True, True, False, True, True])]
    ch = A.blocked_chain(make_events(spark, rows)).collect()
    assert len(ch) == 1 and ch[0]["id"] == 4 and ch[0]["score"] == 6.0 and not ch[0]["at_end"]


def test_high_risk_thresholds(spark):
    ev = make_events(spark, [dict(risk_score=r, timestamp=ts(i)) for i, r in enumerate([9.5, 8.0, 9.0, 7.99, 5.0])])
    assert _rows(A.high_risk(ev), "score", "anomaly_severity") == [(8.0, "high"), (9.0, "critical"), (9.5, "critical")]


def test_rare_and_empty(spark):
    ev = make_events(spark, [dict(event_type=t, timestamp=ts(i)) for i, t in enumerate(["a", "b", "a"])])
    assert A.rare_event_type(ev, ["a"]).count() == 2
    assert A.rare_event_type(ev, []).count() == 0
    empty = ev.where(F.lit(False))
    assert A.detect_anomalies(empty, rare_event_types=["a"]).count() == 0


def test_unparsable_time_skips_burst(spark):
    rows = [dict(timestamp="not a time"), dict(timestamp=ts(0.1)), dict(timestamp=ts(0.2)), dict(timestamp=ts(0.3))]
    ids = [r["id"] for r in A.high_frequency(make_events(spark, rows)).collect()]
    # text order puts "not a time" last: (t1, t2, t3) fires on id 4, (t2, t3, bad) has a zero epoch
    assert ids == [4]


def test_repetition_first_only_and_all(spark):
    types = ["a"] * 6 + ["b"] * 5 + ["c"]
    rows = [dict(event_type=t, timestamp=ts(i * 100)) for i, t in enumerate(types)]
    ev = make_events(spark, rows)
    assert [r["id"] for r in A.repetition(ev).collect()] == [5]
    assert sorted(r["id"] for r in A.repetition(ev, first_only=False).collect()) == [5, 6, 11]


def _random_events(seed, n=300, agents=4):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        t = rnd.choice([rnd.uniform(0, 400), rnd.uniform(0, 400), 5.0])  # ties on purpose
        out.append(dict(id=i + 1, event_type=rnd.choice("ab"), blocked=rnd.random() < 0.5, timestamp=ts(round(t, 3)), agent_id=str(rnd.randrange(agents))))
    return out


def test_random_against_python_oracle(spark):
    for seed in (1, 2):
        evs = _random_events(seed)
        df = make_events(spark, [{k: v for k, v in e.items() if k != "id"} for e in evs])
        assert sorted((r["id"], round(r["score"], 9)) for r in A.high_frequency(df, 2.0).collect()) == sorted((i, round(s, 9)) for i, s in O.bursts(evs, 2.0))
        assert sorted(r["id"] for r in A.repetition(df, first_only=False).collect()) == sorted(O.repetitions(evs))
        assert sorted((r["id"], r["run_length"], r["at_end"]) for r in A.blocked_chain(df).collect()) == sorted(O.chains(evs))
        byk = A.blocked_chain(df, ["agent_id"]).collect()
        assert sorted((r["id"], r["run_length"], r["at_end"]) for r in byk) == sorted(O.per_key(O.chains, evs))
        rep = A.repetition(df, ["agent_id"], first_only=True).collect()
        assert sorted(r["id"] for r in rep) == sorted(O.per_key(O.repetitions, evs, first_only=True))


def test_blocked_runs_need_no_join_of_the_log(spark):
    ev = make_events(spark, [dict(timestamp=ts(i), blocked=i % 5 != 0, event_type="a", agent_id=str(i % 2)) for i in range(40)])
    for by in ([], ["agent_id"]):
        plan = A.blocked_chain(ev, by)._jdf.queryExecution().executedPlan().toString()
        joins = set(re.findall(r"(\w+Join)\b", plan.split("InMemoryRelation")[0]))
        assert joins <= {"BroadcastHashJoin"}, joins
