import random

import numpy as np
import pandas as pd

from sleuth.operators import correlate as G
from sleuth.operators.correlate import assign_groups, correlate
from tests.conftest import make_events, ts
from tests import pyoracle as O


def _sizes(df):
    return [r["event_count"] for r in df.orderBy("group_seq").collect()]


def test_golden_small(spark):
    ev = make_events(spark, [dict(timestamp=ts(t)) for t in (0, 30, 3600)])
    assert _sizes(correlate(ev, 60)) == [2, 1]


def test_anchored_not_session(spark):
    ev = make_events(spark, [dict(timestamp=ts(t)) for t in (0, 30, 60, 61, 90, 121, 122, 500)])
    g = correlate(ev, 60).orderBy("group_seq").collect()
    assert [r["event_count"] for r in g] == [3, 3, 1, 1]
    assert [r["group_id"] for r in g] == [1, 4, 7, 8]


def test_group_fields(spark):
    rows = [dict(timestamp=ts(0), source="b", event_type="x", risk_score=2.0), dict(timestamp=ts(10), source="a", event_type="y", risk_score=7.0)]
    g = correlate(make_events(spark, rows), 60).collect()[0]
    assert g["sources"] == ["a", "b"] and g["types"] == ["x", "y"] and g["max_risk"] == 7.0
    assert g["window_start"] == ts(0) and g["window_end"] == ts(10)


def test_equal_times_and_unparsable(spark):
    rows = [dict(timestamp=ts(5)), dict(timestamp=ts(5)), dict(timestamp="garbage"), dict(timestamp=ts(100))]
    g = assign_groups(make_events(spark, rows), 60).collect()
    by_id = {r["id"]: r["group_id"] for r in g}
    assert by_id[3] == 3  # epoch 0 sorts first and is alone
    assert by_id[1] == by_id[2] == 1 and by_id[4] == 4


def test_random_against_python_oracle(spark):
    rnd = random.Random(7)
    evs = []
    for i in range(400):
        t = rnd.choice([rnd.uniform(0, 3000), rnd.uniform(0, 50)])
        evs.append(dict(id=i + 1, timestamp=ts(round(t, 6)), agent_id=str(rnd.randrange(3))))
    df = make_events(spark, [{k: v for k, v in e.items() if k != "id"} for e in evs])
    for w in (1, 60, 600):
        got = sorted((r["group_id"], r["event_count"]) for r in correlate(df, w).collect())
        assert got == sorted(O.groups(evs, w))
        got_k = sorted((r["group_id"], r["event_count"]) for r in correlate(df, w, ["agent_id"]).collect())
        assert got_k == sorted(O.per_key(O.groups, evs, window=w))


def test_one_island_is_split_over_many_tasks(spark):
    """All events lie within the window of their neighbours (one island); pieces of
    the order are labelled apart, and no task has twice the average rows."""
    rnd = random.Random(3)
    evs = [dict(id=i + 1, timestamp=ts(round(rnd.uniform(0, 4000), 3)), agent_id="hot" if rnd.random() < 0.8 else "cold") for i in range(4000)]
    df = make_events(spark, [{k: v for k, v in e.items() if k != "id"} for e in evs])
    for w, keys in ((37.5, []), (600, []), (50, ["agent_id"])):
        g = assign_groups(df, w, keys)
        per_task = [n for n in g.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        assert len(per_task) >= 6 and max(per_task) < 2 * sum(per_task) / len(per_task)
        got = sorted((r["group_id"], r["event_count"]) for r in correlate(df, w, keys).collect())
        assert got == sorted(O.per_key(O.groups, evs, window=w) if keys else O.groups(evs, w))


def test_pieces_of_every_kind(spark, monkeypatch):
    """Regular times (chains that never meet), empty stretches, many small keys."""
    monkeypatch.setattr("sleuth.operators.correlate.num_partitions", lambda df: 9)
    cases = [
        [(t, "a") for t in range(0, 600)],
        [(t, "a") for t in (*range(0, 50), *range(5000, 5050, 5), 9000)],
        [(t % 40, str(t // 12)) for t in range(300)],
    ]
    for rows in cases:
        evs = [dict(id=i + 1, timestamp=ts(t), agent_id=k) for i, (t, k) in enumerate(rows)]
        df = make_events(spark, [{k: v for k, v in e.items() if k != "id"} for e in evs])
        for w in (0, 7, 60):
            got = sorted((r["group_id"], r["event_count"]) for r in correlate(df, w, ["agent_id"]).collect())
            assert got == sorted(O.per_key(O.groups, evs, window=w))


def test_pieces_with_many_steps_are_composed_at_once(monkeypatch):
    """Composed maps equal the pieces' own maps one after the other, without a call a step."""
    rng = np.random.default_rng(5)
    apply = G._apply
    for w in (3.0, 50.0, 0.1):
        epoch = np.sort(np.round(rng.uniform(0, 300, 1200), 1))
        rows = pd.DataFrame({"_pid": np.arange(1200) // 200, "_key": ["a"] * 900 + ["b"] * 300, "epoch": epoch, G.SEQ: np.arange(1, 1201), "id": np.arange(1200) + 7})
        rows.loc[900:, "epoch"] -= rows["epoch"].iloc[900]
        pieces = [next(G._piece_steps(w)(iter([own.reset_index(drop=True)]))) for _, own in rows.groupby("_pid")]
        block = pd.concat(pieces, ignore_index=True).assign(block=0)
        anchors = [None, ("b", 1.0, 0, 0), *[("a", float(t), 0, 0) for t in np.round(rng.uniform(-60, 60, 50), 1)]]
        want = []
        for anchor in anchors:
            for own in pieces:
                anchor = apply(own, anchor, w)
            want.append(anchor)
        monkeypatch.setattr(G, "_apply", None)
        whole = G._composed(w)(block)
        monkeypatch.undo()
        assert [apply(whole, anchor, w) for anchor in anchors] == want


def test_labels_are_added_to_columns_that_stay_in_arrow(spark):
    """The walk makes no Python object of a column that it does not look at."""
    ev = make_events(spark, [dict(timestamp=ts(t), agent_id=None if t else "a") for t in (0, 30, 100)])
    g = assign_groups(ev, 60)
    assert "MapInArrow" in g._jdf.queryExecution().analyzed().toString()
    assert {c: t for c, t in g.dtypes if c in ev.columns} == dict(ev.dtypes)
    got = {r["id"]: r for r in g.collect()}
    assert [got[r["id"]].asDict() | r.asDict() == got[r["id"]].asDict() for r in ev.collect()] == [True] * 3
    assert [got[i]["group_id"] for i in (1, 2, 3)] == [1, 1, 3]
