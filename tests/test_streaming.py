import json
import os
import tempfile

from pyspark.sql import functions as F

from sleuth.streaming.alerts import STATE_SCHEMA, run_to_table, sequence_alerts
from sleuth.streaming.ingest import stream_ingest
from tests.conftest import ts


def _dir():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def _jsonl(folder, name, rows):
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in rows) + "\n")


def test_stream_ingest_two_batches(spark):
    inp, out, ck, rej = _dir(), _dir() + "/events", _dir() + "/ck", _dir() + "/rej"
    _jsonl(inp, "a.jsonl", [{"event_type": "x", "timestamp": ts(1), "risk_score": 9.0}, "oops", {"event_type": "y", "timestamp": ts(2)}])
    stream_ingest(spark, inp, out, ck, as_of="2030-01-01T00:00:00Z", rejected_path=rej).awaitTermination()
    _jsonl(inp, "b.jsonl", [{"event_type": "z", "timestamp": ts(3)}])
    stream_ingest(spark, inp, out, ck, as_of="2030-01-01T00:00:00Z", rejected_path=rej).awaitTermination()
    ev = spark.read.parquet(out).orderBy("id").collect()
    assert [r["event_type"] for r in ev] == ["x", "y", "z"]
    assert [r["batch_id"] for r in ev] == [0, 0, 1] and len({r["id"] for r in ev}) == 3
    assert spark.read.parquet(rej).count() == 1


def test_stream_alerts_across_batches(spark):
    inp = _dir()
    schema = "agent_id string, id long, timestamp string, epoch double, blocked boolean"
    first = [("a", 1, ts(0), 0.0 + 1e9, True), ("a", 2, ts(1), 1.0 + 1e9, True)]
    second = [("a", 3, ts(2), 2.0 + 1e9, True), ("a", 4, ts(3), 3.0 + 1e9, False), ("a", 0, ts(-5), -5.0 + 1e9, False)]
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").json(inp)
    out = _dir()
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(inp)
    run_to_table(sequence_alerts(src, 0.5), out + "/data", out + "/ck")
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").json(inp)
    run_to_table(sequence_alerts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(inp), 0.5), out + "/data", out + "/ck")
    got = sorted((r["type"], r["id"]) for r in spark.read.parquet(out + "/data").collect())
    # bursts need three events: ids 3 and 4; the chain of 3 closes on id 4; id 0 is late
    assert ("blocked_chain", 4) in got and ("late", 0) in got
    assert sorted(i for t, i in got if t == "high_frequency") == [3, 4]
    assert len(STATE_SCHEMA.fields) == 6


def test_stream_ingest_of_generic_files(spark):
    inp, out, ck, rej = _dir(), _dir() + "/events", _dir() + "/ck", _dir() + "/rej"
    _jsonl(inp, "a.jsonl", [{"time": ts(1)}, "broken"])
    _jsonl(inp, "b.csv", ["time,level", f"{ts(2)},low", f"{ts(3)},high"])
    _jsonl(inp, "c.log", ["Feb  9 08:07:06 box tool[1]: on"])
    stream_ingest(spark, inp, out, ck, kind="generic", as_of="2030-01-01T00:00:00Z", rejected_path=rej).awaitTermination()
    _jsonl(inp, "d.txt", ["just text"])
    stream_ingest(spark, inp, out, ck, kind="generic", as_of="2030-01-01T00:00:00Z", rejected_path=rej).awaitTermination()
    ev = spark.read.parquet(out).collect()
    assert {r["source"] for r in ev} == {"generic"} and len({r["id"] for r in ev}) == len(ev) == 5
    assert sorted(r["timestamp"] for r in ev)[:3] == [ts(1), ts(2), ts(3)] and all(r["epoch"] is not None for r in ev)
    assert spark.read.parquet(rej).count() == 1


def test_alerts_do_not_depend_on_batch_bounds():
    import random

    import pandas as pd

    from sleuth.streaming.alerts import _findings
    from tests import pyoracle as O

    rnd = random.Random(4)
    for _ in range(30):
        rows = [dict(id=i, agent_id="a", timestamp=ts(round(rnd.uniform(0, 200), 3)), blocked=rnd.random() < 0.7) for i in range(60)]
        rows = O.text_sorted(rows)
        for r in rows:
            r["epoch"] = O.to_epoch(r["timestamp"])
        tail, found, at = (0.0, 0.0, 0, None, None, 0), [], 0
        while at < len(rows):
            n = rnd.randint(1, 9)
            more, tail = _findings(pd.DataFrame(rows[at : at + n]), tail, 0.5)
            found += more
            at += n
        assert sorted((i, round(s, 6)) for t, i, s, _ in found if t == "high_frequency") == sorted((i, round(s, 6)) for i, s in O.bursts(rows))
        assert sorted((i, n) for t, i, _, n in found if t == "blocked_chain") == sorted((i, n) for i, n, end in O.chains(rows) if not end)


def _ordered(spark, files, delay, timeout, threshold=0.5):
    """Alerts and late rows of files that come one by one."""
    from pyspark.sql import functions as F

    from sleuth.streaming.alerts import ordered_alerts, read_alerts, start_alerts

    inp, out = _dir(), _dir()
    schema = "agent_id string, id long, timestamp string, epoch double, blocked boolean"
    stamp = F.timestamp_micros(F.round(F.col("epoch") * 1e6).cast("long"))
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).withColumn("event_ts", stamp).write.mode("append").parquet(inp)
    src = spark.readStream.schema(schema + ", event_ts timestamp").option("maxFilesPerTrigger", 1).parquet(inp)
    start_alerts(ordered_alerts(src, delay, timeout, threshold), out, out + "/ck").awaitTermination()
    return [x.collect() for x in read_alerts(spark, out)]


def _row(agent, i, t, blocked):
    return (agent, i, ts(t), 1735689600.0 + t, blocked)


def test_rows_out_of_order_equal_the_rules_on_the_ordered_log(spark):
    import random

    from tests import pyoracle as O

    rng = random.Random(8)
    rows = [_row(f"a{i % 3}", i, round(i + rng.uniform(0, 0.9), 3), rng.choice([True, True, None, False])) for i in range(160)]
    dealt = [[] for _ in range(20)]
    for r in rows:
        dealt[min(19, max(0, int(r[1] / 8) + rng.choice([0, 0, 1, -1])))].append(r)
    for part in dealt:
        rng.shuffle(part)
    alerts, late = _ordered(spark, [*dealt, [_row("~", 999, 1e7, False)]], "30 seconds", 1e6, 0.3)
    assert late == []
    want = []
    for agent in ("a0", "a1", "a2"):
        own = [dict(id=i, agent_id=a, timestamp=t, epoch=e, blocked=bool(b)) for a, i, t, e, b in rows if a == agent]
        own = O.text_sorted(own)
        want += [("high_frequency", i, None) for i, _ in O.bursts(own, 0.3)]
        want += [("blocked_chain_open" if end else "blocked_chain", i, n) for i, n, end in O.chains(own)]
    assert sorted((r.type, r.id, r.run_length) for r in alerts if r.agent_id != "~") == sorted(want, key=lambda x: (x[0], x[1]))


def test_an_open_run_is_reported_by_a_timer_and_again_when_it_closes(spark):
    run = [_row("a", i, i * 100, True) for i in range(3)]
    tick = lambda i, t: [_row("tick", i, t, False)]
    files = [run, tick(50, 2000), tick(51, 3000), [_row("a", 9, 3100, True)], [_row("a", 10, 3200, False)], tick(52, 9e5), tick(53, 9e6)]
    alerts, late = _ordered(spark, files, "10 seconds", 600)
    assert [(r.type, r.id, r.run_length) for r in sorted(alerts, key=lambda r: (r.batch_id, r.id)) if r.agent_id == "a"] == [
        ("blocked_chain_open", 2, 3),
        ("blocked_chain", 10, 4),
    ]
    assert late == []


def test_rows_behind_the_watermark_stand_in_their_own_table(spark):
    files = [[_row("a", 1, 0, True)], [_row("a", 2, 500, True)], [_row("a", 3, 100, True), _row("a", 4, 600, False)], [_row("a", 5, 9e6, False)]]
    alerts, late = _ordered(spark, files, "60 seconds", 1e7)
    assert [(r.id, r.timestamp) for r in late] == [(3, ts(100))] and not [r for r in alerts if r.type == "blocked_chain"]


def test_held_rows_of_a_batch_are_one_entry_of_the_state():
    """Many rows that come together go to the state at once and come out whole, and an
    agent's second timer at one watermark reads nothing."""
    import pandas as pd

    from sleuth.streaming.alerts import _ordered_rules

    class State(list):
        reads = 0

        def appendValue(self, value):
            self.append(value)

        def put(self, values):
            self[:] = values

        update = lambda self, value: self.put([value])

        def exists(self):
            return bool(self)

        def get(self):
            self.reads += 1
            return iter(list(self))

    class Handle:
        def __init__(self):
            self.timers = []

        getListState = lambda self, name, schema: State()

        def getValueState(self, name, schema):
            state = State()
            state.get = lambda: state[0]
            return state

        def registerTimer(self, at):
            self.timers.append(at)

    class Times:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = lambda: at

    rules, handle = _ordered_rules(0.5, 10**9), Handle()
    rules.init(handle)
    rows = pd.DataFrame({"ms": [i * 1000 for i in range(500)], "timestamp": [ts(i) for i in range(500)], "id": range(500), "epoch": [1e9 + i for i in range(500)], "blocked": [i % 5 > 0 for i in range(500)]})
    assert list(rules.handleInputRows(("a",), iter([rows.sample(frac=1, random_state=1)]), Times(-1))) == []
    assert len(rules.held) == 1 and handle.timers == [0]
    found = pd.concat(rules.handleExpiredTimer(("a",), Times(199_000), None))
    assert found[found["type"] == "blocked_chain"]["id"].tolist() == list(range(5, 200, 5))
    assert list(rules.handleExpiredTimer(("a",), Times(199_000), None)) == [] and rules.held.reads == 1
    assert len(rules.held) == 1 and 200_000 in handle.timers


def test_many_agents_at_once_equal_the_rules_agent_by_agent():
    import random

    import pandas as pd
    import pyarrow as pa

    from sleuth.streaming.alerts import _HELD, _TAILS, _WHOLE, _findings, _findings_by_agent

    rnd = random.Random(6)
    agents = [None, *(f"a{i}" for i in range(9))]
    tails, one_by_one = _TAILS.empty_table().to_pandas(types_mapper=_WHOLE), {}
    for batch in range(12):
        rows = [dict(agent_id=rnd.choice(agents), ms=batch * 100 + k, timestamp=ts(batch * 100 + k), id=batch * 100 + k,
                     epoch=rnd.choice([None, 0.0, 1e9 + batch * 100 + k]), blocked=rnd.random() < 0.7) for k in range(rnd.choice([1, 30, 60]))]
        want = []
        for agent in {r["agent_id"] for r in rows}:
            pdf = pd.DataFrame([r for r in rows if r["agent_id"] == agent])
            more, one_by_one[agent] = _findings(pdf, one_by_one.get(agent, (0.0, 0.0, 0, None, None, 0)), 0.02)
            want += [(agent, t, i, score, n) for t, i, score, n in more]
        rnd.shuffle(rows)
        found, tails = _findings_by_agent(pa.Table.from_pylist(rows, schema=_HELD), tails, 0.02)
        found = found.astype(object).where(found.notna(), None)
        assert sorted(found.itertuples(index=False, name=None), key=str) == sorted(want, key=str)
    state = tails.astype(object).where(tails.notna(), None).set_index("agent_id")
    assert len(state) == len(one_by_one)
    for agent, (_, e2, n, _, last_id, streak) in one_by_one.items():
        row = state[state.index.isna()].iloc[0] if agent is None else state.loc[agent]
        assert (row["n"], row["last_id"], row["streak"]) == (n, last_id, streak) and (row["e2"] == e2 or row["e2"] is None)


def test_calls_of_the_state_follow_the_buckets_not_the_agents(spark):
    """300 agents of a bucket: the state is asked once for all, rows without a time wait."""
    import pandas as pd
    import pyarrow as pa

    from sleuth.streaming.alerts import _HELD, _ordered_rules, _pack, ordered_alerts

    class State(list):
        reads = 0

        def appendValue(self, value):
            self.append(value)

        def put(self, values):
            self[:] = values

        def update(self, value):
            self[:] = [value]

        def exists(self):
            return bool(self)

        def get(self):
            self.reads += 1
            return iter(list(self)) if self[0][0] is None or isinstance(self[0][0], int) else self[0]

    class Handle:
        def __init__(self):
            self.timers = []

        getListState = getValueState = lambda self, name, schema: State()

        def registerTimer(self, at):
            self.timers.append(at)

    class Times:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = lambda: at

    rows = [dict(bucket=5, agent_id=f"a{k}", ms=t * 1000 + k, timestamp=ts(t), id=t * 1000 + k, epoch=1e9 + t, blocked=t < 3) for t in range(4) for k in range(300)]
    rows.append(dict(bucket=5, agent_id="~", ms=None, timestamp=None, id=-1, epoch=None, blocked=True))
    batch = pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), *_HELD]))
    packed = [b.to_pandas() for b in _pack([batch.slice(0, 500), batch.slice(500)])]
    assert [len(p) for p in packed] == [1] and packed[0]["bucket"].tolist() == [5]
    rules, handle = _ordered_rules(0.5, 10**9), Handle()
    rules.init(handle)
    late = pd.concat(rules.handleInputRows((5,), iter(packed), Times(99)))
    assert sorted(late["agent_id"]) == sorted(f"a{k}" for k in range(100)) and set(late["type"]) == {"late"}
    assert len(rules.held) == 1 and handle.timers == [100]
    found = pd.concat(rules.handleExpiredTimer((5,), Times(10_000), None))
    chains = found[found["type"] == "blocked_chain"]
    assert sorted(chains["agent_id"]) == sorted(f"a{k}" for k in range(100, 300)) and set(chains["run_length"]) == {3}
    assert rules.held.reads == 1 and len(rules.tail) == 1
    assert len(rules.held) == 1 and rules.held[0][0] is None  # the row without a time
    many = spark.range(10).selectExpr("cast(id as string) agent_id", "id", "'t' timestamp", "1d epoch", "true blocked", "timestamp '2025-01-01' event_ts")
    out = _dir()
    many.write.mode("append").parquet(out)
    plan = ordered_alerts(spark.readStream.schema(many.schema).parquet(out), "1 second", 1)._jdf.queryExecution().analyzed().toString()
    assert "bucket" in plan.split("TransformWithState", 1)[1].split("\n")[0]
