"""T2: alerts on an event stream.

Stateless rules (high risk, rare type, blocked tool, risk limit) are plain
filters on the stream. The sequence rules need the previous events of the
same agent: ``applyInPandasWithState`` keeps, per agent, only the tail the
rules look at (the last two times, the current blocked streak and the last
position) instead of the agent's history. Rows of a batch are ordered by
(timestamp, id); rows at or before the last processed position of their agent
arrive too late for an order-based rule and are reported as ``late`` instead
of being silently dropped. A blocked streak that is still open stays in state
(it is reported when the next non-blocked event arrives).

``ordered_alerts`` does the same for streams whose rows come out of order, and reports
open runs: a stateful processor holds the rows of a bucket of agents until the watermark
has passed their time, releases them in order (agent, timestamp, id) to the same rules, for
all agents of the bucket at once, and sets an event-time timer that reports a run which
nothing has followed for ``run_timeout``.
Rows behind the watermark come out as ``late`` with their position; ``write_alerts``
puts them into a table of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sleuth.operators import anomalies as A
from sleuth.operators import deviations as D
from sleuth.session import let_import

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("agent_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("run_length", T.LongType()),
    ]
)
STATE_SCHEMA = T.StructType(
    [
        T.StructField("e1", T.DoubleType()),  # epoch two events back
        T.StructField("e2", T.DoubleType()),  # epoch of the last event
        T.StructField("n", T.LongType()),  # events seen (0, 1, 2+)
        T.StructField("last_ts", T.StringType()),
        T.StructField("last_id", T.LongType()),
        T.StructField("streak", T.LongType()),
    ]
)


def stateless_alerts(events: DataFrame, rare_event_types: Sequence[str] = (), policy=None) -> DataFrame:
    """Per-event rules; works on batch and streaming frames alike."""
    parts = [A.high_risk(events), A.rare_event_type(events, rare_event_types)]
    pv = D.policy_violations(events, policy)
    if pv is not None:
        parts.append(pv.withColumn("anomaly_severity", F.lit("high")).withColumn("score", F.lit(None).cast("double")))
    out = parts[0].select("type", "id", "agent_id", "score")
    for p in parts[1:]:
        out = out.unionByName(p.select("type", "id", "agent_id", "score"))
    return out


def _findings(pdf: pd.DataFrame, state: tuple, threshold: float) -> tuple[list[tuple], tuple]:
    """Alerts of one agent's new rows (in order) after the tail in ``state``, and
    the next tail. All rows at once: look-backs are shifted arrays."""
    e1, e2, n, _, _, streak = state
    epoch, ids = pdf["epoch"].to_numpy("float64"), pdf["id"].to_numpy("int64")
    tail = [e1, e2][2 - n :] if n else []
    times = np.concatenate([tail, epoch])
    out: list[tuple] = []
    if len(times) > 2:
        start, end = times[:-2], times[2:]
        elapsed = end - start
        with np.errstate(divide="ignore", invalid="ignore"):
            rate = 3.0 / elapsed
        hits = np.flatnonzero((start != 0) & (end != 0) & (elapsed > 0) & (rate > threshold))
        at = hits + 2 - len(tail)  # rows of this batch; the tail's own triples are done
        out += [("high_frequency", int(ids[k]), min(10.0, float(r) * 2), None) for k, r in zip(at, rate[hits]) if k >= 0]
    free = np.flatnonzero(~pdf["blocked"].fillna(False).to_numpy(bool))
    runs = np.diff(np.concatenate([[-1 - streak], free])) - 1  # blocked rows right before each free row
    out += [("blocked_chain", int(ids[k]), min(10.0, float(2 * r)), int(r)) for k, r in zip(free, runs) if r >= 3]
    open_run = len(epoch) - 1 - int(free[-1]) if len(free) else streak + len(epoch)
    last = ([0.0, 0.0] + times.tolist())[-2:]
    return out, (float(last[0]), float(last[1]), min(len(times), 2), str(pdf["timestamp"].iloc[-1]), int(ids[-1]), open_run)


def _sequence_rules(threshold: float):
    thr = float(threshold)

    def step(key, batches, state):
        tail = state.get if state.exists else (0.0, 0.0, 0, None, None, 0)
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["timestamp", "id"], kind="stable", ignore_index=True)
        late = pd.Series(False, index=pdf.index)
        if tail[3] is not None:
            late = (pdf["timestamp"] < tail[3]) | ((pdf["timestamp"] == tail[3]) & (pdf["id"] <= tail[4]))
        found = [("late", int(i), None, None) for i in pdf.loc[late, "id"]]
        fresh = pdf[~late]
        if len(fresh):
            more, tail = _findings(fresh, tail, thr)
            found += more
        state.update(tail)
        if found:
            yield pd.DataFrame([(key[0], *f) for f in found], columns=[f.name for f in ALERT_SCHEMA.fields])

    return step


def sequence_alerts(events: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Stateful per-agent bursts and blocked chains on a streaming frame."""
    let_import(events.sparkSession)
    cols = events.select("agent_id", "id", "timestamp", "epoch", "blocked")
    return cols.groupBy("agent_id").applyInPandasWithState(
        _sequence_rules(threshold), ALERT_SCHEMA, STATE_SCHEMA, "append", "NoTimeout"
    )


ORDERED_SCHEMA = T.StructType([*ALERT_SCHEMA.fields, T.StructField("timestamp", T.StringType()), T.StructField("batch_watermark", T.LongType())])
HELD_SCHEMA = "least long, rows binary"  # rows that came together, in one piece; no least time: rows without times
_HELD = pa.schema([("agent_id", pa.string()), ("ms", pa.int64()), ("timestamp", pa.string()), ("id", pa.int64()), ("epoch", pa.float64()), ("blocked", pa.bool_())])
TAIL_SCHEMA = "agents binary"
_TAILS = pa.schema([
    ("agent_id", pa.string()), ("e1", pa.float64()), ("e2", pa.float64()), ("n", pa.int64()), ("last_id", pa.int64()),
    ("streak", pa.int64()), ("last_ms", pa.int64()), ("reported", pa.int64()),
])
OPEN_RUN = "blocked_chain_open"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 256  # that agents are dealt to
PACK_ROWS = 1 << 17  # rows that a task packs at once
PACKED_BYTES = 32 << 20  # of pieces that Spark hands on at once


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(piece: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(piece)).read_all()


def _piece(rows: pa.Table) -> tuple[int | None, bytes]:
    """Held rows as one entry of the state: the least time and the rows in Arrow's format.
    The state is asked once for many rows."""
    return pc.min(rows["ms"]).as_py(), _packed(rows)


def _pack(batches):
    """Rows as they come -> (bucket, rows): those of a bucket in one piece, so that Spark
    carries one row for many between the JVM and the processor."""
    kept, n = [], 0
    for batch in batches:
        kept.append(batch)
        n += batch.num_rows
        if n >= PACK_ROWS:
            yield _by_bucket(kept)
            kept, n = [], 0
    if n:
        yield _by_bucket(kept)


def _by_bucket(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    table = table.take(pc.sort_indices(table["bucket"])).combine_chunks()
    bucket, rows = table["bucket"].to_numpy(), table.select(_HELD.names).cast(_HELD)
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
    pieces = [_packed(rows.slice(a, b - a)) for a, b in zip(at, [*at[1:], len(bucket)])]
    return pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), pa.array(pieces, pa.binary())], names=["bucket", "rows"])


_WHOLE = {pa.int64(): pd.Int64Dtype()}.get  # whole numbers that may be null, as they are


def _findings_by_agent(rows: pa.Table, tails: pd.DataFrame, threshold: float) -> tuple[pd.DataFrame, pd.DataFrame]:
    """What ``_findings`` tells of one agent, of many at once: alerts of the new rows after
    the agents' ``tails`` (one row each), and the next tails of all agents."""
    codes, agents = pd.factorize(np.concatenate([tails["agent_id"].to_numpy(object), rows["agent_id"].to_pandas().to_numpy(object)]), use_na_sentinel=False)
    code = codes[len(tails) :]
    order = pc.sort_indices(
        pa.table({"code": code, "timestamp": rows["timestamp"], "id": rows["id"]}),
        sort_keys=[("code", "ascending"), ("timestamp", "ascending"), ("id", "ascending")],
    ).to_numpy()
    rows, code = rows.select(["ms", "id", "epoch", "blocked"]).take(order), code[order]
    ids, epoch = rows["id"].to_pandas(types_mapper=_WHOLE), rows["epoch"].to_numpy()
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))  # each agent's first row
    count = np.diff(np.concatenate([first, [len(code)]]))
    end = first + count - 1
    owner = np.repeat(np.arange(len(first)), count)
    after = tails.reindex(range(len(agents))).assign(agent_id=agents)
    number = [c for c in after.columns if c != "agent_id"]
    after[number] = after[number].fillna(0).astype({c: tails[c].dtype for c in number})
    e1, e2, n, streak = (after[c].to_numpy()[code[first]].astype(kind) for c, kind in (("e1", float), ("e2", float), ("n", int), ("streak", int)))

    # each agent's times in a row: the tail's, then those of its rows
    size = count + n
    begin = np.cumsum(size) - size
    times, row = np.empty(size.sum()), np.full(size.sum(), -1)
    at = begin[owner] + n[owner] + np.arange(len(code)) - first[owner]
    times[at], row[at] = epoch, np.arange(len(code))
    times[begin[n == 2]] = e1[n == 2]
    times[(begin + n - 1)[n > 0]] = e2[n > 0]
    whose = np.repeat(np.arange(len(first)), size)
    start, stop = times[:-2], times[2:]
    elapsed = stop - start
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = 3.0 / elapsed
        hits = np.flatnonzero((whose[2:] == whose[:-2]) & (start != 0) & (stop != 0) & (elapsed > 0) & (rate > threshold))
    burst = row[hits + 2]  # a tail has two times at most, so the third is a row's

    free = np.flatnonzero(~rows["blocked"].fill_null(False).to_numpy().astype(bool))
    before = np.concatenate([[-1], free[:-1]])[: len(free)]
    runs = np.where(before >= first[owner[free]], free - before - 1, free - first[owner[free]] + streak[owner[free]])
    free_at = np.full(len(first), -1)
    free_at[owner[free]] = free  # the last one counts
    chain = runs >= 3
    found = pd.DataFrame({
        "agent_id": agents[code[np.concatenate([burst, free[chain]])]],
        "type": ["high_frequency"] * len(burst) + ["blocked_chain"] * int(chain.sum()),
        "id": ids.take(np.concatenate([burst, free[chain]])).array,
        "score": np.minimum(10.0, np.concatenate([rate[hits] * 2, 2.0 * runs[chain]])),
        "run_length": pd.array([None] * len(burst) + runs[chain].tolist(), dtype="Int64"),
    })
    changed, last = code[first], begin + size - 1
    new = {
        "e1": np.where(size > 1, times[np.maximum(last - 1, 0)], 0.0),
        "e2": times[last],
        "n": np.minimum(size, 2),
        "last_id": ids.take(end).array,
        "streak": np.where(free_at >= 0, end - free_at, streak + count),
        "last_ms": np.maximum.reduceat(rows["ms"].to_numpy(), first),
        "reported": 0,
    }
    for name, values in new.items():
        after.iloc[changed, after.columns.get_loc(name)] = values
    return found, after


def _ordered_rules(threshold: float, timeout_ms: int):
    """The processor of one key's agents (built here so that it is shipped by value).
    Rows that are not packed are of the one agent that the key names."""
    from pyspark.sql.streaming import StatefulProcessor

    out_columns = [f.name for f in ORDERED_SCHEMA.fields]

    class OrderedRules(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.held = handle.getListState("held", HELD_SCHEMA)
            self.tail = handle.getValueState("tail", TAIL_SCHEMA)
            self.done = set()  # keys whose rows up to this batch's watermark are released

        def handleInputRows(self, key, rows, timerValues):
            watermark = timerValues.getCurrentWatermarkInMs()
            least = None
            for pdf in rows:
                if "rows" in pdf.columns:
                    new = pa.concat_tables([_unpacked(r) for r in pdf["rows"]])
                else:
                    new = pa.Table.from_pandas(pdf.assign(agent_id=key[0]), schema=_HELD, preserve_index=False)
                behind = pc.fill_null(pc.less_equal(new["ms"], watermark), False)
                late, fresh = new.filter(behind), new.filter(pc.invert(behind))
                if len(late):
                    of = late.select(["agent_id", "id", "timestamp"]).to_pandas(types_mapper=_WHOLE)
                    yield of.assign(type="late", score=None, run_length=None, batch_watermark=watermark)[out_columns]
                if len(fresh):
                    piece = _piece(fresh)
                    self.held.appendValue(piece)
                    least = min((x for x in (least, piece[0]) if x is not None), default=None)
            if least is not None:
                self.handle.registerTimer(least)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if key in self.done:  # another timer of this key, at the same watermark
                return
            self.done.add(key)
            watermark = timerValues.getCurrentWatermarkInMs()
            tails = _unpacked(self.tail.get()[0]) if self.tail.exists() else _TAILS.empty_table()
            tails = tails.to_pandas(types_mapper=_WHOLE)
            pieces = [tuple(p) for p in self.held.get()] if self.held.exists() else []
            due = [rows for least, rows in pieces if least is not None and least <= watermark]
            rest, alerts = pieces, []
            if due:
                held = pa.concat_tables([_unpacked(rows) for rows in due])
                ready = pc.fill_null(pc.less_equal(held["ms"], watermark), False)
                rest = [p for p in pieces if p[0] is None or p[0] > watermark]
                waiting = held.filter(pc.invert(ready))
                if len(waiting):
                    rest.append(_piece(waiting))
                if rest:
                    self.held.put(rest)
                else:
                    self.held.clear()
                found, tails = _findings_by_agent(held.filter(ready), tails, threshold)
                alerts.append(found)
            open_ = (tails["streak"] >= A.CHAIN_MIN) & (tails["reported"] == 0)
            ends = tails["last_ms"] + timeout_ms
            now = open_ & (ends <= watermark)
            if now.any():
                run = tails.loc[now, ["agent_id", "last_id", "streak"]].set_axis(["agent_id", "id", "run_length"], axis=1)
                alerts.append(run.assign(type=OPEN_RUN, score=np.minimum(10.0, 2.0 * run["run_length"].to_numpy(float))))
                tails.loc[now, "reported"] = tails.loc[now, "streak"]
            self.tail.update((_packed(pa.Table.from_pandas(tails, schema=_TAILS, preserve_index=False)),))
            times = [least for least, _ in rest if least is not None] + ends[open_ & ~now].tolist()
            if times:  # each time that any is due, all are looked at
                self.handle.registerTimer(int(min(times)))
            for of in alerts:
                if len(of):
                    yield of.assign(timestamp=None, batch_watermark=watermark)[out_columns]

        def close(self):
            pass

    return OrderedRules()


def ordered_alerts(
    events: DataFrame, delay: str, run_timeout_seconds: float, threshold: float = 0.5, time_col: str = "event_ts", buckets: int = BUCKETS
) -> DataFrame:
    """Bursts, blocked chains and runs still open, per agent, on a streaming frame whose
    rows come up to ``delay`` out of order (``agent_id, id, timestamp, epoch, blocked``
    and ``time_col``). ``late``: rows behind the watermark. State needs RocksDB
    (``start_alerts`` sets it). A run reported as open may go on; it is then reported
    again when it closes, with its whole length. Agents are dealt to ``buckets`` keys of
    the state, so that its calls follow the buckets, not the agents; the number stays
    with a checkpoint."""
    let_import(events.sparkSession)
    marked = events.withWatermark(time_col, delay)
    # whole milliseconds rounded up, as timers and watermarks have them; as a plain number
    # the time takes no part in Spark's own filter, which drops late rows without a word
    ms = F.ceil(F.unix_micros(F.col(time_col).cast("timestamp")) / 1000).cast("long")
    bucket = F.pmod(F.xxhash64("agent_id"), F.lit(buckets)).cast("int")
    rows = marked.select(bucket.alias("bucket"), "agent_id", "id", "timestamp", "epoch", F.coalesce("blocked", F.lit(False)).alias("blocked"), ms.alias("ms"))
    processor = _ordered_rules(float(threshold), int(run_timeout_seconds * 1000))
    return rows.mapInArrow(_pack, "bucket int, rows binary").groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=ORDERED_SCHEMA, outputMode="append", timeMode="EventTime"
    )


def start_alerts(stream: DataFrame, path: str, checkpoint_location: str, available_now: bool = True):
    """Write ``ordered_alerts``: findings to ``path``/alerts, late rows to ``path``/late.
    Each batch overwrites its own partition, so that a batch run again writes the same."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for name, of in (("alerts", F.col("type") != "late"), ("late", F.col("type") == "late")):
            rows = batch.where(of).withColumn("batch_id", F.lit(batch_id).cast("long"))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{path}/{name}")
        batch.unpersist()

    conf = stream.sparkSession.conf
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.execution.arrow.maxBytesPerBatch": str(PACKED_BYTES)}
    before = {key: conf.get(key, None) for key in settings}
    for key, value in settings.items():
        conf.set(key, value)
    try:
        w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_location)
        return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()
    finally:  # a query keeps the settings it starts with
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def read_alerts(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Findings and late rows that ``start_alerts`` has written."""
    schema = T.StructType([*ORDERED_SCHEMA.fields, T.StructField("batch_id", T.LongType())])
    return tuple(spark.read.schema(schema).parquet(f"{path}/{name}") for name in ("alerts", "late"))


def stream_output_dir(spark) -> str:
    """A fresh folder under the cluster's checkpoint directory for one stream."""
    import uuid

    from sleuth.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, path: str, checkpoint_location: str):
    """Run a streaming frame to completion (availableNow) into a Parquet folder."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint_location)
    q = q.outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
