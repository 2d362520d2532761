"""Anchored time-window correlation.

A group starts at its first event (the anchor) and takes every following
event (stable epoch order) that is at most ``window_seconds`` after the
anchor; the first later event starts the next group. This is *not* a
gap-based session window.

Plan: the log is range-partitioned in epoch order (per key when
``partition_by``); each range partition is a *piece*, and no step puts more than
a piece into a task, whatever the gaps or the window.

1. Within a piece, the row that follows a row as anchor is the first one of the
   same key that is too far from it, or the first row of the next key. So the
   piece maps the anchor that comes in to the one that goes out: the first of its
   rows that is too far from the incoming anchor starts a chain, and the chain's
   last row goes out (the incoming one, if no row is too far). The map is a step
   function of the incoming time; rows with the same end are one step.
2. The maps of about sqrt(pieces) consecutive pieces are composed to one, these
   are applied in order, and then, within each block, the pieces' own maps. That
   gives every piece its incoming anchor.
3. Every piece labels its rows, streaming, from that anchor on.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sleuth.operators.timeline import EPOCH_ORDER
from sleuth.plans.ordering import SEQ, _keep, drop_layout, num_partitions, sequence
from sleuth.session import let_import

DEFAULT_WINDOW = 60  # seconds; fixed value of the studied tool


_STEPS = "piece long, step long, key string, upto double, out_key string, out_epoch double, out_seq long, out_id long"
_ANCHOR = ["out_key", "out_epoch", "out_seq", "out_id"]
_INCOMING = "piece long, in_key string, in_epoch double, in_seq long, in_id long"


def _first_beyond(times: np.ndarray, anchor: float, w: float) -> int:
    """First place in ascending ``times`` with ``time - anchor > w`` (exact test)."""
    i = int(np.searchsorted(times, anchor + w, side="right"))
    while i < len(times) and not times[i] - anchor > w:
        i += 1
    while i > 0 and times[i - 1] - anchor > w:
        i -= 1
    return i


def _firsts_beyond(times: np.ndarray, anchors: np.ndarray, w: float) -> np.ndarray:
    """``_first_beyond`` of each anchor, all at once."""
    n = len(times)
    at = np.searchsorted(times, anchors + w, side="right")
    if n == 0:
        return at
    # anchor + w may be rounded: move to the exact cut
    while (move := (at < n) & ~(times[np.minimum(at, n - 1)] - anchors > w)).any():
        at[move] += 1
    while (move := (at > 0) & (times[np.maximum(at - 1, 0)] - anchors > w)).any():
        at[move] -= 1
    return at


def _piece_steps(w: float):
    """Steps of each piece's map (rows of a piece come in order)."""

    def chain_ends(key: np.ndarray, e: np.ndarray) -> np.ndarray:
        n = len(e)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(starts[1:], n)
        follow = np.empty(n, np.int64)
        for a, b in zip(starts.tolist(), ends.tolist()):
            follow[a:b] = a + _firsts_beyond(e[a:b], e[a:b], w)
        end = np.where(follow < n, follow, np.arange(n))  # a chain ends at the last row that stays in the piece
        while True:
            after = end[end]
            if (after == end).all():
                return end
            end = after

    def steps(batches):
        parts = [pdf for pdf in batches if len(pdf)]
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        key, e = pdf["_key"].to_numpy(), pdf["epoch"].to_numpy(dtype="float64")
        end = chain_ends(key, e)
        head = len(key) if (key == key[0]).all() else int(np.argmax(key != key[0]))
        last = np.flatnonzero(np.append(end[1:head] != end[: head - 1], True))  # last row of each step
        rows, upto = end[last], e[last].copy()
        if head < len(key):  # an anchor that covers the first key's rows: the next key starts anew
            rows, upto = np.append(rows, end[head]), np.append(upto, np.inf)
        yield pd.DataFrame(
            {
                "piece": np.full(len(rows), pdf["_pid"].iloc[0], dtype="int64"),
                "step": np.arange(len(rows), dtype="int64"),
                "key": key[0],
                "upto": upto,
                "out_key": key[rows],
                "out_epoch": e[rows],
                "out_seq": pdf[SEQ].to_numpy()[rows],
                "out_id": pdf["id"].to_numpy()[rows],
            }
        )

    return steps


def _maps(pdf: pd.DataFrame) -> list[pd.DataFrame]:
    pdf = pdf.sort_values(["piece", "step"], kind="stable")
    return [own.reset_index(drop=True) for _, own in pdf.groupby("piece", sort=True)]


def _apply(own: pd.DataFrame, anchor: tuple | None, w: float) -> tuple:
    """The anchor that goes out of a piece or block."""
    if anchor is None or anchor[0] != own["key"].iat[0]:
        i = 0  # the first row starts anew
    else:
        i = _first_beyond(own["upto"].to_numpy(), anchor[1], w)
        if i == len(own):
            return anchor
    return tuple(own.iloc[i][_ANCHOR])


def _composed(w: float):
    """One map for the consecutive pieces of a block."""

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for own in _maps(pdf):
            if total is None:
                total = own
                continue
            # all steps at once (see ``_apply``): the place in this map, or past its end to stay
            place = _firsts_beyond(own["upto"].to_numpy(), total["out_epoch"].to_numpy(), w)
            place[(total["out_key"] != own["key"].iat[0]).to_numpy()] = 0
            stays = place == len(own)
            out = own[_ANCHOR].take(np.minimum(place, len(own) - 1)).reset_index(drop=True)
            after = total.assign(**{c: total[c].where(stays, out[c]) for c in _ANCHOR})
            if not np.isinf(total["upto"].iat[-1]):  # an anchor that covers all pieces so far meets this one
                if own["key"].iat[0] == total["key"].iat[0]:
                    after = pd.concat([after, own], ignore_index=True)
                else:
                    after = pd.concat([after, own.iloc[:1].assign(upto=np.inf)], ignore_index=True)
            same = (after[_ANCHOR] == after[_ANCHOR].shift(-1)).all(axis=1)
            total = after[~same].reset_index(drop=True)
        return total.assign(piece=pdf["block"].iat[0], step=np.arange(len(total)), key=total["key"].iat[0])[[*_STEP_NAMES]]

    return compose


def _walked(w: float, start: bool):
    """The incoming anchor of each map, in order."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        anchor, rows = None, []
        if start and pd.notna(pdf["in_key"].iat[0]):
            anchor = tuple(pdf[["in_key", "in_epoch", "in_seq", "in_id"]].iloc[0])
        for own in _maps(pdf):
            rows.append((int(own["piece"].iat[0]), *(anchor or (None, None, None, None))))
            anchor = _apply(own, anchor, w)
        out = pd.DataFrame(rows, columns=["piece", "in_key", "in_epoch", "in_seq", "in_id"])
        return out.astype({"in_seq": "Int64", "in_id": "Int64", "in_epoch": "float64"})

    return walk


_STEP_NAMES = ("piece", "step", "key", "upto", *_ANCHOR)


def _label_walk(window_seconds: float, out_schema: T.StructType):
    """Streaming walk over a piece in order: labels every row with its anchor. The
    anchor (key, epoch, seq, id) is carried across Arrow batches; the Python loop
    runs once per group or key, rows are handled with numpy; columns that the
    walk does not look at pass as they are."""
    w = float(window_seconds)
    names = [f.name for f in out_schema.fields]

    def walk(batches):
        begun, cur, a_e, a_s, a_id = False, None, 0.0, 0, 0
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            key, e, sq, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_key", "epoch", SEQ, "id"))
            e = e.astype("float64", copy=False)
            if not begun:
                begun = True
                came = [batch.column(c)[0].as_py() for c in ("in_key", "in_epoch", "in_seq", "in_id")]
                if came[0] is not None:
                    cur, a_e, a_s, a_id = came
                    a_e = np.nan if a_e is None else a_e
            g_s, g_id = np.empty(n, dtype="int64"), np.empty(n, dtype="int64")
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            for i, end in zip(starts.tolist(), [*starts[1:].tolist(), n]):
                if key[i] != cur:
                    cur, a_e, a_s, a_id = key[i], e[i], sq[i], ids[i]
                while i < end:
                    j = i + _first_beyond(e[i:end], a_e, w)
                    g_s[i:j], g_id[i:j] = a_s, a_id
                    if j < end:  # row j is the first one too far: it anchors the next group
                        a_e, a_s, a_id = e[j], sq[j], ids[j]
                    i = j
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-2]), pa.array(g_s), pa.array(g_id)], names)

    return walk


def assign_groups(
    df: DataFrame,
    window_seconds: float = DEFAULT_WINDOW,
    partition_by: Sequence[str] = (),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Events with ``group_seq`` (sequence number of the anchor) and ``group_id``
    (id of the anchor event).

    ``columns`` limits the event columns carried (default: all)."""
    let_import(df.sparkSession)
    w = float(window_seconds)
    keep = list(dict.fromkeys([*(columns or df.columns), *partition_by, *EPOCH_ORDER]))
    s = sequence(df.select(*keep), EPOCH_ORDER, partition_by)
    key = F.to_json(F.struct(*partition_by), {"ignoreNullFields": "false"}) if partition_by else F.lit("")
    s = s.withColumn("_key", key)

    steps = s.select("_pid", "_key", "epoch", SEQ, "id").mapInPandas(_piece_steps(w), _STEPS)
    steps = _keep(steps)  # read twice; a few rows per piece
    size = max(1, math.isqrt(num_partitions(df)))
    blocks = steps.withColumn("block", F.floor(F.col("piece") / size).cast("long"))
    composed = blocks.groupBy("block").applyInPandas(_composed(w), _STEPS)
    # one composed map per block of pieces: about sqrt(pieces) of them
    before = composed.groupBy(F.lit(0).alias("_all")).applyInPandas(_walked(w, False), _INCOMING)
    entered = blocks.join(before.withColumnRenamed("piece", "block"), "block")
    incoming = entered.groupBy("block").applyInPandas(_walked(w, True), _INCOMING)

    # one row per piece: bounded by the partition count
    placed = s.join(F.broadcast(incoming.withColumnRenamed("piece", "_piece")), F.col("_pid") == F.col("_piece"), "left")
    fields = [f for f in drop_layout(s).drop("_key").schema.fields]
    out_schema = T.StructType([*fields, T.StructField("group_seq", T.LongType()), T.StructField("group_id", T.LongType())])
    walked = placed.select(*[f.name for f in fields], "_key", "in_key", "in_epoch", "in_seq", "in_id")
    return walked.mapInArrow(_label_walk(w, out_schema), schema=out_schema)


def correlate(
    df: DataFrame,
    window_seconds: float = DEFAULT_WINDOW,
    partition_by: Sequence[str] = (),
    with_events: bool = False,
) -> DataFrame:
    """One row per correlation group: window_start/end (first/last non-empty
    text time), event_count, sorted distinct sources and types ('?' for
    missing), max_risk; ``with_events=True`` adds the member events (only for
    bounded groups: it collects each group into one row)."""
    g = assign_groups(df, window_seconds, partition_by, columns=["timestamp", "source", "event_type", "risk_score"])
    return summarize_groups(g, partition_by, with_events)


def summarize_groups(g: DataFrame, partition_by: Sequence[str] = (), with_events: bool = False) -> DataFrame:
    """Group rows (see ``correlate``) from events labelled by ``assign_groups``."""
    ts = F.nullif(F.col("timestamp"), F.lit(""))
    aggs = [
        F.min(ts).alias("window_start"),
        F.max(ts).alias("window_end"),
        F.count(F.lit(1)).alias("event_count"),
        F.array_sort(F.collect_set(F.coalesce(F.col("source"), F.lit("?")))).alias("sources"),
        F.array_sort(F.collect_set(F.coalesce(F.col("event_type"), F.lit("?")))).alias("types"),
        F.max(F.coalesce(F.col("risk_score"), F.lit(0.0))).alias("max_risk"),
    ]
    if with_events:
        aggs.append(F.array_sort(F.collect_list(F.struct(SEQ, "id", "timestamp", "source", "event_type", "risk_score"))).alias("events"))
    out = g.groupBy(*partition_by, "group_seq", "group_id").agg(*aggs)
    return out.select(
        *partition_by,
        "group_seq",
        "group_id",
        F.coalesce(F.col("window_start"), F.lit("")).alias("window_start"),
        F.coalesce(F.col("window_end"), F.lit("")).alias("window_end"),
        *[c for c in out.columns if c not in (*partition_by, "group_seq", "group_id", "window_start", "window_end")],
    )
