"""Rule-based anomaly detectors and their union (``detect_anomalies``).

Per-event rules (rare type, high risk) are filters. The sequence rules
(burst, repetition, blocked chain) look at neighbouring events of the whole
log in text order, or of each key's log when ``partition_by`` is given; they
share one halo-window pass over the distributed sequence
(``plans.ordering``) so no task ever holds a whole log or a whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleuth.functions.columns import clamp10, fmt1
from sleuth.operators.timeline import TEXT_ORDER
from sleuth.plans.ordering import halo_window, SEQ, drop_layout, has_lag_in_key, key_struct, lag_in_key, running_max, sequence, with_lags

# Thresholds and scores of the studied detectors.
HIGH_RISK = 8.0
CRITICAL_RISK = 9.0
RARE_SCORE = 8.0
BURST_WINDOW = 3  # events
REPEAT_RUN = 5  # events
REPEAT_SCORE = 7.0
CHAIN_MIN = 3  # blocked events
DEFAULT_BURST_RATE = 0.5  # events per second

REF_COLS = ["seq", "id", "timestamp", "event_type", "source", "severity", "risk_score", "blocked", "agent_id", "incident_id"]


def _ref(df: DataFrame) -> list[str]:
    return [c for c in REF_COLS if c in df.columns]


def _event_ref(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in _ref(df)]


def _with_seq(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Numbered events with the columns that detectors read or report, no others:
    whole rows would be shuffled and cached."""
    if SEQ in df.columns:
        return df
    needed = dict.fromkeys([*_ref(df), *TEXT_ORDER, *partition_by, "epoch", "event_type", "blocked", "risk_score"])
    return sequence(df.select(*needed), TEXT_ORDER, partition_by)


def high_risk(df: DataFrame) -> DataFrame:
    """risk >= 8: critical when >= 9, score = risk."""
    risk = F.col("risk_score").cast("double")
    return df.where(risk >= HIGH_RISK).select(
        F.lit("high_risk").alias("type"),
        F.when(risk >= CRITICAL_RISK, "critical").otherwise("high").alias("anomaly_severity"),
        risk.alias("score"),
        F.format_string("Risk score %s exceeds threshold", fmt1(risk)).alias("description"),
        F.lit(0).alias("phase"),
        F.lit(1).alias("sub"),
        *_event_ref(df),
    )


def rare_event_type(df: DataFrame, rare_types: Sequence[str] = ()) -> DataFrame:
    """Events whose type is in the caller's list: high, score 8."""
    rare = list(dict.fromkeys(rare_types))
    cond = F.col("event_type").isin(rare) if rare else F.lit(False)
    return df.where(cond).select(
        F.lit("rare_event_type").alias("type"),
        F.lit("high").alias("anomaly_severity"),
        F.lit(RARE_SCORE).alias("score"),
        F.format_string("Rare event type '%s' observed", F.col("event_type")).alias("description"),
        F.lit(0).alias("phase"),
        F.lit(0).alias("sub"),
        *_event_ref(df),
    )


def sequence_features(df: DataFrame, partition_by: Sequence[str] = (), with_runs: bool = True) -> DataFrame:
    """One halo pass: look-backs for bursts and repetitions, plus (``with_runs``)
    ``_before``, a running maximum: the row that the run up to the previous row follows."""
    s = _with_seq(df, partition_by)
    w = halo_window()
    pre = {
        "_e2": lag_in_key("epoch", 2, w, partition_by),
        "_h1": has_lag_in_key(1, w, partition_by),
        "_h4": has_lag_in_key(REPEAT_RUN - 1, w, partition_by),
    }
    for j in range(1, REPEAT_RUN):
        pre[f"_t{j}"] = lag_in_key("event_type", j, w, partition_by)
    if not with_runs:
        lags = {"_e2": ("epoch", 2), **{f"_t{j}": ("event_type", j) for j in range(1, REPEAT_RUN)}}
        return with_lags(s, lags, partition_by, flags={"_h1": 1, "_h4": REPEAT_RUN - 1})
    # what ends a run before this row: the last row so far that is not blocked, or the one
    # before the first of its key, told by the previous row
    one, two = F.lag(key_struct(partition_by), 1).over(w), F.lag(key_struct(partition_by), 2).over(w)
    pre["_first2"] = one.isNotNull() & ~one.eqNullSafe(two)
    pre["_prev"] = F.lag(F.struct(F.lit(True).alias("there"), F.coalesce("blocked", F.lit(False)).alias("blocked")), 1).over(w)
    if partition_by:  # a run that ends with its key is reported by the next key's first row
        pre["_prevev"] = F.lag(F.struct(*_event_ref(s)), 1).over(w)
    ended = F.greatest(F.when(F.col("_prev.there") & ~F.col("_prev.blocked"), F.col(SEQ) - 1), F.when(F.col("_first2"), F.col(SEQ) - 2))
    return running_max(s, {"_before": ended}, k=REPEAT_RUN - 1, pre=pre)


def _bursts(feat: DataFrame, threshold: float) -> DataFrame:
    e0, e2 = F.col("_e2"), F.col("epoch")
    elapsed = e2 - e0
    rate = F.lit(float(BURST_WINDOW)) / elapsed
    cond = e0.isNotNull() & (e0 != 0) & (e2 != 0) & (elapsed > 0) & (rate > F.lit(float(threshold)))
    return feat.where(cond).select(
        F.lit("high_frequency").alias("type"),
        F.lit("medium").alias("anomaly_severity"),
        clamp10(rate * 2).alias("score"),
        F.format_string("Burst of %d events in %ss", F.lit(BURST_WINDOW), fmt1(elapsed)).alias("description"),
        F.lit(1).alias("phase"),
        F.lit(0).alias("sub"),
        *_event_ref(feat),
    )


def _repetitions(feat: DataFrame, partition_by: Sequence[str], first_only: bool) -> DataFrame:
    et = F.col("event_type")
    cond = F.col("_h4")
    for j in range(1, REPEAT_RUN):
        cond = cond & F.col(f"_t{j}").eqNullSafe(et)
    hits = feat.where(cond)
    if first_only:
        # first hit per key: a partial aggregate, no row of the key is collected
        firsts = hits.groupBy(*partition_by).agg(F.min(SEQ).alias(SEQ)).select(SEQ)
        hits = hits.join(firsts, SEQ, "left_semi")
    return hits.select(
        F.lit("repetition").alias("type"),
        F.lit("medium").alias("anomaly_severity"),
        F.lit(REPEAT_SCORE).alias("score"),
        F.format_string("Same event repeated %d times: '%s'", F.lit(REPEAT_RUN), et).alias("description"),
        F.lit(2).alias("phase"),
        F.lit(0).alias("sub"),
        *_event_ref(feat),
    )


def _chains(feat: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Each run is told by one row alone: the first row after it, or the log's last row."""
    ref, seq = _ref(feat), F.col(SEQ)
    blocked = F.coalesce(F.col("blocked"), F.lit(False))
    after = F.coalesce(F.col("_prev.blocked"), F.lit(False)) & (~F.col("_h1") | ~blocked)
    n_after = seq - 1 - F.coalesce("_before", F.lit(0))
    n_last = F.when(F.col("_h1"), seq - F.coalesce("_before", F.lit(0))).otherwise(F.lit(1))
    at_log_end = blocked & (seq == F.col("_total"))
    n = F.when(at_log_end & (n_last >= CHAIN_MIN), n_last).when(after, n_after)
    at_end = at_log_end & (n_last >= CHAIN_MIN) | ~F.col("_h1")
    hits = feat.withColumn("_n", n).where(F.col("_n") >= CHAIN_MIN).withColumn("_at_end", at_end)
    n, at_end = F.col("_n"), F.col("_at_end")
    own = F.struct(*_event_ref(feat))
    carrier = F.when(~F.col("_h1"), F.col("_prevev")).otherwise(own) if partition_by else own
    return hits.select(
        F.lit("blocked_chain").alias("type"),
        F.lit("high").alias("anomaly_severity"),
        clamp10((n * 2).cast("double")).alias("score"),
        F.concat(
            F.format_string("Agent had %d consecutive blocked actions", n),
            F.when(at_end, F.lit(" at end")).otherwise(F.lit("")),
        ).alias("description"),
        F.lit(3).alias("phase"),
        F.lit(0).alias("sub"),
        n.alias("run_length"),
        at_end.alias("at_end"),
        *[carrier[c].alias(c) for c in ref],
    )


def high_frequency(df: DataFrame, threshold: float = DEFAULT_BURST_RATE, partition_by: Sequence[str] = ()) -> DataFrame:
    """3 consecutive events faster than ``threshold``/s (both ends with a real time)."""
    return _bursts(sequence_features(df, partition_by, with_runs=False), threshold)


def repetition(df: DataFrame, partition_by: Sequence[str] = (), first_only: bool = True) -> DataFrame:
    """5 consecutive events of one type; only the first hit unless ``first_only=False``."""
    return _repetitions(sequence_features(df, partition_by, with_runs=False), partition_by, first_only)


def blocked_chain(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Maximal runs of >= 3 blocked events, reported on the first event after the
    run, or on its last event (" at end") when the log ends inside the run."""
    return _chains(sequence_features(df, partition_by), partition_by)


def detect_anomalies(
    df: DataFrame,
    high_frequency_threshold: float = DEFAULT_BURST_RATE,
    rare_event_types: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    first_repetition_only: bool = True,
) -> DataFrame:
    """Union of all detectors; order by (phase, seq, sub) for the studied tool's order."""
    feat = sequence_features(df, partition_by)
    parts = [
        rare_event_type(feat, rare_event_types),
        high_risk(feat),
        _bursts(feat, high_frequency_threshold),
        _repetitions(feat, partition_by, first_repetition_only),
        _chains(feat, partition_by),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return drop_layout(out)
