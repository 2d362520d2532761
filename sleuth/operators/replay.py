"""Replay schedule: epoch order with the delay to the previous event.

No pacing happens here (that is a simulator concern); the schedule is data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuth.operators.timeline import EPOCH_ORDER, build_timeline
from sleuth.plans.ordering import halo_window, SEQ, drop_layout, has_lag_in_key, lag_in_key, running_max, sequence

# Fixed value: the smallest speed divisor of the studied player.
MIN_SPEED = 0.01
REPLAY_LIMIT = 100  # CLI default of the replay listing


def replay_schedule(
    df: DataFrame,
    speed: float = 1.0,
    limit: int | None = None,
    partition_by: Sequence[str] = (),
    on_batch: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Events in stable epoch order with ``replay_delay`` (seconds since the
    previous event / speed, 3 decimals, 0 for the first) and ``replay_offset``
    (seconds since the first event / speed).

    ``limit`` keeps the first N events of the *text* order before the epoch
    sort, as the studied CLI does. ``on_batch`` is applied to the schedule
    (batch form of the per-event callback).
    """
    if limit is not None:
        df = drop_layout(build_timeline(df, limit=limit, partition_by=partition_by)).drop(SEQ)
    s = sequence(df, EPOCH_ORDER, partition_by)
    div = F.lit(max(float(speed), MIN_SPEED))
    pre = {
        "_p1": lag_in_key("epoch", 1, halo_window(), partition_by),
        "_h1": has_lag_in_key(1, halo_window(), partition_by),
    }
    first = {"_first": F.when(~F.col("_h1"), F.struct(F.col(SEQ), F.col("epoch").alias("e")))}
    out = running_max(s, first, k=1, pre=pre)
    out = out.withColumn(
        "replay_delay", F.round(F.when(F.col("_h1"), (F.col("epoch") - F.col("_p1")) / div).otherwise(F.lit(0.0)), 3)
    ).withColumn("replay_offset", F.round((F.col("epoch") - F.col("_first.e")) / div, 3))
    # exact forms: whole microseconds between the events, divided by the speed
    gap_us = F.round((F.col("epoch") - F.col("_p1")) * F.lit(1e6))
    out = out.withColumn("replay_delay_us", F.when(F.col("_h1"), gap_us / div).otherwise(F.lit(0.0))).withColumn(
        "replay_offset_us", F.round((F.col("epoch") - F.col("_first.e")) * F.lit(1e6)) / div
    )
    out = drop_layout(out.drop("_p1", "_h1", "_first"))
    return on_batch(out) if on_batch else out
