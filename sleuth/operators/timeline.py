"""Timeline queries, listings and statistics.

Stored order is text order ``(timestamp, id)``; correlation and replay use
epoch order ``(epoch, timestamp, id)`` (stable on the stored order).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuth.functions.columns import first_non_empty, fmt1, prefix, severity_color
from sleuth.plans.ordering import SEQ, drop_layout, seek, sequence

TEXT_ORDER = ["timestamp", "id"]
EPOCH_ORDER = ["epoch", "timestamp", "id"]

SHALLOW = 10_000  # rows that a page's top-k may send to the driver
RECENT = 20  # fixed value: rows of the recent-events panel


def filter_events(
    df: DataFrame,
    source: str | None = None,
    event_type: str | None = None,
    severity: str | None = None,
    min_risk: float | None = None,
) -> DataFrame:
    """AND-ed equality filters; empty text means no filter, ``min_risk=0`` is active."""
    if source:
        df = df.where(F.col("source") == F.lit(source))
    if event_type:
        df = df.where(F.col("event_type") == F.lit(event_type))
    if severity:
        df = df.where(F.col("severity") == F.lit(severity))
    if min_risk is not None:
        df = df.where(F.col("risk_score") >= F.lit(float(min_risk)))
    return df


def query_events(
    df: DataFrame,
    source: str | None = None,
    event_type: str | None = None,
    severity: str | None = None,
    min_risk: float | None = None,
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Filtered events in text order: all of them, or one page (``limit``/``offset``).

    Pages are a top-k (``TakeOrderedAndProject``), so no full sort happens. A page
    behind the first ``SHALLOW`` rows, or an offset without a limit, is found by
    ``ordering.seek``: no rows before it are sorted or sent to the driver.
    """
    out = filter_events(df, source, event_type, severity, min_risk)
    if offset and (limit is None or offset + limit > SHALLOW):
        out, offset = seek(out, TEXT_ORDER, offset), 0
    out = out.orderBy(*TEXT_ORDER)
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out


def build_timeline(df: DataFrame, limit: int | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """All events with their 1-based position ``seq`` in text order.

    The position comes from the distributed sequence, so no task holds the whole
    log. ``limit`` keeps the first rows only; without keys that is a top-k, and
    just its rows are numbered.
    """
    if limit is not None and not partition_by:
        df = df.orderBy(*TEXT_ORDER).limit(limit)
    out = drop_layout(sequence(df, TEXT_ORDER, partition_by))
    return out if limit is None else out.where(F.col(SEQ) <= limit)


def event_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("event_count"))


def sources(df: DataFrame) -> DataFrame:
    return df.select("source").distinct().orderBy("source")


def event_types(df: DataFrame) -> DataFrame:
    return df.select("event_type").distinct().orderBy("event_type")


def severity_counts(df: DataFrame) -> DataFrame:
    """Count per severity, most frequent first (ties by name)."""
    return df.groupBy("severity").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "severity")


def severity_distribution(df: DataFrame) -> DataFrame:
    """Pie data: count per severity, missing severity counted as 'info'."""
    return (
        df.groupBy(F.coalesce(F.col("severity"), F.lit("info")).alias("severity"))
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), "severity")
    )


def dashboard_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_distinct("source").alias("source_count"),
        F.count_distinct("event_type").alias("type_count"),
        F.count_if(F.col("blocked")).alias("blocked_count"),
    )


def recent_events(df: DataFrame, n: int = RECENT) -> DataFrame:
    """The last ``n`` events of the timeline, in ascending order."""
    last = df.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)
    return last.orderBy(*TEXT_ORDER)


def timeline_view(df: DataFrame, limit: int | None = None, **filters) -> DataFrame:
    """Display rows of the timeline listing (row #, shortened texts, labels); all
    rows, or the first ``limit``."""
    if limit is None:  # whole timeline: number with the distributed sequence
        numbered = build_timeline(filter_events(df, **filters)).withColumnRenamed(SEQ, "row_no")
    else:  # a page of at most `limit` rows
        from pyspark.sql import Window

        page = query_events(df, limit=limit, **filters)
        numbered = page.withColumn("row_no", F.row_number().over(Window.orderBy(*TEXT_ORDER)).cast("long"))
    return numbered.select(
        "row_no",
        "id",
        "source",
        "severity",
        prefix(first_non_empty("title", "event_type", default="?"), 30).alias("event"),
        prefix(first_non_empty("target", default="—"), 25).alias("target"),
        fmt1("risk_score").alias("risk"),
        F.when(F.col("blocked"), F.lit("BLOCKED")).otherwise(F.lit("OK")).alias("status"),
        prefix("timestamp", 19).alias("time"),
    )


def timeline_points(df: DataFrame) -> DataFrame:
    """Chart rows: time, title, source, severity, type and severity colour."""
    return df.select(
        "id",
        F.col("timestamp").alias("ts"),
        F.col("title").alias("event"),
        "source",
        "severity",
        F.col("event_type").alias("type"),
        severity_color("severity").alias("color"),
    )


def risk_series(df: DataFrame) -> DataFrame:
    """(time, risk, label) in timeline order."""
    return df.select(
        "id",
        F.col("timestamp").alias("ts"),
        F.col("risk_score").alias("risk"),
        F.col("title").alias("label"),
    ).orderBy("ts", "id")


def list_incidents(df: DataFrame) -> DataFrame:
    """Incidents with event count and sorted distinct sources (grouped for real)."""
    return df.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )
