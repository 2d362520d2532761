"""Normalised event table: schema and defaults (P1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sleuth.functions.columns import to_epoch, to_event_ts

__all__ = ["EVENT_SCHEMA", "EVENT_COLUMNS", "EVENT_DEFAULTS", "ISO_FORMAT", "with_event_defaults", "iso_text", "as_of_text"]

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("blocked", T.BooleanType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("epoch", T.DoubleType()),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("raw_json", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("agent_id", T.StringType()),
        T.StructField("incident_id", T.StringType()),
    ]
)
EVENT_COLUMNS = [f.name for f in EVENT_SCHEMA.fields]

# Insert-time defaults of the event table.
EVENT_DEFAULTS = {
    "source": "unknown",
    "event_type": "unknown",
    "severity": "info",
    "confidence": "low",
    "title": "",
    "description": "",
    "target": "",
    "blocked": False,
    "risk_score": 0.0,
    "raw_json": "{}",
}

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def iso_text(ts: Column) -> Column:
    """TIMESTAMP -> ISO-8601 text with microseconds and 'Z' (session zone UTC)."""
    return F.date_format(ts, ISO_FORMAT)


def as_of_text(as_of: str | None) -> Column:
    """The 'now' used for missing times: a fixed parameter for reproducible runs."""
    if as_of is None:
        return iso_text(F.current_timestamp())
    return F.lit(as_of)


def _truthy(df: DataFrame, name: str) -> Column:
    """Python truthiness of a column of any simple type."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(dtype, T.StringType):
        return F.coalesce(F.length(c) > 0, F.lit(False))
    if isinstance(dtype, (T.NumericType,)):
        return F.coalesce(c != 0, F.lit(False))
    return c.isNotNull()


def with_event_defaults(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """Project any frame with a subset of the event columns onto ``EVENT_SCHEMA``.

    Missing or NULL fields get the table defaults; ``timestamp`` defaults to
    ``as_of``; ``raw`` (struct/map) becomes ``raw_json``; ``epoch`` and
    ``event_ts`` are derived from the text time. ``id`` stays NULL when absent
    (ids are given by ``sinks.append_events``).
    """
    cols = set(df.columns)
    out: list[Column] = []
    for name in EVENT_COLUMNS:
        if name in ("event_ts", "epoch"):
            continue
        if name == "blocked":
            expr = _truthy(df, "blocked") if "blocked" in cols else F.lit(False)
        elif name == "risk_score":
            expr = F.coalesce(F.col("risk_score").cast("double"), F.lit(0.0)) if name in cols else F.lit(0.0)
        elif name == "raw_json":
            if "raw_json" in cols:
                expr = F.coalesce(F.col("raw_json"), F.lit("{}"))
            elif "raw" in cols:
                raw_t = df.schema["raw"].dataType
                expr = F.col("raw") if isinstance(raw_t, T.StringType) else F.to_json(F.col("raw"))
                expr = F.coalesce(expr, F.lit("{}"))
            else:
                expr = F.lit("{}")
        elif name == "timestamp":
            expr = F.coalesce(F.col("timestamp").cast("string"), as_of_text(as_of)) if name in cols else as_of_text(as_of)
        elif name == "ingested_at":
            expr = F.coalesce(F.col(name).cast("timestamp"), F.to_timestamp(as_of_text(as_of))) if name in cols else F.to_timestamp(as_of_text(as_of))
        elif name in EVENT_DEFAULTS:
            expr = F.coalesce(F.col(name).cast("string"), F.lit(EVENT_DEFAULTS[name])) if name in cols else F.lit(EVENT_DEFAULTS[name])
        else:  # id, agent_id, incident_id: nullable keys
            target = EVENT_SCHEMA[name].dataType
            expr = F.col(name).cast(target) if name in cols else F.lit(None).cast(target)
        out.append(expr.alias(name))
    keep = [c for c in df.columns if c.startswith("_")]  # provenance (_file, _lineno, ...)
    projected = df.select(*out, *keep)
    return projected.select(
        *[
            (to_event_ts(F.col("timestamp")).alias("event_ts") if c == "event_ts" else to_epoch(F.col("timestamp")).alias("epoch") if c == "epoch" else F.col(c))
            for c in EVENT_COLUMNS
        ],
        *keep,
    )
