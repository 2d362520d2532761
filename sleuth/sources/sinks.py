"""Sinks: the event table, report and policy text, JSON exports.

Delivery over HTTP is not built (network client); payloads are written as
JSON lines instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleuth.functions.columns import first_non_empty
from sleuth.functions.schema import EVENT_COLUMNS, with_event_defaults
from sleuth.plans.ordering import ROWS_A_TASK, SEQ, drop_layout, num_partitions, numbered, sequence
from sleuth.session import shuffles_freed

EXPORT_SOURCE = "forensics"  # the "source" tag of exported payloads


LAYOUT = ["event_date", "source", "event_type", "epoch", "id"]  # order of the event table's rows
REJECTED = "file string, lineno long, value string, batch string, reader string, reason string"
SMALL = {"compression": "zstd"}
FILTERS = {f"parquet.bloom.filter.enabled#{c}": "true" for c in ("event_type", "severity", "agent_id", "incident_id")}
FILTERS["parquet.bloom.filter.max.bytes"] = str(128 << 10)  # a writer holds those of all its row groups to the file's end


def assign_ids(df: DataFrame, order: Sequence[str], base: int = 0) -> DataFrame:
    """Dense ids ``base+1 ..`` in the given order (distributed sequence)."""
    s = drop_layout(sequence(df, list(order)))
    return s.withColumn("id", (F.col(SEQ) + F.lit(base)).cast("long")).drop(SEQ)


def append_events(df: DataFrame, path: str, as_of: str | None = None, order: Sequence[str] = ("_file", "_lineno")) -> DataFrame:
    """Append events with defaults to the Parquet event table at ``path``.

    Ids continue after the table's largest id, in ``order`` (file, line by
    default), which must tell rows apart. The write is one job: either all rows
    land or none (the committer renames only on success). One writer at a time.
    Layout: partitioned by event date and source; rows are range-partitioned by
    date, source, type, epoch and id, so that a busy day and source spreads over tasks,
    and filters by type and by time prune files and row groups; severities and agents
    have bloom filters where Parquet keeps no dictionary of them.
    """
    return _append(df, path, as_of, order)


def _append(df: DataFrame, path: str, as_of: str | None, order: Sequence[str], folders: Sequence[Column] = (), staged: str | None = None) -> DataFrame:
    """``folders``: named columns that the table is partitioned by before date and source.
    ``staged``: a folder for rows of lines, which are the same each time they are read; they
    get their ids there (``numbered``) and are dealt to the table from there, so that the
    files of the one shuffle are gone before the other begins and no row is kept besides.
    The caller takes the folder away."""
    spark = df.sparkSession
    ev = with_event_defaults(df, as_of)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    names = [c for c in ("batch", "reader") if folders]
    day = F.coalesce(F.to_date("event_ts"), F.lit("1970-01-01").cast("date")).alias("event_date")
    table = spark.read.schema(ev.select(*EVENT_COLUMNS, *folders, day).schema)  # a table may have no rows yet
    base = (table.parquet(path).agg(F.max("id")).first()[0] or 0) if exists else 0
    missing = [c for c in order if c not in ev.columns]
    if missing:
        raise ValueError(f"columns that order the rows are missing: {missing}")
    ev = ev.drop("id")
    options, parts = FILTERS, num_partitions(df)
    if staged:
        options = FILTERS | SMALL
        told = ("id", "event_ts", "epoch")  # times are told from their text once rows are in place
        ev, rows = numbered(ev.drop(*told), order)
        parts = max(parts, rows // ROWS_A_TASK)
        ev = ev.select((F.col(SEQ) + F.lit(base)).cast("long").alias("id"), *[c for c in EVENT_COLUMNS if c not in told], "_reader")
        ev.write.options(**SMALL).parquet(staged)
        ev = with_event_defaults(spark.read.schema(ev.schema).parquet(staged), as_of)
    else:
        ev = assign_ids(ev, order, base)
    out = ev.select(*EVENT_COLUMNS, *folders, day)
    (
        out.repartitionByRange(parts, *names, *LAYOUT)
        .sortWithinPartitions(*names, *LAYOUT)
        .write.mode("append")
        .options(**options)
        .partitionBy(*names, "event_date", "source")
        .parquet(path)
    )
    return table.parquet(path)


def ingest_events(parsed: dict[str, tuple[DataFrame, DataFrame]], path: str, as_of: str | None = None) -> DataFrame:
    """Append what readers give (name -> events, rejected lines) to the table at ``path``,
    rejected lines to the one at ``<path>_rejected``, and count what was written:
    (reader, source, reason, rows), ``reason`` NULL for events, ``source`` NULL for
    rejected lines. The counts come from the written files' footers and folder names,
    not from a second pass over the lines; they do not go wrong when tasks are repeated.
    The tables are partitioned by ``batch`` (one a call) and ``reader`` too, so they are
    tables of their own; the two writes are two jobs, and a call that fails between them
    leaves a batch without rejected lines."""
    spark = parsed[next(iter(parsed))][0].sparkSession
    name_of_batch = "b" + uuid.uuid4().hex
    batch, events, rejected = F.lit(name_of_batch), None, None
    for name, (good, bad) in parsed.items():
        tag = F.lit(name).alias("reader")
        good = with_event_defaults(good, as_of).withColumn("_reader", tag)
        bad = bad.select("file", "lineno", "value", "reason", tag, batch.alias("batch"))
        events = good if events is None else events.unionByName(good, allowMissingColumns=True)
        rejected = bad if rejected is None else rejected.unionByName(bad)
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{path}_staged/{name_of_batch}")
    folders = (F.col("_reader").alias("reader"), batch.alias("batch"))
    with shuffles_freed(spark):
        try:
            written = _append(events, path, as_of, ("_reader", "_file", "_lineno"), folders, staged.toString())
        finally:
            staged.getFileSystem(spark._jsc.hadoopConfiguration()).delete(staged, True)
        rejected.write.mode("append").options(**SMALL).partitionBy("batch", "reader", "reason").parquet(f"{path}_rejected")
    bad = spark.read.schema(REJECTED).parquet(f"{path}_rejected").where(F.col("batch") == batch)
    n = F.count(F.lit(1)).alias("rows")
    accepted = written.where(F.col("batch") == batch).groupBy("reader", "source").agg(n)
    none = F.lit(None).cast("string")
    return accepted.select("reader", "source", none.alias("reason"), "rows").unionByName(
        bad.groupBy("reader", "reason").agg(n).select("reader", none.alias("source"), "reason", "rows")
    )


def read_event_table(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*EVENT_COLUMNS)


def to_security_event(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Dashboard payload per event: message = title or description or 'No message'."""
    return df.select(
        *keep,
        F.coalesce("event_type", F.lit("unknown")).alias("event_type"),
        F.coalesce("severity", F.lit("info")).alias("severity"),
        first_non_empty("title", "description", default="No message").alias("message"),
        F.lit(EXPORT_SOURCE).alias("source"),
        F.coalesce("target", F.lit("")).alias("tool"),
        F.struct(
            F.coalesce(F.col("risk_score"), F.lit(0.0)).alias("risk_score"),
            F.coalesce("source", F.lit("unknown")).alias("source"),
        ).alias("details"),
        F.coalesce(F.col("blocked"), F.lit(False)).alias("blocked"),
    )


def export_security_events(df: DataFrame, path: str) -> None:
    to_security_event(df).write.mode("overwrite").json(path)


def compliance_payload(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """{source, raw{framework, status, passed, total_checks, checks[]}} per group."""
    return report.select(
        *by,
        F.lit(EXPORT_SOURCE).alias("source"),
        F.struct("framework", "status", "passed", "total_checks", "checks").alias("raw"),
    )


def export_compliance_payload(report: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    compliance_payload(report, by).write.mode("overwrite").json(path)


def write_lines(lines: DataFrame, path: str, order: Sequence[str] = ("section_no", "line_no")) -> None:
    """Text lines in order (range-sorted, one file per range)."""
    lines.orderBy(*order).select("text").write.mode("overwrite").text(path)


def write_report(lines: DataFrame, path: str) -> None:
    write_lines(lines, path)


def write_policy(policy_lines: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    write_lines(policy_lines, path, order=(*by, "line_no"))
