"""T1: parse log files as they arrive and append them to the event table.

Each micro-batch holds whole new files; inside ``foreachBatch`` the batch
readers assign exact line numbers and parse. Ids are ``batch_id * 2^32 +
position`` (deterministic, so a retried batch writes the same rows), and each
batch overwrites only its own ``batch_id`` partition, so a retry after an
executor or driver loss does not duplicate events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuth.functions.schema import EVENT_COLUMNS
from sleuth.plans.ordering import SEQ, drop_layout, sequence
from sleuth.sources import readers as R



def _all_accepted(parse):
    """A reader that rejects nothing, in the form of the others."""
    return lambda lines, as_of: (parse(lines, as_of=as_of), lines.where(F.lit(False)).withColumn("reason", F.lit("")))


PARSERS = {
    "guard": lambda lines, as_of: R.parse_guard_lines(lines, as_of=as_of),
    "gate": lambda lines, as_of: R.parse_gate_lines(lines, as_of=as_of),
    "generic": lambda lines, as_of: R.parse_generic_lines(lines, as_of=as_of),  # format found per file
    "jsonl": lambda lines, as_of: R.parse_jsonl(lines, as_of=as_of),
    "csv": lambda lines, as_of: R.parse_csv_lines(lines, as_of=as_of),
    "syslog": _all_accepted(R.parse_syslog),
    "plain": _all_accepted(R.parse_plain),
}


def _lines_of_batch(batch: DataFrame) -> DataFrame:
    """(file, lineno, value) for a micro-batch of whole files (see read_lines)."""
    from pyspark.sql import Window

    raw = batch.select("file", "_blk", F.monotonically_increasing_id().alias("_mid"), "value")
    splits = raw.groupBy("file", "_blk").agg(F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "_blk", "_m0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return raw.join(splits, ["file", "_blk"]).select("file", (F.col("_off") + F.col("_mid") - F.col("_m0") + 1).alias("lineno"), "value")


def stream_ingest(
    spark: SparkSession,
    input_dir: str,
    table_path: str,
    checkpoint_location: str,
    kind: str = "guard",
    as_of: str | None = None,
    available_now: bool = True,
    rejected_path: str | None = None,
):
    """Start the ingest stream; returns the ``StreamingQuery``."""
    parse = PARSERS[kind]
    src = spark.readStream.format("text").load(input_dir).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_blk"), "value"
    )

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        lines = _lines_of_batch(batch)
        events, rejected = parse(lines, as_of)
        numbered = drop_layout(sequence(events, ["_file", "_lineno"]))
        out = numbered.withColumn("id", (F.lit(batch_id).cast("long") * F.lit(1 << 32) + F.col(SEQ)).cast("long"))
        out = out.select(*EVENT_COLUMNS).withColumn("batch_id", F.lit(batch_id).cast("long"))
        (
            out.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(table_path)
        )
        if rejected_path:
            rejected.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("batch_id").parquet(rejected_path)

    w = src.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
