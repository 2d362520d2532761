"""Driver test tables and the ``agent_events`` view derived from ``events``.

The mapping is fixed so that Spark and DuckDB see the same event table:

- id = event_id + 1; agent_id = user_id as text; incident_id = 'INC-' || user_id
- source = 'agentgate' for purchase/signup, else 'mcpguard'
- severity from value: >=180 critical, >=140 high, >=80 medium, >=20 low, else info
- blocked = event_type = 'error'; risk_score = least(10, value / 20)
- timestamp = ISO text with microseconds and 'Z'; epoch = seconds since 1970 (UTC)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from sleuth.functions.schema import ISO_FORMAT, iso_text

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Fixed value for reproducible runs: the ingest time stamped on derived events.
AS_OF = "2024-02-01T00:00:00.000000Z"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def agent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised event table built from the driver's ``events`` table."""
    return normalise_events(read_table(spark, sf_dir, "events"))


def stream_agent_events(spark: SparkSession, sf_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    """The same view as a stream over the ``events`` table's files."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a glob matching exactly the table's file(s): the file source then treats
    # the folder as the base instead of requiring the path to be a folder
    pattern = f"{sf_dir.rstrip('/')}/[e]vents.parquet"
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(pattern)
    return normalise_events(src)


def normalise_events(ev: DataFrame) -> DataFrame:
    ts_type = ev.schema["ts"].dataType
    if isinstance(ts_type, T.TimestampNTZType):
        # wall-clock UTC values: microseconds and text do not depend on the
        # session time zone
        micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
        text = F.date_format(F.col("ts"), ISO_FORMAT)
    else:
        micros = F.unix_micros(F.col("ts"))
        text = iso_text(F.col("ts"))
    value = F.col("value")
    uid = F.col("user_id").cast("string")
    return ev.select(
        (F.col("event_id") + 1).alias("id"),
        F.when(F.col("event_type").isin("purchase", "signup"), F.lit("agentgate")).otherwise(F.lit("mcpguard")).alias("source"),
        F.col("event_type"),
        F.when(value >= 180, "critical").when(value >= 140, "high").when(value >= 80, "medium")
        .when(value >= 20, "low").otherwise("info").alias("severity"),
        F.lit("low").alias("confidence"),
        F.col("event_type").alias("title"),
        F.concat(F.lit("user "), uid).alias("description"),
        F.concat(F.lit("user/"), uid).alias("target"),
        (F.col("event_type") == "error").alias("blocked"),
        text.alias("timestamp"),
        F.timestamp_micros(micros).alias("event_ts"),
        (micros / F.lit(1_000_000.0)).alias("epoch"),
        F.least(F.lit(10.0), value / 20.0).alias("risk_score"),
        F.col("props").alias("raw_json"),
        F.to_timestamp(F.lit(AS_OF)).alias("ingested_at"),
        uid.alias("agent_id"),
        F.concat(F.lit("INC-"), uid).alias("incident_id"),
    )


# DuckDB form of the same view, used by the oracle SQL.
AGENT_EVENTS_SQL = """
  SELECT event_id + 1 AS id,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'agentgate' ELSE 'mcpguard' END AS source,
         event_type,
         CASE WHEN value >= 180 THEN 'critical' WHEN value >= 140 THEN 'high' WHEN value >= 80 THEN 'medium'
              WHEN value >= 20 THEN 'low' ELSE 'info' END AS severity,
         'low' AS confidence,
         event_type AS title,
         'user ' || CAST(user_id AS VARCHAR) AS description,
         'user/' || CAST(user_id AS VARCHAR) AS target,
         event_type = 'error' AS blocked,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS timestamp,
         epoch(ts) AS epoch,
         least(10.0, value / 20.0) AS risk_score,
         props AS raw_json,
         CAST(user_id AS VARCHAR) AS agent_id,
         'INC-' || CAST(user_id AS VARCHAR) AS incident_id
  FROM events
"""
