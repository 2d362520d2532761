from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from sleuth.functions.schema import with_event_defaults  # noqa: E402
from sleuth.session import ensure_checkpoint_dir  # noqa: E402

AS_OF = "2030-01-01T00:00:00Z"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[*]")
        .appName("sleuth-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


def make_events(spark, rows: list[dict], ids: bool = True):
    """Event frame from dicts (missing keys get the table defaults)."""
    keys = ["source", "event_type", "severity", "title", "description", "target", "blocked", "timestamp", "risk_score", "agent_id", "incident_id"]
    data = []
    for i, r in enumerate(rows, 1):
        data.append((i if ids else None, *[r.get(k) for k in keys]))
    schema = (
        "id long, source string, event_type string, severity string, title string, description string, target string, "
        "blocked boolean, timestamp string, risk_score double, agent_id string, incident_id string"
    )
    df = spark.createDataFrame(data, schema)
    present = {k for r in rows for k in r}
    df = df.select("id", *[k for k in keys if k in present])
    return with_event_defaults(df, as_of=AS_OF)


def ts(seconds: float, base: str = "2025-01-01T00:00:00") -> str:
    """ISO text `seconds` after a base time (microsecond precision)."""
    from datetime import datetime, timedelta

    t = datetime.fromisoformat(base) + timedelta(seconds=seconds)
    return t.strftime("%Y-%m-%dT%H:%M:%S.%f") + "Z"
