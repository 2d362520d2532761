from pyspark.sql import functions as F

from sleuth.functions.columns import normalize_timestamp, safe_json, to_epoch
from sleuth.operators.reports import analysis_bundle
from tests.conftest import make_events, ts


def test_to_epoch_rules(spark):
    df = spark.createDataFrame([("2025-01-15T10:00:00Z",), ("12:30",), ("2025",), ("garbage",), (None,), ("2025-01-15T10:00:00+02:00",)], "t string")
    got = [r[0] for r in df.select(to_epoch("t")).collect()]
    assert got[0] == 1736935200.0 and got[1:5] == [0.0, 0.0, 0.0, 0.0] and got[5] == 1736935200.0 - 7200


def test_normalize_timestamp_replaces_zone(spark):
    df = spark.createDataFrame([("2025-01-15T10:00:00+05:00",), ("bad",)], "t string")
    got = df.select(normalize_timestamp("t", F.lit("2030-01-01 00:00:00").cast("timestamp")).cast("string")).collect()
    assert [r[0] for r in got] == ["2025-01-15 10:00:00", "2030-01-01 00:00:00"]


def test_safe_json(spark):
    df = spark.createDataFrame([('{"a": "1"}',), ("nope",)], "v string")
    got = [r[0] for r in df.select(safe_json("v")).collect()]
    assert got == [{"a": "1"}, {}]


def test_analysis_bundle(spark):
    ev = make_events(spark, [dict(risk_score=9.0, blocked=True, timestamp=ts(i)) for i in range(4)])
    b = analysis_bundle(ev, policy={"max_risk_score": 5.0})
    assert b["event_count"].collect()[0][0] == 4
    assert b["deviations"].count() == 4 and b["anomalies"].where(F.col("type") == "high_risk").count() == 4
    assert b["compliance"].collect()[0]["status"] == "pass"
