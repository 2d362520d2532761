"""Every registered query runs on sf0.001 and matches its DuckDB oracle."""

import json
import math

import duckdb
import pytest

import __spark_entry__ as entry
from sleuth.sources.tables import TABLES
from tests.conftest import SF


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    if hasattr(v, "asDict"):
        return {k: _norm(x) for k, x in v.asDict().items()}
    return v if isinstance(v, (int, bool, str, type(None))) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "group_id" in df.columns


@pytest.mark.parametrize("key", sorted(entry.queries()))
def test_query_matches_oracle(spark, con, key):
    df = entry.queries()[key](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    sql = entry.oracle_sql().get(key)
    if sql is None:
        return
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(json.dumps({c: _norm(r[i]) for i, c in enumerate(cols)}, sort_keys=True, default=str) for r in cur.fetchall())
    got = sorted(json.dumps({c: _norm(r[c]) for c in cols}, sort_keys=True, default=str) for r in rows)
    assert got == want
