import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from sleuth.operators import timeline
from sleuth.plans.ordering import running_max, seek, sequence, with_lags, with_position
from tests.conftest import make_events, ts


def _frame(spark, n, seed, keys=5):
    rnd = random.Random(seed)
    rows = [(i, rnd.randrange(keys), rnd.randrange(1000), rnd.random() < 0.3) for i in range(n)]
    return spark.createDataFrame(rows, "id long, k long, t long, flag boolean")


def test_sequence_equals_global_row_number(spark):
    for n, parts in [(0, 4), (1, 4), (7, 8), (500, 3), (500, 16)]:
        df = _frame(spark, n, n)
        s = sequence(df, ["t", "id"], partitions=parts)
        g = df.select("id", F.row_number().over(Window.orderBy("t", "id")).alias("g"))
        assert s.join(g, "id").where(F.col("seq") != F.col("g")).count() == 0
        assert s.count() == n


def test_lags_and_running_max_match_global_window(spark):
    df = _frame(spark, 700, 11)
    for pb in [(), ("k",)]:
        s = sequence(df, ["t", "id"], pb, partitions=6)
        lagged = with_lags(s, {"l1": ("t", 1), "l3": ("id", 3)}, pb, flags={"h2": 2})
        w = Window.partitionBy(*pb).orderBy("t", "id") if pb else Window.orderBy("t", "id")
        g = df.select("id", F.lag("t", 1).over(w).alias("g1"), F.lag("id", 3).over(w).alias("g3"), F.lag("id", 2).over(w).isNotNull().alias("gh2"))
        j = lagged.join(g, "id")
        bad = j.where(~(F.col("l1").eqNullSafe(F.col("g1")) & F.col("l3").eqNullSafe(F.col("g3")) & (F.col("h2") == F.col("gh2"))))
        assert bad.count() == 0
        rm = running_max(sequence(df, ["t", "id"], pb, partitions=6), {"m": F.when(F.col("flag"), F.col("id"))})
        gw = Window.orderBy(*pb, "t", "id").rowsBetween(Window.unboundedPreceding, 0)
        g2 = df.select("id", F.max(F.when(F.col("flag"), F.col("id"))).over(gw).alias("gm"))
        assert rm.join(g2, "id").where(~F.col("m").eqNullSafe(F.col("gm"))).count() == 0


def test_position_within_key(spark):
    df = _frame(spark, 300, 5, keys=3)
    p = with_position(df, ["t", "id"], ["k"])
    g = df.select("id", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")).alias("g"))
    assert p.join(g, "id").where(F.col("pos") != F.col("g")).count() == 0


def test_hot_key_is_split_over_partitions(spark):
    # every row belongs to one agent: the per-key sequence still spreads it
    df = spark.range(5000).select(F.col("id"), F.lit("hot").alias("agent"), (F.col("id") * 7 % 1000).alias("t"))
    s = sequence(df, ["t", "id"], ["agent"], partitions=8)
    sizes = [r[1] for r in s.groupBy("_pid").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 5000 / 2
    lagged = with_lags(s, {"p": ("t", 1)}, ["agent"])
    assert lagged.where(F.col("p").isNull()).count() == 1  # only the very first row has no predecessor


def test_partition_count_grows_with_input(spark):
    from sleuth.plans.ordering import num_partitions

    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert num_partitions(df, target_bytes=1 << 16) > num_partitions(df, target_bytes=1 << 30) == 8


def test_sequence_with_reliable_checkpoint(spark):
    df = _frame(spark, 400, 3)
    s = sequence(df, ["t", "id"], checkpoint=True, partitions=4)
    g = df.select("id", F.row_number().over(Window.orderBy("t", "id")).alias("g"))
    assert s.join(g, "id").where(F.col("seq") != F.col("g")).count() == 0
    assert spark.sparkContext.getCheckpointDir()  # written to the shared checkpoint folder


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_seek_equals_sorted_rows(spark):
    rnd = random.Random(4)
    rows = [(i, None if i % 11 == 0 else f"t{rnd.randrange(40):02d}") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(5)
    want = [i for i, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))]
    for offset in (0, 1, 54, 55, 299, 598, 599, 600, 5000):
        got = [r.id for r in seek(df, ["t", "id"], offset).orderBy("t", "id").collect()]
        assert got == want[offset:], offset
    assert seek(df.where("false"), ["t", "id"], 0).count() == 0


def test_deep_pages_send_no_earlier_rows_to_the_driver(spark, monkeypatch):
    ev = make_events(spark, [dict(event_type="a" if i % 3 else "b", timestamp=ts(i // 4)) for i in range(400)]).repartition(6)
    ids = lambda df: [r.id for r in df.collect()]
    whole = timeline.query_events(ev, event_type="a")
    tail = timeline.query_events(ev, event_type="a", offset=250)
    assert ids(tail) == ids(whole)[250:] and len(ids(tail)) == 16
    assert "CollectLimit" not in _plan(tail)
    monkeypatch.setattr(timeline, "SHALLOW", 100)
    for offset, limit in [(30, 40), (95, 20), (250, 50), (266, 5), (0, 7)]:
        page = timeline.query_events(ev, event_type="a", limit=limit, offset=offset)
        assert ids(page) == ids(whole)[offset : offset + limit]
    assert "offset" not in _plan(timeline.query_events(ev, limit=20, offset=200)).lower()


def test_numbers_without_a_second_use_of_the_rows(spark):
    """``numbered`` gives the positions of a sort, with nulls and equal keys, and keeps no rows."""
    import random

    from sleuth.plans import ordering

    rnd = random.Random(3)
    rows = [(rnd.choice([None, "a", "b", "c" * 5]), rnd.choice([None, *range(40)]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "file string, lineno long, i long").repartition(5)
    kept = len(ordering._PERSISTED)
    got = sorted((r["seq"], r["file"], r["lineno"], r["i"]) for r in ordering.numbered(df, ["file", "lineno"])[0].collect())
    assert len(ordering._PERSISTED) == kept
    assert [g[0] for g in got] == list(range(1, 701)) and {g[3] for g in got} == set(range(700))
    key = lambda file, lineno: (file is not None, file or "", lineno is not None, lineno or 0)
    assert [g[1:3] for g in got] == [r[:2] for r in sorted(rows, key=lambda r: key(*r[:2]))]
    none, n = ordering.numbered(df.where("i < 0"), ["file", "lineno"])
    assert none.collect() == [] and n == 0 and ordering.numbered(df, ["lineno"])[1] == 700
