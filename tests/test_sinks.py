"""The event table's layout, and whole batches of several readers."""

from pyspark.sql import functions as F

from sleuth.sources import readers as RD
from sleuth.sources import sinks as SK
from tests.conftest import AS_OF


def _lines(spark, file, texts):
    return spark.createDataFrame([(file, i, t) for i, t in enumerate(texts, 1)], "file string, lineno long, value string")


def test_a_batch_of_readers_is_written_and_counted(spark, tmp_path):
    guard = _lines(spark, "g", ['{"event_type": "x", "timestamp": "2025-01-01T00:00:00Z"}', "broken", "[1]", "", '{"event_type": "y"}'])
    gate = _lines(spark, "a", ['{"signal_type": "honeypot"}', "no"])
    plain = _lines(spark, "p", ["one line", "another"])
    path = str(tmp_path / "events")

    def ingest():
        parsed = {"guard": RD.parse_guard_lines(guard, as_of=AS_OF), "gate": RD.parse_gate_lines(gate, as_of=AS_OF),
                  "generic": RD.parse_generic_lines(plain, as_of=AS_OF)}
        return {(r["reader"], r["source"], r["reason"]): r["rows"] for r in SK.ingest_events(parsed, path, AS_OF).collect()}

    want = {("guard", "mcpguard", None): 2, ("guard", None, "malformed_json"): 1, ("guard", None, "not_an_object"): 1,
            ("gate", "agentgate", None): 1, ("gate", None, "malformed_json"): 1, ("generic", "generic", None): 2}
    assert ingest() == want
    assert ingest() == want  # counts are of the batch, not of the table
    table = SK.read_event_table(spark, path)
    assert sorted(r[0] for r in table.select("id").collect()) == list(range(1, 11))
    kept = spark.read.parquet(path + "_rejected").where("reader = 'guard'").groupBy("value").count().collect()
    assert {r["value"]: r["count"] for r in kept} == {"broken": 2, "[1]": 2}


def test_a_batch_without_rejected_lines_or_events(spark, tmp_path):
    good = _lines(spark, "g", ['{"event_type": "x"}'])
    rows = SK.ingest_events({"guard": RD.parse_guard_lines(good, as_of=AS_OF)}, str(tmp_path / "a"), AS_OF).collect()
    assert [tuple(r) for r in rows] == [("guard", "mcpguard", None, 1)]
    none = good.where(F.lit(False))
    assert SK.ingest_events({"guard": RD.parse_guard_lines(none, as_of=AS_OF)}, str(tmp_path / "b"), AS_OF).collect() == []


def _rows_read(df):
    """Rows that the scan hands on, after files and row groups were pruned."""
    df.collect()
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan"):
            n += node.metrics().apply("numOutputRows").value()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return n


def test_a_rare_type_and_a_time_range_read_few_row_groups(spark, tmp_path):
    n = 40_000
    ev = spark.range(n).select(
        F.lit("s").alias("source"),
        F.when(F.col("id") % 5000 == 0, "rare").otherwise(F.concat(F.lit("t"), (F.col("id") % 4).cast("string"))).alias("event_type"),
        F.date_format(F.timestamp_seconds(F.col("id") + 1_735_689_600), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.lit("f").alias("_file"), F.col("id").alias("_lineno"), F.sha2(F.col("id").cast("string"), 256).alias("raw_json"),
    )
    spark.conf.set("parquet.block.size", str(64 * 1024))
    try:
        table = SK.append_events(ev, str(tmp_path / "t"), AS_OF)
    finally:
        spark.conf.unset("parquet.block.size")
    rare = table.where("event_type = 'rare'").select("id")
    assert len(rare.collect()) == 8 and _rows_read(rare) < n / 4
    early = table.where(f"epoch < {1_735_689_600 + 2000}").select("id")
    assert len(early.collect()) == 2000 and _rows_read(early) < n / 2


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_a_batch_keeps_no_rows_and_no_shuffle_files(spark, tmp_path):
    """What a batch needs on disk is its table and one shuffle at a time; ids follow the lines."""
    import os
    import time

    from sleuth.plans import ordering

    text = lambda reader, i: f'{{"event_type": "{reader}{i}", "timestamp": "2025-01-{1 + i % 28:02d}T00:00:00Z"}}'
    lines = spark.range(600).selectExpr("concat('f', id % 7) file", "599 - id lineno", "id")
    guard = lines.select("file", "lineno", F.format_string(text("g", 3).replace("g3", "g%d"), "id").alias("value"))
    path = str(tmp_path / "events")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept, there, setting = len(ordering._PERSISTED), _shuffle_files(spark), spark.conf.get(key)
    for batch in range(2):
        counts = SK.ingest_events({"guard": RD.parse_guard_lines(guard, as_of=AS_OF), "more": RD.parse_guard_lines(guard.where("lineno < 100"), as_of=AS_OF)}, path, AS_OF)
        assert len(ordering._PERSISTED) == kept and spark.conf.get(key) == setting
        for _ in range(50):  # files are removed beside the jobs
            left = _shuffle_files(spark) - there
            if not left:
                break
            time.sleep(0.2)
        assert not left
        assert {(r["reader"], r["rows"]) for r in counts.collect()} == {("guard", 600), ("more", 100)}
        there |= _shuffle_files(spark)
    assert not [f for _, _, files in os.walk(f"{path}_staged") for f in files]
    table = spark.read.parquet(path)
    rows = table.select("id", "batch", "reader", "raw_json").orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(1, 1401)) and len({r["batch"] for r in rows}) == 2
    place = {r["value"]: (r["file"], r["lineno"]) for r in guard.collect()}
    first = [(r["reader"], *place[r["raw_json"]]) for r in rows[:700]]
    assert first == sorted(first)
    assert table.where("epoch <=> cast(unix_seconds(event_ts) as double)").count() == 1400
