from __future__ import annotations

import resource

import cases
import pytest
from pyspark.sql import functions as F
from test_near_dup_passages import brute_components, covered

import corpus_pipeline as P
from sleuth.llm import common, language, passages
from sleuth.llm.common import Scratch


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rows = [r for r in cases.corpus(1, 90) if r[0] != 306]
    folder = cases.saved(cases.frame(spark, rows, True), tmp_path_factory.mktemp("p"))
    scratch, docs = Scratch(spark), cases.frame(spark, rows, True)
    out = [docs]
    for name, stage in P.STAGES:
        out.append(scratch.write(stage(spark, out[-1], folder), name))
    return out, folder


def rows_of(df):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_columns(stages):
    out, _ = stages
    assert all(x.columns == out[0].columns for x in out[1:5])
    assert "n_words" in out[4].columns and set(r.n_words for r in out[4].collect()) == {"x"}


def test_language_stage_keeps_documents_with_a_language(stages):
    out, _ = stages
    before, after = rows_of(out[0]), rows_of(out[1])
    assert set(after) <= set(before)
    lost = set(before) - set(after)
    assert {r[0] for r in lost} == {300, 301, 302, 304}
    assert language.UNDETERMINED == "und"


def test_near_dup_stage_equals_brute_force(stages):
    out, _ = stages
    before = rows_of(out[1])
    want = {r for r, c in zip(before, brute_components(before), strict=True) if c[2] == r[0]}
    assert set(rows_of(out[2])) == want and out[2].count() == len(want)


def test_passage_stage_cuts_what_is_marked(spark, stages):
    out, _ = stages
    classes, _ = passages.repeats(out[2], Scratch(spark))
    marks = {r.doc_id: r.spans for r in passages.marked(out[2], classes).collect()}
    want = {}
    for r in rows_of(out[2]):
        left = [w for p, w in enumerate(cases.words(r[1])) if p not in covered(marks[r[0]])]
        if left:
            want[r[0]] = left
    after = rows_of(out[3])
    assert {r[0]: cases.words(r[1]) for r in after} == want and len(after) == len(want)
    assert all(r[4] == len(r[1]) for r in after)
    assert sum(bool(m) for m in marks.values()) >= 8


def test_mixing_and_packing(stages):
    out, folder = stages
    sizes, mixed = {}, {}
    for r in rows_of(out[3]):
        sizes[r[3]] = sizes.get(r[3], 0) + len(cases.words(r[1]))
    for r in rows_of(out[4]):
        mixed[r[3]] = mixed.get(r[3], 0) + len(cases.words(r[1]))
    from test_native_mixing_search import water_fill

    want = water_fill(sizes)
    assert all(abs(mixed[s] - want[s]) <= 1 for s in want if want[s] >= 1)
    pieces = out[5]
    per = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert per.where("n != end or n > 1024").count() == 0
    assert pieces.where(F.crc32("ids") != F.col("ids_crc32")).count() == 0


def test_results_are_read_without_python(spark, stages):
    # else whole texts go through Python in batches of 10,000 rows when the result is written
    out, folder = stages
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        plan = stage(spark, out[k], folder)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan


def test_a_task_gives_memory_back_at_its_end(monkeypatch):
    said = []
    monkeypatch.setattr(common, "give_back", lambda: said.append("back"))
    assert [*map(said.append, common.lean(lambda xs: (2 * x for x in xs))(iter([1, 2])))] == [None] * 2
    assert said == [2, 4, "back"]


def test_freed_memory_goes_back_to_the_system():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * resource.getpagesize()

    held = [b"x" * 50_000 for _ in range(4000)]  # small enough to come from the heap
    last, before = held[-1], resident()
    del held
    common.give_back()
    assert before - resident() > 150_000_000 and len(last) == 50_000


def test_run(spark, stages):
    out, folder = stages
    assert P.run(spark, folder).agg(F.sum("length")).first()[0] == out[5].agg(F.sum("length")).first()[0]


NOTHING = [(1, None, None, None, None), (2, None, "en", "s", None), (2, None, "en", "s", None), (3, "", "en", None, 0), (None, " \n", None, "s", None)]


@pytest.mark.parametrize("rows", [[], NOTHING, [(i, t, None, "s", None) for i, t, *_ in cases.corpus(2, 12)[:12]]], ids=["no rows", "no texts", "no languages"])
def test_tables_of_which_nothing_is_left(spark, tmp_path, rows):
    """Without rows, letters or labelled languages the first stage keeps nothing, and the
    stages after it return their columns without a row."""
    docs = cases.frame(spark, rows, True)
    out = P.run(spark, cases.saved(docs, tmp_path))
    assert {"doc_id", "start", "length", "ids", "sequence_id", "offset"} <= set(out.columns)
    assert out.collect() == []
    scratch = Scratch(spark)
    for name, stage in P.STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, ""), name)
        assert docs.columns == cases.frame(spark, rows, True).columns and docs.count() == 0


def test_one_source_and_one_language(spark, tmp_path):
    """All documents stay where one language was learned; one source's target is all of the
    mix, 150 % of its words."""
    rows = [(i, t, "en", "s", None) for i, t, lang, *_ in cases.corpus(3, 60)[:60] if lang == "en"]
    docs = cases.frame(spark, rows)
    scratch = Scratch(spark)
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, scratch.write(stage(spark, docs, ""), name)
        if name == "language":
            assert sorted(r[0] for r in rows_of(docs)) == sorted(r[0] for r in rows)
    n = lambda df: sum(len(cases.words(r[1])) for r in rows_of(df))
    assert abs(n(docs) - 1.5 * n(before)) <= 1
    packed = P.STAGES[-1][1](spark, docs, "")
    assert {r[0] for r in packed.select("doc_id").collect()} == {r[0] for r in rows_of(docs)}
