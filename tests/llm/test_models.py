from __future__ import annotations

import random
import zlib

import cases
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sleuth.llm import language, toxicity


def held(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 == 1


def many(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = list(cases.SYLLABLES)[i % 4]
        text = cases.prose(rng, lang, rng.randint(8, 60))
        out.append((i, text, lang, "s", len(text)))
    return out


def test_language_accuracy_on_the_held_out_fold(spark, tmp_path):
    rows = many() + [(900, None, "en", "s", None), (901, "", "en", "s", None), (902, "12 34 !", "en", "s", None), (None, "the thing and that", None, "s", None)]
    got = language.op4_language(spark, cases.saved(cases.frame(spark, rows), tmp_path)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (900, 901, 902))
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(out) > 80 and sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out)


def test_language_ignores_labels_of_the_held_out_fold(spark):
    rows = many(160)
    wrong = [(i, t, "xx" if held(i) else lang, s, n) for i, t, lang, s, n in rows]
    a, b = (language.train(cases.frame(spark, x)) for x in (rows, wrong))
    assert a.members == b.members and all(np.allclose(a.rest[k].weights, b.rest[k].weights) for k in a.rest)


def test_language_is_learned_in_a_task(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("the driver holds the sample")

    docs = cases.frame(spark, many(40))
    monkeypatch.setattr(language, "learn", fail)
    monkeypatch.setattr(type(docs), "toArrow", fail)
    assert len(language.train(docs).families) > 1


@pytest.mark.parametrize("langs", [[], ["en"]])
def test_language_with_little_to_learn(spark, langs):
    rows = [(i, "the thing and that", lang, "s", None) for i, lang in enumerate(langs * 20)] or [(1, "the thing", None, "s", None)]
    docs = cases.frame(spark, rows, True)
    got = language.identify(docs.select("text", "doc_id", "score"), language.train(docs)).collect()
    assert {r.lang_pred for r in got} == ({"en"} if langs else {"und"})


def test_language_of_an_empty_table(spark, tmp_path):
    assert language.op4_language(spark, cases.saved(cases.frame(spark, []), tmp_path)).count() == 0


def test_grams_do_not_cross_documents():
    texts = ["abcd", "", "x", "ab", "öé"]
    chunk = pa.array(texts, pa.large_string())
    for k, (hashed, offsets) in enumerate(language.grams(chunk)):
        n = language.GRAMS[k]
        assert np.diff(offsets).tolist() == [max(len(t.encode()) - n + 1, 0) for t in texts]
        for d, t in enumerate(texts):
            alone, _ = list(language.grams(pa.array([t], pa.large_string())))[k]
            assert np.array_equal(hashed[offsets[d] : offsets[d + 1]], alone)


# ---- toxicity ----
BAD = ["idiot", "stupid", "moron", "loser", "pathetic"]


def toxic_rows(n=900, seed=5):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = cases.prose(rng, "en", rng.randint(15, 60)).split(" ")
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(BAD)
        rows.append((i, " ".join(w), "en", "s", None))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def english():
    rng = random.Random(1)
    texts = [cases.prose(rng, "en", 200) for _ in range(20)] + [" ".join(BAD + ["worthless", "trash", "the", "you", "are"]) for _ in range(30)]
    return toxicity.smoothed(toxicity.count_letters(texts).astype(float))


@pytest.mark.parametrize(
    "written, meant",
    [("m0r0n", "moron"), ("i d i o t", "idiot"), ("l.o.s.e.r", "loser"), ("stuuuupid", "stupid"), ("p4th3t1c", "pathetic"), ("st*pid", "stupid"), ("tr@sh", "trash"), ("1d10t", "idiot")],
)
def test_obfuscations_are_undone(english, written, meant):
    assert meant in toxicity.Restorer(english).readings(f"you are {written} you.").split()


@pytest.mark.parametrize(
    "written, meant",
    [
        ("i d i o t.", "idiot"), ('"i d i o t"', "idiot"), ("\u201ci d i o t\u201d", "idiot"), ("i. d. i. o. t", "idiot"), ("i - d - i - o - t", "idiot"), ("i  d  i  o  t", "idiot"),
        ("i d 1 o t", "idiot"), ("i d ! o t", "idiot"), ("i.d i.o t", "idiot"), ("i d i \u00f6 t", "idi\u00f6t"), ("\u00e9 \u00e9 t", "\u00e9\u00e9t"), ("path\u20actic", "pathetic"), ("\u00a3oser", "loser"),
        ("t\u00e9\u00e9\u00e9\u00e9t", "t\u00e9t"), ("\u0438\u0418\u0438\u0434", "\u0438\u0434"),
    ],
)
def test_other_forms_are_read_too(english, written, meant):
    reading = toxicity.Restorer(english).readings(f"thing {written} thing").split()
    assert any(r in (meant, meant.replace("\u00e9t", "\u00e9\u00e9t"), "\u0438\u0438\u0434") for r in reading if r[:1] == meant[:1]), reading


def test_amounts_and_lists_of_numbers_stay(english):
    assert toxicity.Restorer(english).readings("it is 5 \u20ac or \u00a3 20 - 1 2 3 4 \u20ac5 \u2014 all") == ""


def test_clean_words_stay(english):
    text = "the thing you are reading is all well, too good to be 42. I am a B (see: this)!\nNext\u00a0line, Été"
    assert toxicity.Restorer(english).readings(text) == ""


def test_suspects_do_not_cross_texts(english):
    restorer = toxicity.Restorer(english)
    texts = ["a b", "c d i", "d i o t and m0r0n", "", "m0r0n"]
    assert restorer.of_chunk(pa.array(texts, pa.large_string())) == [restorer.readings(t) for t in texts]


def test_viterbi_equals_all_readings(english):
    import itertools

    def cost(letters):
        x = y = 0
        total = 0.0
        for c in letters:
            z = toxicity.letter_class(c)
            total -= float(english[x, y, z])
            x, y = y, z
        return total - float(english[x, y, 0])

    for token in ("m0r0n", "1d1ot", "tr@$h", "looooser", "st*p1d"):
        best = min((sum(p for _, p in path) + cost("".join(t for t, _ in path)), "".join(t for t, _ in path)) for path in itertools.product(*toxicity.lattice(token)))
        assert toxicity.decode(token, english) == best[1]


def test_letter_counts():
    c = toxicity.count_letters(["Ab a"]).reshape((toxicity.LETTERS,) * 3)
    assert c[0, 0, 1] == 2 and c[0, 1, 2] == 1 and c[1, 2, 0] == 1 and c[0, 1, 0] == 1


def test_features_do_not_cross_texts():
    texts = ["idiot here", "", "moron", "É ètre", "x"]
    kinds = [list(toxicity.features(pa.array([t], pa.large_string()))) for t in texts]
    for n, (bucket, row) in enumerate(toxicity.features(pa.array(texts, pa.large_string()))):
        for k in range(len(texts)):
            assert bucket[row == k].tolist() == (kinds[k][n][0].tolist() if n < len(kinds[k]) else [])


def test_capitals_count_as_small_letters():
    kinds = [[b.tolist() for b, _ in toxicity.features(pa.array([t], pa.large_string()))] for t in ("ÉTRE Moron", "étre moron")]
    assert kinds[0] == kinds[1]


def test_toxicity_on_the_held_out_fold(spark, tmp_path):
    rows, labels = toxic_rows()
    plain = "the thing and the other thing that re ing ed"
    rows += [(5000, f"{plain} you m0r0n st*pid i d i o t {plain}", "en", "s", None), (5001, None, None, None, None), (5002, "", "en", None, None), (5003, plain * 40, "en", "s", None)]
    folder = cases.saved(cases.frame(spark, rows, True), tmp_path, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.op3_toxicity(spark, folder).collect()
    assert len(got) == len(rows)
    truth = {d: t for d, _, t in labels}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == held(r.doc_id) for r in got)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.97 * len(out)
    by = {r.doc_id: r for r in got}
    assert by[5000].predicted == 1 and by[5001].predicted == by[5002].predicted == by[5003].predicted == 0


def test_held_out_labels_do_not_count(spark, scratch):
    from sleuth.llm.common import Scratch

    rows, labels = toxic_rows(300)
    flipped = [(d, q, 1 - t if held(d) else t) for d, q, t in labels]
    docs = cases.frame(spark, rows)
    a, b = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int"), Scratch(spark)) for x in (labels, flipped))
    assert np.array_equal(a.buckets, b.buckets) and np.allclose(a.weights, b.weights) and np.allclose(a.curve, b.curve)


def test_no_labels_and_empty_tables(spark, scratch):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(cases.frame(spark, many(8)), none, scratch)
    assert {round(r.score, 3) for r in toxicity.score(cases.frame(spark, many(8)), model).collect()} == {0.5}
    assert toxicity.score(cases.frame(spark, []), model).count() == 0
