from __future__ import annotations

import math
from collections import Counter

import cases
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sleuth.llm import host_rules, licences, mixing, neighbours
from sleuth.llm.common import Scratch


def oracle(sql: str, folder: str) -> list[tuple]:
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    rel = con.sql(sql)
    return rel.project(",".join(sorted(rel.columns))).fetchall()


def rounded(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize(
    "query, sql", [(host_rules.op8_host_rules, host_rules.OP8_SQL), (licences.op9_licences, licences.OP9_SQL), (mixing.op7_mixing, mixing.OP7_SQL)]
)
def test_queries_equal_sql(spark, tmp_path, query, sql):
    rows = cases.corpus() + [(400, "Spam # one two one two\nSpam # one two one two\n\nReleased under the MIT License.\nAll rights reserved.", "en", "s0", None)]
    folder = cases.saved(cases.frame(spark, rows), tmp_path)
    df = query(spark, folder)
    assert rounded(map(tuple, df.select(*sorted(df.columns)).collect())) == rounded(oracle(sql, folder))


@pytest.mark.parametrize("query", [host_rules.op8_host_rules, licences.op9_licences, mixing.op7_mixing])
def test_empty_tables(spark, tmp_path, query):
    assert query(spark, cases.saved(cases.frame(spark, []), tmp_path)).count() == 0


# ---- host rules ----
def brute_measures(text):
    w = cases.words(text)
    t = text or ""
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(wins)
    again = {p for i, x in enumerate(wins) if n[x] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if cases.words(x)]
    failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), failed


def test_measures_equal_plain_python(spark, scratch):
    rows = cases.corpus() + [(400, "a b c d e f a b c d e g\nx y\nx y\n \n\nx y # $", "en", "s0", None), (401, "p q r s t u v p q r s t u v w", "en", "s0", None)]
    out = host_rules.judge(cases.frame(spark, rows, True), scratch).collect()
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert got == sorted(brute_measures(r[1]) for r in rows)


def test_host_verdicts(spark, scratch):
    good, bad = "one two three four five six seven eight nine ten eleven", "x"
    rows = [(i, good if i % 10 else bad, "en", "good", None) for i in range(100)]
    rows += [(100 + i, good if i % 10 == 0 else bad, "en", "bad", None) for i in range(100)]
    rows += [(200, bad, "en", "tiny", None), (201, good, "en", None, None), (202, good, "en", "fresh", None)]
    out = {r.doc_id: r for r in host_rules.judge(cases.frame(spark, rows), scratch).collect()}
    assert out[1].kept and not out[0].kept  # a failure on a good host goes, the rest stays
    assert not out[100].base_failed and not out[100].kept  # a good document on a bad host goes
    assert out[0].host_rate < 0.15 and out[100].host_rate > 0.85
    assert 0.1 < out[200].host_rate < 1.0 and out[201].host_docs == 1  # one document says little
    assert out[202].host_rate > 0


# ---- licences ----
MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


@pytest.mark.parametrize(
    "text, want",
    [
        (MIT, "MIT"),
        ("Some text\nAll rights reserved.\nmore", "proprietary"),
        ("Licensed under the Apache License, Version 2.0. Released under the MIT License.", "Apache-2.0,MIT"),
        ("the license is unknown software", ""),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", ""),
        (None, ""),
    ],
)
def test_licences(spark, text, want):
    assert licences.scan(cases.frame(spark, [(1, text, None, None, None)], True)).first()["licences"] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("// SPDX-License-Identifier: MIT\nint x;", "MIT"),
        ("# SPDX-License-Identifier: Apache-2.0\nimport os", "Apache-2.0"),
        ("/* SPDX-License-Identifier: GPL-3.0-or-later */\n", "GPL-3.0-or-later"),
        ("code\nspdx-license-identifier: BSD-3-Clause", "BSD-3-Clause"),
        ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */", "MPL-2.0"),
        ("See the notice: All rights reserved. More.", "proprietary"),
    ],
)
def test_tags_and_headers_as_published(spark, text, want):
    assert licences.scan(cases.frame(spark, [(1, text, None, None, None)])).first()["licences"] == want


def test_tags_and_headers_equal_sql(spark, tmp_path):
    texts = [
        "# SPDX-License-Identifier: MIT",
        "code\nspdx-license-identifier:\tBSD-3-Clause\nmore",
        "SPDX-License-Identifier:: MIT",
        "SPDX-License-Identifier:MIT",
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed",
        "This Source Code Form is subject to the terms of the Mozilla Public License, V.  2.0.",
        "Mozilla Public License, rev. 2.0. All rights reserved.",
        "terms of v.\n\n2 things. All rights reserved.",
    ]
    folder = cases.saved(cases.frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), tmp_path)
    df = licences.op9_licences(spark, folder)
    got = {r.doc_id: r.licences for r in df.collect()}
    assert got[0] == "MIT" and got[1] == "BSD-3-Clause" and got[5] == "MPL-2.0"
    assert rounded(map(tuple, df.select(*sorted(df.columns)).collect())) == rounded(oracle(licences.OP9_SQL, folder))


def test_notices_without_another_anchor_equal_sql(spark, tmp_path):
    texts = ["(c) 2020 Somebody. All rights\nreserved.", "\u00a9 2020 X. All rights  reserved.", "Some text. ALL RIGHTS-RESERVED", "All\trights\u00a0reserved"]
    folder = cases.saved(cases.frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), tmp_path)
    df = licences.op9_licences(spark, folder)
    assert [r.licences for r in df.orderBy("doc_id").collect()] == ["proprietary"] * len(texts)
    assert rounded(map(tuple, df.select(*sorted(df.columns)).collect())) == rounded(oracle(licences.OP9_SQL, folder))
    assert all(" " not in a for a in licences.ANCHORS)


def test_order_and_gaps_of_sentences(spark):
    a, b = (licences.SENTENCES[k].capitalize() + "." for k in ("mit-grant", "mit-keep"))
    texts = [f"{a} {b}", f"{b} {a}", f"{a} One. Two. {b}", f"{a} One. Two. Three. {b}"]
    out = licences.scan(cases.frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert [r.licences for r in out] == ["MIT", "", "MIT", ""]


def test_known_sentences_are_normal_and_anchored():
    import re

    for s in licences.SENTENCES.values():
        assert s == re.sub("[^a-z0-9]+", " ", s).strip() and any(a in s for a in licences.ANCHORS), s
    assert len(set(licences.SENTENCES.values())) == len(licences.SENTENCES)
    assert {i for _, _, ids in licences.RULES for i in ids} <= set(licences.SENTENCES)


# ---- mixing ----
def water_fill(sizes: dict, share=1.5, passes=2):
    """Targets by sharing the excess again until none is above its bound."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, done = share * sum(sizes.values()), {}
    while len(done) < len(names):
        rest = [s for s in names if s not in done]
        level = left / sum(weight[s] for s in rest)
        over = [s for s in rest if weight[s] * level >= passes * sizes[s]]
        for s in over or rest:
            done[s] = passes * sizes[s] if over else weight[s] * level
            left -= done[s]
    return done


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_takes(spark, scratch, seed):
    rows = cases.corpus(seed)
    out, pieces = mixing.mix_documents(cases.frame(spark, rows, True), scratch, block=32)
    out = out.collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(cases.words(r[1]))
    want = water_fill(dict(sizes))
    taken = Counter()
    for r in out:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(out) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in want)
    pieces = pieces.collect()
    assert sum(p.words for p in pieces) == sum(taken.values())
    slots = {(p.slot, p.source): p.rank for p in pieces}
    for s in want:  # ranks follow the slots' order
        ranks = [rank for (_, source), rank in sorted(((k, v) for k, v in slots.items() if k[1] == s), key=lambda x: x[0][0])]
        assert ranks == sorted(ranks)
    total, seen = len(slots), Counter()
    per = Counter(source for _, source in slots)
    for k, (_, source) in enumerate(sorted(slots, key=lambda x: x[0]), 1):  # every stretch of the schedule is near its shares
        seen[source] += 1
        assert all(abs(seen[s] - per[s] * k / total) < 8 for s in per)


def test_the_schedule_decides_the_places(spark, scratch, monkeypatch):
    """Other points give other places in the mix, but the same shares."""
    docs = cases.frame(spark, cases.corpus(4))
    first = {(r._key, r.source): r for r in mixing.mix_documents(docs, scratch, block=32)[0].collect()}
    monkeypatch.setattr(mixing, "GOLDEN", 0.3819660112501051)
    other = {(r._key, r.source): r for r in mixing.mix_documents(docs, Scratch(spark), block=32)[0].collect()}
    assert {k: (r.taken, r.pieces) for k, r in first.items()} == {k: (r.taken, r.pieces) for k, r in other.items()}
    placed = [k for k, r in first.items() if r.taken]
    assert sum(first[k].first_slot != other[k].first_slot for k in placed) > len(placed) // 2
    assert all((r.first_slot is None) == (r.taken == 0) == (r.pieces == 0) for r in first.values())


def test_ranks_are_whole(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOT_CHUNK", 5)
    needs = spark.createDataFrame([("b", 7), (None, 40), ("a", 0), ("c", 1)], "source string, _need long")
    needs = needs.withColumns({"_words": F.lit(1), "source_size": F.lit(1)})
    got = sorted(((r.source or "", r["rank"]) for r in mixing._ranks(spark, needs, 48).collect()))
    assert got == sorted([("b", k) for k in range(7)] + [("", k) for k in range(40)] + [("c", 0)])


def test_mixing_reruns_agree(spark):
    rows = cases.corpus(6)
    a, b = (mixing.mix_documents(cases.frame(spark, x).repartition(n), Scratch(spark))[0].collect() for x, n in ((rows, 3), (list(reversed(rows)), 7)))
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_mixed_texts(spark, scratch):
    rows = [r for r in cases.corpus(2) if r[0] not in (None, 306)]
    docs = cases.frame(spark, rows, True)
    out, _ = mixing.mix_documents(docs, scratch)
    taken = {r.doc_id: r.taken for r in out.collect()}
    texts = mixing.mixed_texts(docs, Scratch(spark))
    assert texts.columns == docs.columns
    got = Counter()
    whole = {r[0]: cases.words(r[1]) for r in rows}
    for r in texts.collect():
        w = cases.words(r.text)
        assert w == whole[r.doc_id][: len(w)] and w
        got[r.doc_id] += len(w)
    assert got == {d: n for d, n in taken.items() if n}


# ---- neighbours ----
VECTORS = "vec_id long, embedding array<float>, label int, v string, shard string"


def brute(rows, every=20, top=20):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, x in ok:
        if q % every == 0:
            out[q] = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in ok if i != q))[:top]
    return out


@pytest.mark.parametrize("n", [12, 300])
def test_small_tables_are_searched_exactly(spark, scratch, n):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(n)]
    rows += [(n + k, rows[3][1]) for k in range(9)]  # ties
    rows += [(1000, None), (1020, [0.0] * 8), (1040, [1.0, None] + [0.0] * 6), (1060, [float("nan")] + [1.0] * 7), (1080, [float("inf")] + [1.0] * 7), (1100, [1.0]), (1120, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], VECTORS)
    got = {}
    for r in neighbours.nearest(df, scratch, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows)
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, len(found) + 1))
        assert [(i, s) for _, i, s in found] == [(i, -s) for s, i in want[q]]


def test_recall_over_shards(spark, scratch, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 1500)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, "", "") for i, v in enumerate(x)], VECTORS)
    got = {}
    for r in neighbours.nearest(df, scratch, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x = x.astype(np.float64)
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(found & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 120 and hit >= 0.9 * 20 * len(got)


def test_no_vectors(spark, scratch):
    df = spark.createDataFrame([(1, None, 0, "", ""), (20, [0.0], 0, "", "")], VECTORS)
    assert neighbours.nearest(df, scratch, F.col("vec_id") % 20 == 0).count() == 0


def test_footrule_equals_its_definition():
    rng = np.random.default_rng(2)
    orders = np.array([rng.permutation(12)[:6] for _ in range(40)], np.uint8)
    gain = neighbours.footrule_gain(neighbours.post(orders), orders[0], len(orders))
    k = 6
    for i, o in enumerate(orders.tolist()):
        place = lambda order, p: order.index(p) if p in order else k
        footrule = sum(abs(place(o, p) - place(orders[0].tolist(), p)) for p in range(12))
        assert footrule == k * (k + 1) - 2 * gain[i]


@pytest.mark.parametrize("rows", [500, 2000, 8192])
@pytest.mark.parametrize("mean", [0.0, 0.5])
@pytest.mark.parametrize("spread", [0.0, 0.5])
def test_recall_of_a_shard(rows, mean, spread):
    """Random directions, with a common mean, with lengths that vary (log-normal)."""
    rng = np.random.default_rng(rows)
    x = rng.normal(size=(rows + 1, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[1:] + mean * x[0]
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * np.exp(spread * rng.normal(size=(rows, 1)))
    pivots, ids = x[: neighbours.PIVOTS], np.arange(rows)
    orders = neighbours.permutations(x, pivots)
    postings, scale, lengths = neighbours.post(orders), neighbours.Scale(pivots), neighbours.lengths_of(x)
    hit, asked = 0, range(0, rows, rows // 50)
    for q in asked:
        found, score = neighbours.search(ids, x, lengths, q, x[q], orders[q], postings, scale, 20)
        exact = x @ x[q]
        exact[q] = -np.inf
        assert np.allclose(score, exact[found], rtol=1e-12) and q not in found
        hit += len(set(found.tolist()) & set(np.argsort(-exact)[:20].tolist()))
    assert hit >= 0.9 * 20 * len(asked)


def test_very_long_and_very_short_vectors(spark, scratch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8)) * 10.0 ** rng.integers(-150, 150, (60, 1))
    df = spark.createDataFrame([(i, v.tolist(), 0, "", "") for i, v in enumerate(x)], VECTORS.replace("float", "double"))
    got = {}
    for r in neighbours.nearest(df, scratch, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = brute([(i, v.tolist()) for i, v in enumerate(x)])
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
