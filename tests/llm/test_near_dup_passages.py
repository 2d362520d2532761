from __future__ import annotations

import random

import cases
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from sleuth.llm import graph, near_dup, passages
from sleuth.llm import words as W


def shingle_set(text, width=5):
    w = cases.lowered(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(rows, percent=85):
    """Components of rows by all pairs of their sets."""
    sets = [shingle_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids and sets[i] else r[0]))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_words_and_shingles_equal_plain_python():
    texts = ["", None, "A b", "a B", " x\ty\x0bz \n", "é É ÀB", "a a a a b", "b b b b a", "to be or not to be that is"] + [r[1] for r in cases.corpus()[:5]]
    arr = W.as_strings(pa.array(texts, pa.string()))
    batch = W.words_of(arr)
    assert np.diff(batch.first).tolist() == [len(cases.words(t)) for t in texts]
    flat = [w for t in texts for w in cases.lowered(t)]
    assert len(set(batch.hash.tolist())) == len(set(flat)) == len(set(zip(flat, batch.hash.tolist(), strict=True)))
    hashes, offsets = W.shingles_of(batch)
    assert [len(set(hashes[a:b].tolist())) for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [len(shingle_set(t)) for t in texts]
    pieces = [W.words_of(arr.slice(i, j - i)).hash for i, j in W.text_chunks(arr, 50)]
    assert np.array_equal(np.concatenate(pieces), batch.hash)


@pytest.mark.parametrize("clashes", [False, True])
def test_components_equal_brute_force(spark, scratch, clashes):
    rows = cases.corpus()
    got = near_dup.near_duplicates(cases.frame(spark, rows, clashes), scratch).select("doc_id", "n_shingles", "component_id").collect()
    assert order(map(tuple, got)) == order(brute_components(rows))


def test_large_groups_of_near_copies(spark, scratch, monkeypatch):
    """A family whose members are often further from each other than the threshold,
    beside documents that share a long passage with it."""
    monkeypatch.setattr(near_dup, "SMALL", 4)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rng = random.Random(2)
    base = cases.prose(rng, "en", 120).split(" ")
    rows = []
    for k in range(90):
        edited = list(base)
        for _ in range(rng.randint(1, 4)):
            edited[rng.randrange(len(edited))] = f"w{rng.randrange(10**6)}"
        rows.append((k, " ".join(edited), "en", "s", None))
    for k in range(60):
        rows.append((200 + k, " ".join(base[:70]) + " " + cases.prose(rng, "de", 60), "de", "s", None))
    got = near_dup.near_duplicates(cases.frame(spark, rows), scratch).select("doc_id", "n_shingles", "component_id").collect()
    assert order(map(tuple, got)) == order(brute_components(rows))


def test_large_buckets_of_the_corpus(spark, scratch, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 2)
    rows = cases.corpus(8)
    got = near_dup.near_duplicates(cases.frame(spark, rows), scratch).select("doc_id", "n_shingles", "component_id").collect()
    assert order(map(tuple, got)) == order(brute_components(rows))


def edited_copies(rng, n=200, at=(40, 90, 140)):
    """Two texts of ``n`` words with a Jaccard similarity of 0.858 by default."""
    text = [f"x{rng.randrange(10**9)}" for _ in range(n)]
    other = list(text)
    for k in at:
        other[k] = f"y{rng.randrange(10**9)}"
    return " ".join(text), " ".join(other)


def test_rows_without_an_id_link_like_others(spark, scratch):
    rng = random.Random(8)
    x, y = edited_copies(rng, at=(100,))
    z = y.split(" ")
    z[30] = "z"
    u, v = edited_copies(rng, at=(100,))
    rows = [(None, y), (5, x), (7, " ".join(z)), (None, u), (None, v), (9, None), (None, None)]
    got = near_dup.near_duplicates(cases.frame(spark, [(*r, "en", "s", None) for r in rows]), scratch).collect()
    ids = lambda n: sorted((str(r.doc_id), str(r.component_id)) for r in got if (r.n_shingles > 0) == n)
    assert ids(True) == [("5", "5"), ("7", "5"), ("None", "5"), ("None", "None"), ("None", "None")]
    assert ids(False) == [("9", "9"), ("None", "None")]


def test_links_inside_a_task_are_confirmed_before_they_join():
    """Sets whose upper halves agree and whose 64 bits do not hide no true link."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    own = np.sort(rng.integers(0, 2**63, 100, dtype=np.uint64))
    false = np.sort((own >> np.uint64(32) << np.uint64(32)) | rng.integers(0, 2**31, 100, dtype=np.uint64))
    sets = [own, false, own[:-5]]
    sig = bytes(64)
    t = pa.table(
        {
            "x": [True, False, False],
            "n": [len(x) for x in sets],
            "fp": [b"a", b"b", b"c"],
            "label": [b"a", b"b", b"b"],
            "sig": [sig, sig, sig],
            "set": [x.tobytes() for x in sets],
        },
        pa.schema([("x", pa.bool_()), ("n", pa.int64()), ("fp", pa.binary()), ("label", pa.binary()), ("sig", pa.binary()), ("set", pa.binary())]),
    )
    assert near_dup._hold_against(85)(t).to_pylist() == [{"a": b"a", "b": b"c"}]


def test_pairs_at_the_threshold_agree_in_enough_coordinates():
    rng = np.random.default_rng(5)
    least = []
    for _ in range(3):
        sets, offsets = [], [0]
        for _ in range(1000):  # pairs with 170 of 200 elements in common: 0.85
            both = rng.choice(near_dup.CIRCLE, 200, replace=False)
            for part in (both[:185], np.concatenate([both[:170], both[185:]])):
                sets.append(part)
                offsets.append(offsets[-1] + len(part))
        sig = near_dup.circulant(np.concatenate(sets), np.array(offsets)) & 255
        least.append((sig[::2] == sig[1::2]).sum(axis=1).min())
    assert min(least) >= near_dup.AGREE


def test_a_text_of_several_megabytes(spark, scratch):
    rng = random.Random(9)
    x, y = edited_copies(rng, n=400_000, at=range(0, 400_000, 100))
    rows = [(k, t, "en", "s", None) for k, t in enumerate([x, y, x[: len(x) // 2]])]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(cases.frame(spark, rows), scratch).collect())
    assert [(a, c) for a, _, c in got] == [(0, 0), (1, 0), (2, 2)] and got[0][1] == 399_996


def test_leftovers_of_large_buckets_need_one_common_band(spark, scratch, monkeypatch):
    """Pairs near the threshold that no hub links, all of whose buckets count as large."""
    monkeypatch.setattr(near_dup, "SMALL", 1)
    buckets = near_dup._bucket_pairs
    monkeypatch.setattr(near_dup, "_bucket_pairs", lambda *a: (lambda pairs, large: (pairs.limit(0), large))(*buckets(*a)))
    rng = random.Random(6)
    rows = []
    for k in range(0, 500, 2):
        text, edited = edited_copies(rng)
        rows += [(k, text, "en", "s", None), (k + 1, edited, "en", "s", None)]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(cases.frame(spark, rows), scratch).collect()}
    assert [k for k in got if got[k] != k - k % 2] == []


def test_one_of_each_component_stays(spark, scratch):
    rows = cases.corpus()
    out = near_dup.without_near_duplicates(cases.frame(spark, rows, True), scratch)
    assert out.columns == cases.frame(spark, rows, True).columns
    want = {(r[0], r[1]) for r, c in zip(rows, brute_components(rows), strict=True) if c[2] == r[0]}
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want


def test_empty_tables(spark, scratch):
    empty = cases.frame(spark, [])
    assert near_dup.near_duplicates(empty, scratch).count() == 0
    from sleuth.llm.common import Scratch

    classes, spans = passages.repeats(empty, Scratch(spark))
    assert classes.count() == spans.count() == 0


def test_circulant_coordinates_estimate_jaccard():
    rng = np.random.default_rng(3)
    a = rng.choice(near_dup.CIRCLE, 1000, replace=False)
    b = np.concatenate([a[:800], rng.choice(near_dup.CIRCLE, 200)])
    sig = near_dup.circulant(np.concatenate([a, b]), np.array([0, 1000, 2000]))
    sigma, pi = near_dup.permutations()
    k = 13
    assert sig[0, k] == min(pi[(sigma[x] + k) % near_dup.CIRCLE] for x in a)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.2


def test_label_propagation(spark, scratch):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(60)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long"), scratch, "t").collect()}
    group = {x: {x} for e in edges for x in e}
    for a, b in edges:
        both = group[a] | group[b]
        for x in both:
            group[x] = both
    assert got == {x: min(g) for x, g in group.items()}


# ---- passages ----
def brute_repeats(rows):
    """Word places covered by a 50-word window that an earlier document has."""
    seen, out = {}, {}
    for doc_id, text, *_ in sorted(rows, key=lambda r: r[0]):
        w = cases.lowered(text)
        wins = [tuple(w[i : i + passages.MIN_WORDS]) for i in range(len(w) - passages.MIN_WORDS + 1)]
        out[doc_id] = {p for i, x in enumerate(wins) if seen.get(x, doc_id) != doc_id for p in range(i, i + passages.MIN_WORDS)}
        for x in wins:
            seen.setdefault(x, doc_id)
    return out


def covered(spans):
    return {p for s in spans for p in range(s["begin"], s["end"])}


def test_compact_windows_cover_every_subsequence_once():
    rng = np.random.default_rng(0)
    for n in (0, 3, 5, 40):
        h = rng.permutation(1000)[:n].astype(np.uint32)
        windows = passages.compact_windows(h, 5)
        for i in range(n):
            for j in range(i + 4, n):
                c = i + int(h[i : j + 1].argmin())
                assert sum(w[0] <= i and w[1] == c and j <= w[2] for w in windows) == 1
                assert sum(w[0] <= i <= w[1] <= j <= w[2] for w in windows) == 1


def plain_windows(h, width):
    out, stack = [], [(0, len(h) - 1)] if len(h) >= width else []
    while stack:
        l, r = stack.pop()
        c = l + int(h[l : r + 1].argmin())
        if h[c] == 0xFFFFFFFF:
            continue
        out.append((l, c, r))
        stack += [(a, b) for a, b in ((l, c - 1), (c + 1, r)) if b - a + 1 >= width]
    return out


@pytest.mark.parametrize("kind", ["ties", "random", "up", "down"])
def test_windows_of_several_texts_equal_those_of_each(kind):
    rng = np.random.default_rng(1)
    for _ in range(50):
        offsets = np.append(0, np.cumsum(rng.integers(0, 60, size=rng.integers(1, 6))))
        n, width = int(offsets[-1]), int(rng.integers(1, 12))
        h = {"ties": rng.integers(0, 6, n), "random": rng.integers(0, 2**32, n), "up": np.arange(n), "down": np.arange(n)[::-1]}[kind].astype(np.uint32)
        h[rng.random(n) < 0.2] = 0xFFFFFFFF
        want = {(l + a, c + a, r + a) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for l, c, r in plain_windows(h[a:b], width)}
        got = passages.compact_windows(h, width, offsets).tolist()
        assert len(got) == len(want) and set(map(tuple, got)) == want


@pytest.mark.parametrize("held", [1, 300, 1 << 20])
def test_rows_whose_key_several_classes_have_are_found_in_blocks(monkeypatch, held):
    """Whatever part of the rows is held at once; a frequent key's rows are not held."""
    monkeypatch.setattr(passages, "HELD", held)
    rng, parts = np.random.default_rng(2), 3
    keys, uids = rng.integers(-(2**62), 2**62, 40)[rng.integers(0, 40, 400) % rng.integers(1, 41, 400)], rng.integers(0, 30, 400)
    order = np.argsort(uids, kind="stable")
    c = rng.integers(10, 90, 400)
    rows = np.stack([keys, uids, c, c - rng.integers(0, 9, 400), c + rng.integers(0, 9, 400)])[:, order]
    texts = [rows[:, rows[1] == u] for u in range(30)]
    names = ["key", "uid", "c", "l", "r", "lead", "hull_c", "hull_d", "hull_l", "hull_r"]
    kinds = [pa.int64()] * 2 + [pa.int32()] * 3 + [pa.bool_()] + [pa.int32()] * 4
    dealt = list(passages._dealt(iter(texts), parts))
    words = pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.nulls(1, pa.binary()), pa.array([7]), pa.array([120])], dealt[0].schema.names)
    got = []
    for part in range(parts):
        own = [b.filter(pa.compute.equal(b.column(0), part)).drop_columns(["part"]) for b in [*dealt, words]]
        got += [r for b in passages._several(names, kinds, 5, passages._hulls)(iter(own)) for r in b.to_pylist()]
    assert [(r["uid"], r["c"]) for r in got if r["key"] is None] == [(7, 120)]
    got = [r for r in got if r["key"] is not None]
    classes = {}
    for k, u, *_ in rows.T.tolist():
        classes.setdefault(k, set()).add(u)
    want = [tuple(x) for x in rows.T.tolist() if len(classes[x[0]]) > 1]
    assert sorted(tuple(r[x] for x in names[:5]) for r in got) == sorted(want)
    assert len({(r["key"], r["uid"]) for r in got}) == sum(r["lead"] for r in got)
    for r in got:
        same = [x for x in want if x[:2] == (r["key"], r["uid"])]
        hull = min(x[2] for x in same), max(x[2] for x in same), max(x[2] - x[3] for x in same), max(x[4] - x[2] for x in same)
        assert hull == tuple(r[x] for x in names[6:])


@pytest.mark.parametrize("held", [1, 300, 1 << 20])
def test_first_rows_of_keys_are_told_where_they_meet(monkeypatch, held):
    """So that no second pass over the rows is needed; also of a key's rows that come in
    many blocks, and of a selection that some keys have nothing of."""
    monkeypatch.setattr(passages, "HELD", held)
    rng = np.random.default_rng(5)
    rows = np.stack([rng.integers(0, 12, 300), rng.integers(0, 9, 300), rng.integers(0, 50, 300), rng.integers(0, 3, 300)])
    rows = np.concatenate([rows, [[99], [1], [2], [3]]], axis=1)  # a key of one row
    dealt = [b.drop_columns(["part"]) for b in passages._dealt(iter([rows[:, a : a + 40] for a in range(0, 301, 40)]), 1)]
    found = passages._several([*"kucx", "place"], [pa.int64()] * 4 + [pa.int32()], 4, lambda x: x, [0, 1, 2], lambda x: [x, x[:, x[3] == x[0]]])
    got = [tuple(r.values()) for b in found(iter(dealt)) for r in b.to_pylist()]
    every = [tuple(x) for x in rows.T.tolist() if x[0] != 99]
    assert sorted(r[:4] for r in got if r[4] == 0) == sorted(every)
    for place, some in ((1, every), (2, [r for r in every if r[3] == r[0]])):
        assert sorted(r[:3] for r in got if r[4] == place) == sorted(min(r[:3] for r in some if r[0] == k) for k in {r[0] for r in some})
    assert {r[0] for r in got if r[4] == 1} > {r[0] for r in got if r[4] == 2}


def test_asked_intervals_and_contexts_equal_those_of_each_text(monkeypatch):
    monkeypatch.setattr(passages, "SLICED", 50)
    rng = random.Random(6)
    texts = [cases.prose(rng, "en", n) for n in (80, 3, 120, 60)]
    each = [next(passages.shingle_rows(pa.array([t])))[2] for t in texts]
    asks = [[{"pid": 10 * d + k, "side": k % 2, "begin": rng.randrange(-5, 60), "end": rng.randrange(60, 140)} for k in range(3)] for d in range(4)]
    kind = pa.list_(pa.struct([("pid", pa.int64()), ("side", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(["", *texts]), pa.array([[], *asks], kind)], ["text", "asks"]).slice(1)
    got = [r for b in passages._slices(iter([batch])) for r in b.to_pylist()]
    want = [{**{x: a[x] for x in ("pid", "side")}, "begin": max(a["begin"], 0), "shingles": each[d][max(a["begin"], 0) : a["end"] + 1].astype("<u4").tobytes()} for d in range(4) for a in asks[d]]
    assert got == want
    places = [[{"uid": d, "pid": k, "c": k, "l": 0, "r": 0, "open": True, "first_uid": 0} for k in range(len(each[d]))] for d in range(4)]
    kind = pa.list_(pa.struct([(x, pa.bool_() if x == "open" else pa.int64() if x in ("uid", "pid", "first_uid") else pa.int32()) for x in passages._MEMBER]))
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(places, kind)], ["text", "asks"])
    got = {(r["uid"], r["c"]): r["keys"] for b in passages._contexts([(2, 3), (0, 5)])(iter([batch])) for r in b.to_pylist()}
    seen = {}
    for (d, c), keys in got.items():
        for k, (left, right) in enumerate([(2, 3), (0, 5)]):
            inside = c >= left and c + right < len(each[d])
            assert (keys[k] is not None) == inside
            if inside:
                assert seen.setdefault((k, keys[k]), each[d][c - left : c + right + 1].tobytes()) == each[d][c - left : c + right + 1].tobytes()
    assert len(seen) > 300


def test_texts_are_read_from_buckets_and_the_catalog_forgets_them(spark, scratch):
    docs = cases.frame(spark, cases.corpus())
    dealt = []
    bucketed = scratch.bucketed
    scratch.bucketed = lambda df, name, n, key: dealt.append(bucketed(df, name, n, key)) or dealt[0]
    before = {t.name for t in spark.catalog.listTables()}
    passages.repeats(docs, scratch)
    assert len(dealt) == 1 and {t.name for t in spark.catalog.listTables()} == before


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_passages_equal_brute_force(spark, scratch, seed):
    rows = [r for r in cases.corpus(seed) if r[0] not in (None, 306)]
    docs = cases.frame(spark, rows, seed == 2)
    classes, _ = passages.repeats(docs, scratch)
    got = {r.doc_id: covered(r.spans) for r in passages.marked(docs, classes).collect()}
    want = brute_repeats(rows)
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    for d in want:
        assert want[d] <= got[d]
        if got[d] - want[d]:  # more only where words were changed in a near copy
            assert d >= 100 or any(len(sets[d] & sets[e]) > 40 for e in want if e < d)
    clean = [r[0] for r in rows if r[0] < 60 and r[0] % 7 != 3]
    assert all(not got[d] for d in clean)


def test_near_passages_are_found(spark, scratch):
    rng = random.Random(9)
    base = cases.prose(rng, "en", 90).split(" ")
    rows = [(0, " ".join(base), "en", "s", None)]
    for k in range(1, 12):
        edited = list(base)
        edited[5 * k] = "changed"  # one word in 90
        if k % 2:
            edited.insert(5 * k + 30, "inserted")
        rows.append((k, cases.prose(rng, "de", 30) + " " + " ".join(edited) + " " + cases.prose(rng, "fr", 30), "en", "s", None))
    docs = cases.frame(spark, rows)
    classes, _ = passages.repeats(docs, scratch)
    got = {r.doc_id: covered(r.spans) for r in passages.marked(docs, classes).collect()}
    assert not got[0]
    for k in range(1, 12):
        assert len(got[k] & set(range(30, 120))) >= 75, k
        assert len(got[k] - set(range(26, 126))) == 0


@pytest.mark.parametrize("words", [51, 55, 60])
def test_short_passages_with_an_inserted_or_deleted_word_are_found(spark, scratch, words):
    """At a similarity of 0.83 and more; the word is near the passage's middle."""
    rng = random.Random(words)
    fresh = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k in range(0, 80, 2):
        passage = fresh(words + (k % 4 == 2))
        edited = list(passage)
        at = len(passage) // 2
        if k % 4:
            del edited[at]
        else:
            edited.insert(at, "inserted")
        rows.append((k, " ".join(fresh(150) + passage + fresh(150)), "en", "s", None))
        rows.append((k + 1, " ".join(fresh(120) + edited + fresh(180)), "en", "s", None))
    docs = cases.frame(spark, rows)
    classes, _ = passages.repeats(docs, scratch)
    got = {r.doc_id: covered(r.spans) for r in passages.marked(docs, classes).collect()}
    assert [k for k in range(1, 80, 2) if len(got[k] & set(range(120, 120 + words))) < words - 2] == []
    assert not any(got[k] for k in range(0, 80, 2))


@pytest.mark.parametrize("requests", [1000, 3])
def test_an_earlier_text_with_less_than_a_passage_hides_none(spark, scratch, monkeypatch, requests):
    """Many earlier texts hold the first words of a passage that two later ones share."""
    monkeypatch.setattr(passages, "REQUESTS", requests)
    rng = random.Random(4)
    fresh = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k in range(0, 160, 8):
        passage = fresh(51)
        for e in range(6):
            rows.append((k + e, " ".join(fresh(60) + passage[:49] + fresh(60)), "en", "s", None))
        rows += [(k + 6 + e, " ".join(fresh(80) + passage + fresh(40)), "en", "s", None) for e in range(2)]
    docs = cases.frame(spark, rows)
    classes, _ = passages.repeats(docs, scratch)
    got = {r.doc_id: (covered(r.spans), r.from_id) for r in passages.marked(docs, classes).collect()}
    for k in range(0, 160, 8):
        assert set(range(80, 131)) <= got[k + 7][0] and got[k + 7][1] == k + 6, k
        assert not any(got[k + e][0] for e in range(7))


def test_texts_without_repeats(spark, scratch):
    rows = cases.corpus()
    docs = cases.frame(spark, rows, True)
    classes, _ = passages.repeats(docs, scratch)
    out = passages.without_repeats(docs, classes)
    assert out.columns == docs.columns
    got = {(r.doc_id, r.source): r.text for r in out.where("doc_id is not null").collect()}
    marks = {r.doc_id: r for r in passages.marked(docs, classes).where("doc_id is not null").collect()}
    for doc_id, text, _, source, _ in rows:
        if doc_id is None or doc_id == 306:
            continue
        w = cases.words(text)
        left = [x for p, x in enumerate(w) if p not in covered(marks[doc_id].spans)]
        if left or not w:
            assert cases.words(got[doc_id, source]) == left
        else:
            assert (doc_id, source) not in got
    assert all((200 + k, "s1") not in got for k in range(4))  # copies of an earlier text


def test_op_queries(spark, tmp_path):
    rows = cases.corpus()
    folder = cases.saved(cases.frame(spark, rows), tmp_path)
    six = near_dup.op6_near_dup(spark, folder)
    assert six.columns == ["doc_id", "n_shingles", "component_id", "kept"] and six.count() == len(rows)
    assert six.where(F.col("kept") != (F.col("doc_id") == F.col("component_id"))).count() == 0
    five = passages.op5_passages(spark, folder)
    assert five.count() == len(rows) and five.where("repeated_words > n_words").count() == 0
