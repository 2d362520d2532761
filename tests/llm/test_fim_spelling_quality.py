from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import cases
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sleuth.llm import fill_in_middle as fim
from sleuth.llm import quality, spelling


def sql_rows(sql: str, folder: str) -> list[tuple]:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    out = con.execute(sql)
    order = sorted(range(len(out.description)), key=lambda i: out.description[i][0])
    return sorted((tuple(r[i] for i in order) for r in out.fetchall()), key=repr)


def spark_rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


# ---- 11: fill in the middle ----
@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_the_code_points(seed):
    rng = random.Random(seed)
    alphabet = ["a", "aé", "日本a", "a😀", "é", "aaaaaaaaaaaaaaaaaaaaé"][seed]
    text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 70_000, 200_000])))
    raw = text.encode()
    bounds = fim.BoundarySet(np.frombuffer(raw, np.uint8))
    want = [0]
    for c in text:
        want.append(want[-1] + len(c.encode()))
    assert bounds.units == len(text)
    asked = range(len(text) + 1) if len(text) < 1000 else sorted(rng.sample(range(len(text) + 1), 500)) + [0, len(text)]
    assert all(bounds.select(k) == want[k] for k in asked)


def test_each_container_is_the_smallest_and_selects():
    sets = {
        fim.RunContainer: np.arange(10, 60_000),
        fim.ArrayContainer: np.arange(0, 65_536, 40),
        fim.BitmapContainer: np.flatnonzero(np.random.default_rng(1).random(65_536) < 0.5),
    }
    for kind, values in sets.items():
        c = fim.container(values)
        assert type(c) is kind
        assert all(c.select(k) == values[k] for k in range(0, len(values), 97))
        assert c.select(len(values) - 1) == values[-1]


def test_a_boundary_at_a_container_border():
    for size in (65_535, 65_536, 65_537, 131_072):
        for text in ("a" * size, "é" * (size // 2), "a" + "é" * (size // 2)):
            raw = text.encode()
            bounds = fim.BoundarySet(np.frombuffer(raw, np.uint8))
            assert bounds.units == len(text) and bounds.select(len(text)) == len(raw)
            k = len(text) - 1
            assert bounds.select(k) == len(raw) - len(text[-1].encode())


def fim_rows():
    rng = random.Random(5)
    rows = cases.corpus()
    rows += [(500 + i, "".join(rng.choice("aé日😀\n ") for _ in range(rng.randint(0, 30))), None, None, None) for i in range(200)]
    rows += [(800, "with <P> in it", "en", "s", None), (801, "a<S>", "en", "s", None), (802, "<M>", "en", "s", None), (803, "< P> <P <", "en", "s", None)]
    rows += [(900 + i, "<" * i + "S<P", "en", "s", None) for i in range(12)]  # looks like a sentinel that has begun
    rows.append((1000, "é日a" * 900_000, "en", "s", None))  # 5 MB
    return rows


def test_fim_equals_plain_python_and_sql(spark, tmp_path):
    rows = fim_rows()
    folder = cases.saved(cases.frame(spark, rows), tmp_path)
    got = fim.op11_fill_in_middle(spark, folder)
    want = []
    for doc_id, text, *_ in rows:
        text = text or ""
        n = len(text)
        x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
        i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = text[:i], text[i:j], text[j:]
        if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            form, out, i, j = "plain", text, None, None
        elif h[3] % 100 < 20:
            form, out = "spm", f"<S>{s}<P>{p}<M>{m}"
        else:
            form, out = "psm", f"<P>{p}<S>{s}<M>{m}"
        sha = [hashlib.sha256(v.encode()).hexdigest() for v in (out, text)]
        want.append((doc_id, form, None if i is None else j - i, n, sha[0], i, sha[1]))
    assert spark_rows(got) == sorted(want, key=repr)
    assert spark_rows(got) == sql_rows(fim.OP11_SQL, folder)
    assert {w[1] for w in want} == {"plain", "psm", "spm"}


def test_fim_offsets_and_own_parameters(spark):
    docs = cases.frame(spark, fim_rows(), clashes=True)
    out = fim.fill_in_middle(docs, seed=7, fim_percent=100, spm_percent=50).select("*", fim.restored(F.col("form"), F.col("output")).alias("back"))
    text = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    forms = Counter()
    for r in out.collect():
        t = text[r.doc_id]
        assert r.back == t and r.n == len(t)
        forms[r.form] += 1
        if r.form != "plain":
            assert len(t.encode()[: r.prefix_bytes].decode()) == r.prefix_chars
            assert len(t.encode()[r.prefix_bytes : r.prefix_bytes + r.middle_bytes].decode()) == r.middle_chars
    assert min(forms["psm"], forms["spm"]) > 80


def test_fim_of_an_empty_table(spark, tmp_path):
    assert fim.op11_fill_in_middle(spark, cases.saved(cases.frame(spark, []), tmp_path)).count() == 0


# ---- 12: spelling variants ----
def edits(word: str, other: str) -> bool:
    """One code point inserted, deleted or replaced."""
    if len(word) > len(other):
        word, other = other, word
    if len(other) - len(word) > 1 or word == other:
        return False
    k = next((i for i, (x, y) in enumerate(zip(word, other, strict=False)) if x != y), len(word))
    return word[k + (len(word) == len(other)) :] == other[k + 1 :]


def plain_variants(counts: dict[str, int], ratio: int = 5) -> list[tuple]:
    near = {w: [v for v in counts if edits(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((form[w], counts.get(form[w]), counts[w], len(near[w]), root, w))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "group"), [(1, 2048), (2, 4), (3, 2), (4, 40)])
def test_near_words_equal_brute_force(spark, scratch, seed, group):
    """Few letters, so that most words have near ones; small groups, so that windows are halved often."""
    rng = random.Random(seed)
    counts = {}
    for _ in range(700):
        w = "".join(rng.choice("abé" if seed % 2 else "ab") for _ in range(rng.randint(1, 9)))
        counts[w] = rng.choice([1, 1, 2, 5, 5, 25, 26, 125, 700])
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert spark_rows(spelling.variants(words, scratch, group=group)) == plain_variants(counts)


def test_a_hot_group_is_halved_to_the_end(spark, scratch):
    """All words share all but one place: no half makes the group smaller until the window is one place."""
    letters = [chr(c) for c in range(0xE0, 0xE0 + 30)]
    counts = {f"aaaaaa{x}bbbbbb": 10 + i for i, x in enumerate(letters)} | {f"aaaaaa{x}{y}bbbbbb": 3 for x in letters[:12] for y in letters[:12]}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    groups = spelling.grouped(words, scratch, group=8).groupBy("l", "a", "b", "head", "tail").count()
    assert groups.where("count > 8 and b - a > 1").isEmpty()
    assert spark_rows(spelling.variants(words, scratch_(spark), group=8)) == plain_variants(counts)


def test_long_words_go_through_the_index_in_stripes(spark, scratch):
    rng = random.Random(2)
    base = "".join(rng.choice("abc") for _ in range(30_000))
    counts = {base: 100, base[:-1]: 5, base + "a": 20, base[:14_000] + "é" + base[14_001:]: 1, base[:9] + base[10:]: 2, "x" + base: 3, base[::-1]: 7}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert spark_rows(spelling.variants(words, scratch)) == plain_variants(counts)


def test_roots_follow_chains(spark, scratch):
    links = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("a", "w3"), ("b", "a")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(links, "word string, form string"), scratch).collect()}
    assert got == {w: "w13" for w, _ in links}


def spelling_rows():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdeéÀ×") for _ in range(rng.randint(4, 8))) for _ in range(60)]
    vocabulary += [v[:3] + rng.choice("xyz") + v[4:] for v in vocabulary[:40]]
    rows = []
    for i in range(250):
        ws = [rng.choice(vocabulary[:50] if rng.random() < 0.8 else vocabulary) for _ in range(rng.randint(0, 60))]
        rows.append((i, "".join((w.upper() if rng.random() < 0.2 else w) + rng.choice([" ", ", ", "1", "\n", "ō"]) for w in ws), "en", "s", None))
    rows += [(300, None, None, None, None), (301, "", "en", "s", None), (None, " ".join(vocabulary * 3), "en", "s", None)]
    rows += [(302, "again " * 40 + "agains " * 7 + "Again " * 3, "en", "s", None)] * 2
    rows.append((303, " ".join(rng.choice(vocabulary) for _ in range(300_000)), "en", "s", None))
    return rows


def test_spelling_equals_plain_python_and_sql(spark, tmp_path):
    rows = spelling_rows()
    folder = cases.saved(cases.frame(spark, rows), tmp_path)
    count: Counter = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    counts = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    got = spark_rows(spelling.op12_spelling(spark, folder))
    assert got == plain_variants(counts)
    assert got == sql_rows(spelling.OP12_SQL, folder)
    assert sum(r[0] is not None for r in got) > 5  # forms


def test_spelling_with_clashing_columns_and_of_an_empty_table(spark, tmp_path, scratch):
    docs = cases.frame(spark, spelling_rows()[:60], clashes=True).withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    assert spelling.word_counts(docs, min_count=1).count() > 20
    assert spelling.op12_spelling(spark, cases.saved(cases.frame(spark, []), tmp_path)).count() == 0


# ---- 13: quality ----
def graded(n: int = 900, seed: int = 4):
    """Prose, and prose spoiled in one of several ways; labels of two thirds."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = list(cases.SYLLABLES)[i % 4]
        text = cases.prose(rng, lang, rng.randint(15, 120))
        bad = rng.random() < 0.3
        if bad:
            ws = text.split(" ")
            kind = rng.randrange(4)
            if kind == 0:
                text = " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in ws)
            elif kind == 1:
                text = " ".join(w.upper() + "!!" for w in ws)
            elif kind == 2:
                text = " | ".join(ws)
            else:
                text = " ".join([ws[0]] * 12 + ws[: len(ws) // 2] + [ws[1]] * 12)
        rows.append((i, text, lang, "s", len(text)))
        if rng.random() < 0.7:
            labels.append((i, int(not bad), 0))
    return rows, labels


def fold(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_on_the_held_out_fold(spark, tmp_path):
    rows, labels = graded()
    extra = [(2000, None, None, None, None), (2001, "", "en", "s", 0), (2002, " \n", "en", "s", 2), (None, "the thing and", "en", "s", None)]
    extra += [(2003, cases.prose(random.Random(1), "en", 250_000), "en", "s", None)] * 2  # 2 MB
    folder = cases.saved(cases.frame(spark, rows + extra), tmp_path, labelled(spark, labels))
    got = quality.op13_quality(spark, folder).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: q for i, q, _ in labels}
    assert all(r.held_out == (r.doc_id is None or fold(r.doc_id) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    out = [(r.predicted, truth[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in truth]
    assert len(out) > 80
    assert np.mean([p == t for p, t, _ in out]) >= 0.95
    assert np.mean([p for p, t, _ in out if t]) >= 0.97


def test_quality_ignores_labels_of_the_held_out_fold(spark, scratch):
    rows, labels = graded(300)
    wrong = [(i, 1 - q if fold(i) == 0 else q, t) for i, q, t in labels]
    stats = scratch.write(quality.measured(cases.frame(spark, rows, True)), "stats")
    a, b = (quality.train(stats, labelled(spark, x), scratch_(spark), features=64) for x in (labels, wrong))
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


def scratch_(spark):
    from sleuth.llm.common import Scratch

    return Scratch(spark)


def test_statistics_of_a_text_do_not_depend_on_its_batch():
    from sleuth.llm.words import as_strings

    rows, _ = graded(60)
    texts = [r[1] for r in rows] + ["", " ", "a", "é!!", "\n\n", "x\nx\nx\nx y", "日本 日本", "#" * 50]
    whole = quality.statistics(as_strings(pa.array(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(quality.statistics(as_strings(pa.array([t])))[0], whole[i])
    named = dict(zip(quality.STATISTICS, quality.statistics(as_strings(pa.array(["Aa BB!! BB!! c1\nBB!! BB!!\n\nBB!! BB!!"])))[0], strict=True))
    want = {
        "words": np.log1p(8),
        "lines": np.log1p(3),
        "word_length": (2 + 4 * 6 + 2) / 8,
        "capitals": np.sqrt(13 / 15),
        "capital_words": np.sqrt(6 / 8),
        "digits": np.sqrt(1 / 28),
        "marks": np.sqrt(12 / 28),
        "doubled": np.sqrt(6 / 8),
        "repeats": np.sqrt(4 / 8),
        "repeat_run": np.log1p(4),
        "distinct": 3 / 8,
        "commonest": np.sqrt(6 / 8),
        "same_lines": np.sqrt(1 / 3),
        "capital_count": np.log1p(6),
    }
    assert {k: round(named[k], 9) for k in want} == {k: round(v, 9) for k, v in want.items()}


def test_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(3)
    s = rng.normal(size=(40, 24))
    z = quality.fourier(s, np.zeros(24), np.ones(24), quality.projection(24, 20_000))[:, :-1]
    distance = ((s[:, None] - s[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-distance / (2 * quality.WIDTH**2))).max() < 0.05


@pytest.mark.parametrize("parts", [1, 7])
def test_partition_sums_are_the_normal_equations(spark, scratch, parts):
    rng = np.random.default_rng(8)
    s, y = rng.normal(size=(300, 24)), rng.integers(0, 2, 300)
    rows = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(s, y, strict=True)], "s array<double>, y int").repartition(parts)
    got = quality.normal_equations(rows, np.zeros(24), np.ones(24), scratch, features=32)
    z = quality.fourier(s, np.zeros(24), np.ones(24), quality.projection(24, 32))
    assert np.allclose(got, np.concatenate([z.T @ z, (z.T @ y)[:, None]], axis=1))


def test_pools_are_the_isotonic_regression():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = int(rng.integers(1, 25))
        rows = rng.integers(1, 6, n)
        good = np.array([rng.integers(0, r + 1) for r in rows])
        at, share = quality.pooled(np.arange(n, dtype=float), good, rows)
        assert (np.diff(share) > 0).all() and (np.diff(at) > 0).all()
        # max over i of min over j of the mean of i..j, for each place
        want = [max(min(good[i : j + 1].sum() / rows[i : j + 1].sum() for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        assert np.allclose(sorted(set(np.round(want, 12))), np.round(share, 12))


@pytest.mark.parametrize(("kinds", "score"), [([], 0.5), ([1], 1.0), ([0], 0.0)])
def test_quality_with_little_to_learn(spark, tmp_path, kinds, score):
    rows, _ = graded(40)
    labels = [(i, q, 0) for q in kinds for i in range(30)] + [(None, 1, 0), (31, None, 0)]
    got = quality.op13_quality(spark, cases.saved(cases.frame(spark, rows), tmp_path, labelled(spark, labels))).collect()
    assert len(got) == 40 and {r.score for r in got} == {score}


def test_quality_of_an_empty_table(spark, tmp_path):
    folder = cases.saved(cases.frame(spark, []), tmp_path, labelled(spark, []))
    assert quality.op13_quality(spark, folder).count() == 0
