from __future__ import annotations

import random
import zlib

import cases
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sleuth.llm import huffman, packing, tokens
from sleuth.llm.common import Scratch


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    t.encode_special_tokens = True
    return lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")


PIECES = [" ", "  ", "\n", "\n\n", " \n", "\t", " ", "　", "a", "Word", "don't", "'s", "12", "é", "<|endoftext|>", "😀", ".", ",", "\r\n", "\x00", "\x85"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join) | st.text(max_size=30).filter(lambda x: not any(0xD800 <= ord(c) < 0xE000 for c in x)))
def test_ids_equal_the_library(plain, text):
    got = tokens.encode_texts(pa.array([text], pa.large_string()), tokens.default_tokenizer())[0]
    assert np.array_equal(np.frombuffer(got, "<u4"), plain(text))


def test_memo_generations(plain, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 8)
    encoder = tokens.Encoder(tokens.default_tokenizer())
    rng = random.Random(3)
    for _ in range(30):
        text = cases.prose(rng, "fr", 30)
        assert np.array_equal(np.frombuffer(encoder.encode(text), "<u4"), plain(text)[:-1])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*PIECES, " word", " word.", ", ", "Word,\n", "1.", "ö.", "×,", "÷!", "Ā.", "o\u0301.", "'ll", "a'"]), max_size=8).map("".join) | st.none(), max_size=6), st.integers(0, 2))
def test_ids_of_neighbouring_texts_equal_the_library(plain, texts, skipped):
    array = pa.array([*[" before."] * skipped, *texts], pa.string()).slice(skipped)
    got = tokens.encode_texts(array, tokens.default_tokenizer())
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain(x).tolist() for x in texts]


def test_a_piece_is_looked_up_once_however_often_it_stands(plain, monkeypatch):
    encoder, seen = tokens.Encoder(tokens.default_tokenizer()), []
    look_up = tokens.Encoder._found
    monkeypatch.setattr(tokens.Encoder, "_found", lambda own, parts: seen.append(len(parts)) or look_up(own, parts))
    texts = ["some words, some other words.\nwords and words."] * 500
    got = encoder.encode_all(pa.array(texts, pa.large_string()))
    assert all(np.array_equal(np.frombuffer(x, "<u4"), plain(texts[0])[:-1]) for x in got)
    assert sum(seen) == 9  # some, " words", ",", " some", " other", ".", a line break, words, " and"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 10_000), min_size=1, max_size=200), st.integers(8, 18))
def test_code_is_complete_and_limited(counts, limit):
    bits = huffman.code_lengths(np.array(counts), limit)
    assert bits.max() <= limit and bits.min() >= 1
    if len(counts) > 1:
        assert sum(2.0 ** -int(b) for b in bits) == 1.0


def test_unlimited_code_is_huffman():
    import heapq

    rng = random.Random(5)
    counts = [rng.randint(1, 1000) for _ in range(100)]
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert int((huffman.code_lengths(np.array(counts), 18) * np.array(counts)).sum()) == cost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), min_size=1, max_size=150), min_size=1, max_size=8))
def test_block_round_trip(docs):
    held = [np.array(d, np.int64) for d in docs]
    every = np.concatenate(held)
    ids, counts = np.unique(every, return_counts=True)
    bits = huffman.code_lengths(counts)
    block = huffman.encode_block(every, np.array([len(d) for d in docs]), *huffman.canonical(ids, bits))
    got, sizes = huffman.decode_block(block, huffman.decode_table(ids, bits))
    assert np.array_equal(got, every) and sizes.tolist() == [len(d) for d in docs]
    with pytest.raises(ValueError):
        huffman.decode_block(block[:20] + bytes([block[20] ^ 1]) + block[21:], huffman.decode_table(ids, bits))


def expected(rows, plain):
    """Documents in file order: by id (null first), then text."""
    return {(r[0], r[1]): plain(r[1]) for r in rows}


@pytest.mark.parametrize("clashes", [False, True])
def test_files_round_trip(spark, scratch, plain, clashes):
    rows = cases.corpus()
    huffman.write_ids(cases.frame(spark, rows, clashes), scratch.path("files"), scratch)
    got = sorted(huffman.read_ids(spark, scratch.path("files")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert r.start == at and r.n_tokens == len(ids)
        assert any(np.array_equal(ids, plain(x[1])) for x in rows if x[0] == r.doc_id)
        at += len(ids)


def test_files_of_an_empty_table(spark, scratch):
    huffman.write_ids(cases.frame(spark, []), scratch.path("files"), scratch)
    assert huffman.read_ids(spark, scratch.path("files")).count() == 0


def test_op2_query(spark, tmp_path, plain):
    rows = [r for r in cases.corpus() if r[0] not in (None, 306)]
    got = huffman.op2_token_files(spark, cases.saved(cases.frame(spark, rows), tmp_path)).collect()
    want, at = [], 0
    for r in sorted(rows):
        ids = plain(r[1])
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got)) == want


def check_packing(pieces, rows, plain, window):
    whole = {}
    for r in rows:
        whole.setdefault(r[0], []).append(plain(r[1]).tobytes())
    seen, sequences = {}, {}
    for p in pieces:
        assert p["length"] > 0 and len(p["ids"]) == 4 * p["length"]
        seen.setdefault(p["doc_id"], []).append((p["start"], p["ids"], p["doc_tokens"]))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert set(seen) == set(whole)
    for doc_id, texts in whole.items():
        if len(texts) == 1:
            assert b"".join(x for _, x, _ in sorted(seen[doc_id])) == texts[0]
            assert all(n == len(texts[0]) // 4 for _, _, n in seen[doc_id])
        else:  # rows of one id: together they have their ids
            assert sum(len(x) for _, x, _ in seen[doc_id]) == sum(map(len, texts))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return sequences


@pytest.mark.parametrize("clashes", [False, True])
def test_packing_covers_each_id_once(spark, plain, clashes, tmp_path):
    rows = cases.corpus()
    docs = spark.read.parquet(f"{cases.saved(cases.frame(spark, rows, clashes), tmp_path)}/documents.parquet")
    got = [r.asDict() for r in packing.packed(docs).collect()]
    sequences = check_packing(got, rows, plain, packing.WINDOW)
    total = sum(p["length"] for p in got)
    assert len(sequences) == -(-total // packing.WINDOW)  # one shard: only the last window is open


def test_packing_shards_and_windows(spark, plain):
    rows = cases.corpus(4)
    a = [r.asDict() for r in packing.packed(cases.frame(spark, rows), window=128).collect()]  # of unknown size: several shards
    assert len({r["sequence_id"] >> 32 for r in a}) > 3
    check_packing(a, rows, plain, 128)
    b = [r.asDict() for r in packing.packed(cases.frame(spark, list(reversed(rows))), window=128).collect()]
    key = lambda p: (p["doc_id"] is None, p["doc_id"] or 0, p["start"], p["sequence_id"], p["offset"])
    assert sorted(a, key=key) == sorted(b, key=key)  # whatever the order of the input


def test_packing_of_an_empty_table(spark):
    assert packing.packed(cases.frame(spark, [])).count() == 0


def test_neighbours_share_windows():
    """Documents of one topic are packed together."""
    rng = np.random.default_rng(0)
    docs = []
    for k in range(40):
        topic = 1000 * (k % 4)
        docs.append(np.concatenate([rng.integers(topic, topic + 60, 40), rng.integers(5000, 9000, 10), [0]]))
    pieces = packing.pack(docs, 255)
    windows = {}
    for k, _, n, sequence, _ in pieces:
        windows.setdefault(sequence, []).append((k % 4, n))
    alike = sum(max(sum(n for t, n in w if t == topic) for topic in range(4)) for w in windows.values())
    assert alike > 0.85 * sum(n for w in windows.values() for _, n in w)


def test_bm25_order_equals_brute_force(monkeypatch):
    monkeypatch.setattr(packing, "TERMS", 100)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 80, rng.integers(5, 60)) for _ in range(30)]
    index = packing.Index(docs)
    n, mean = len(docs), np.mean([len(d) for d in docs])
    df = {t: sum(t in d for d in docs) for t in range(80)}

    def weight(t, d):
        tf = int((docs[d] == t).sum())
        idf = np.log1p((n - df[t] + 0.5) / (df[t] + 0.5))
        return idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(docs[d]) / mean))

    for seed in range(5):
        terms = [t for t in set(docs[seed].tolist()) if df[t] > 1]
        used = np.zeros(n, bool)
        used[seed] = True
        score = {d: sum(weight(t, d) for t in terms) for d in range(n) if d != seed and set(terms) & set(docs[d].tolist())}
        got = index.neighbours(seed, used).tolist()
        assert set(got) == set(score)
        assert all(score[a] >= score[b] - 1e-4 for a, b in zip(got, got[1:], strict=False))


def plain_windows(docs, window):
    """The packing by its definition: neighbours sorted, asked one after the other."""
    left, begin, out, sequence = [len(d) for d in docs], [0] * len(docs), [], 0
    for k, d in enumerate(docs):
        while left[k] >= window:
            out.append((k, begin[k], window, sequence, 0))
            begin[k], left[k], sequence = begin[k] + window, left[k] - window, sequence + 1
    index = packing.Index(docs)
    for seed in range(len(docs)):
        while left[seed]:
            room = window

            def put(k):
                nonlocal room
                n = min(left[k], room)
                out.append((k, begin[k], n, sequence, window - room))
                begin[k], left[k], room = begin[k] + n, left[k] - n, room - n

            put(seed)
            long = None
            for k in index.neighbours(seed, np.array(left) == 0).tolist() if room else []:
                if left[k] <= room:
                    put(k)
                elif long is None:
                    long = k
            for k in ([] if long is None else [long]) + list(range(seed, len(docs))):
                if room and left[k]:
                    put(k)
            sequence += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_windows_equal_the_plain_definition(seed):
    rng = np.random.default_rng(seed)
    docs = [np.append(rng.integers(1, 30 + 400 * (seed % 2), rng.integers(1, 150 if seed < 4 else 60)), 0) for _ in range(150)]
    assert [tuple(map(int, x)) for x in packing.pack(docs, 100)] == plain_windows(docs, 100)


def test_a_fitting_neighbour_behind_many_that_are_too_long_is_taken():
    """A seed of 500 ids, 70 nearer documents of 800 and one of 300 that fits."""
    telling = np.arange(1, 13)
    fill = iter(range(1000, 200000))
    some = lambda n: np.array([next(fill) for _ in range(n)])
    docs = [np.concatenate([telling, some(488)])]
    docs += [np.concatenate([telling, some(788)]) for _ in range(70)]
    docs += [np.concatenate([telling[:1], some(299)])]
    first = [(k, n) for k, _, n, sequence, _ in packing.pack(docs, 1024) if sequence == 0]
    assert first[:2] == [(0, 500), (71, 300)]
    assert sum(n for _, n in first) == 1024
