import hashlib
import json

from pyspark.sql import functions as F

from sleuth.functions.columns import ZERO_HASH
from sleuth.operators import evidence as E

T0 = "2025-01-01T00:00:00+00:00"


def _chain(spark, items):
    df = spark.createDataFrame(items, "case string, pos long, eid string, data string, who string")
    return E.build_chain(df, "case", "pos", F.col("eid"), E.sha256_hex(F.col("data")), F.col("who"), F.lit(T0))


def _python_entry(eid, h, parent, who):
    body = {"evidence_id": eid, "hash": h, "parent_hash": parent, "collector": who, "timestamp": T0, "action": "collected", "metadata": {}}
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()


def test_chain_matches_python_digest(spark):
    ch = _chain(spark, [("c1", 0, "e1", "alpha", "ops"), ("c1", 1, "e2", "beta", "ops"), ("c2", 0, "x", "gamma", "bot")]).orderBy("chain_id", "seq").collect()
    h1 = hashlib.sha256(b"alpha").hexdigest()
    e1 = _python_entry("e1", h1, ZERO_HASH, "ops")
    assert ch[0]["entry_hash"] == e1 and ch[0]["parent_hash"] == ZERO_HASH
    assert ch[1]["parent_hash"] == e1 and ch[1]["entry_hash"] == _python_entry("e2", hashlib.sha256(b"beta").hexdigest(), e1, "ops")
    assert ch[2]["parent_hash"] == ZERO_HASH  # chains are independent


def test_verify_valid_and_tampered(spark):
    ch = _chain(spark, [("c", i, f"e{i}", f"d{i}", "ops") for i in range(4)])
    v = E.verify_chain(ch).collect()[0]
    assert v["valid"] and v["entries"] == 4 and v["error_count"] == 0
    bad_hash = ch.withColumn("entry_hash", F.when(F.col("seq") == 1, F.lit("f" * 64)).otherwise(F.col("entry_hash")))
    msgs = sorted((r["kind"], r["message"]) for r in E.chain_errors(bad_hash).collect())
    assert msgs == [(0, "Entry 1: hash mismatch (tamper detected)"), (1, "Entry 2: parent_hash chain broken")]
    bad_parent = ch.withColumn("parent_hash", F.when(F.col("seq") == 2, F.lit("0" * 64)).otherwise(F.col("parent_hash")))
    kinds = sorted(r["kind"] for r in E.chain_errors(bad_parent).collect())
    assert kinds == [0, 1]  # its own hash no longer matches and the link is broken
    bad_first = ch.withColumn("parent_hash", F.when(F.col("seq") == 0, F.lit("1" * 64)).otherwise(F.col("parent_hash")))
    msgs = {r["message"] for r in E.chain_errors(bad_first).collect()}
    assert "Entry 0: first entry parent_hash must be zero-hash" in msgs
    assert not E.verify_chain(bad_first).collect()[0]["valid"]


def test_hash_evidence_non_ascii(spark):
    df = spark.createDataFrame([("héllo wörld",)], "t string")
    assert E.hash_evidence(df, "t").collect()[0]["hash"] == hashlib.sha256("héllo wörld".encode()).hexdigest()


ODD = ['quo"te', "back\\slash", "line\nbreak\ttab", "sep\u2028\u2029\u0085", "é ñ 漢 😀", "\x00\x1f\x7f", "", None, "{}", "$1 \\u0041"]


def test_odd_texts_match_python_digests(spark):
    items = [("c", i, x, f"d{i}", ODD[-1 - i]) for i, x in enumerate(ODD)]
    got = _chain(spark, items).orderBy("seq").collect()
    parent = ZERO_HASH
    for (_, _, eid, data, who), r in zip(items, got, strict=True):
        parent = _python_entry(eid, hashlib.sha256(data.encode()).hexdigest(), parent, who)
        assert r["entry_hash"] == parent


def test_every_altered_field_is_reported(spark):
    items = [("c", i, x, f"d{i}", x) for i, x in enumerate(ODD)]
    ch = _chain(spark, items)
    assert E.verify_chain(ch).collect()[0]["valid"]
    for field in ("evidence_id", "hash", "collector", "timestamp", "action", "metadata_json", "parent_hash"):
        for seq in (3, 7):  # a line separator, a NULL
            value = F.when(F.col("seq") == seq, F.concat(F.lit("\u2028x"), F.coalesce(field, F.lit("")))).otherwise(F.col(field))
            errors = E.chain_errors(ch.withColumn(field, value)).collect()
            assert (seq, 0) in {(r["pos"], r["kind"]) for r in errors}, (field, seq)


def test_metadata_with_nulls_and_odd_texts(spark):
    df = spark.createDataFrame([({"b": 'x"\u2028', "a": None, "é": "1"},)], "m map<string,string>")
    assert df.select(E.metadata_json(F.col("m")).alias("j")).first()["j"] == json.dumps({"a": None, "b": 'x"\u2028', "é": "1"})


def _append(spark, path, rows, **more):
    df = spark.createDataFrame(rows, "case string, pos long, eid string, who string")
    return E.append_chain(df, path, "case", "pos", F.col("eid"), E.sha256_hex(F.col("eid")), F.col("who"), F.lit(T0), **more)


def test_appends_continue_stored_chains_and_forks_are_refused(spark, tmp_path):
    import pytest

    path = str(tmp_path / "chains")
    rows = [(c, i, f"{c}{i}", "ops") for c in ("a", "b", "c") for i in range(9)]
    assert E.read_chain(spark, path).isEmpty()
    assert _append(spark, path, [r for r in rows if r[1] < 3 and r[0] != "c"]) == 1
    assert _append(spark, path, [r for r in rows if 3 <= r[1] < 7 and r[0] == "a"], expected=1) == 2
    with pytest.raises(E.ForkError):  # made on a state that is not the last one any more
        _append(spark, path, [("b", 3, "x", "ops")], expected=1)
    with pytest.raises(E.ForkError):  # stands before its chain's last entry
        _append(spark, path, [("a", 6, "x", "ops")])
    rest = [r for r in rows if not (r[1] < 3 and r[0] != "c") and not (3 <= r[1] < 7 and r[0] == "a")]
    assert _append(spark, path, rest, expected=2) == 3
    stored = E.read_chain(spark, path)
    df = spark.createDataFrame(rows, "case string, pos long, eid string, who string")
    whole = E.build_chain(df, "case", "pos", F.col("eid"), E.sha256_hex(F.col("eid")), F.col("who"), F.lit(T0))
    order = ("chain_id", "seq")
    assert stored.orderBy(*order).collect() == whole.orderBy(*order).collect()
    assert all(r["valid"] for r in E.verify_chain(stored).collect())
    assert {(r.chain_id, r.seq) for r in E.chain_tails(spark, path).collect()} == {(c, 8) for c in "abc"}


def test_two_appends_at_once_leave_one(spark, tmp_path, monkeypatch):
    import pytest

    path = str(tmp_path / "chains")
    _append(spark, path, [("a", 0, "x", "ops")])
    seen = E._commits(spark, path)
    monkeypatch.setattr(E, "_commits", lambda s, p: seen)  # both begin with the same state
    _append(spark, path, [("a", 1, "y", "ops")])
    with pytest.raises(E.ForkError):
        _append(spark, path, [("a", 1, "z", "ops")])
    monkeypatch.undo()
    assert [r["evidence_id"] for r in E.read_chain(spark, path).orderBy("seq").collect()] == ["x", "y"]
    assert len(list((tmp_path / "chains" / "entries").iterdir())) == 2  # the refused one is gone


def test_nested_metadata_matches_python(spark):
    import random

    rng = random.Random(6)

    def value(depth):
        kind = rng.randrange(9 if depth else 6)
        if kind < 6:
            return rng.choice([None, True, False, 0, -7, 10**25, 1.0, 1e-7, 1.5e300, 123456789.125, "", 'q"\\\n é😀', "1.0"])
        if kind < 8:
            return {rng.choice("abcéZ") + str(i): value(depth - 1) for i in range(rng.randrange(5))}
        return [value(depth - 1) for _ in range(rng.randrange(4))]

    docs = [value(4) for _ in range(300)] + [{}, None]
    rows = [(i, json.dumps(d) if i % 2 else json.dumps(d, ensure_ascii=False, indent=1)) for i, d in enumerate(docs)] + [(900, None), (901, "no json")]
    df = spark.createDataFrame(rows, "i long, m string")
    got = {r.i: r.j for r in df.select("i", E.metadata_text(df, F.col("m")).alias("j")).collect()}
    assert all(got[i] == json.dumps(d or {}, sort_keys=True) for i, d in enumerate(docs))
    assert got[900] == "{}" and got[901] == '"no json"'
    variants = df.where("i < 300").select(F.parse_json("m").alias("v"), "i").where("variant_get(v, '$') is not null")
    some = variants.select("i", E.metadata_text(variants, F.col("v")).alias("j")).collect()
    assert all(json.loads(r.j) == (docs[r.i] or {}) for r in some)
