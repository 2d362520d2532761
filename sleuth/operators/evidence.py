"""Evidence hashing and SHA-256 custody chains, scoped per ``chain_id``.

Entry hash = SHA-256 of the canonical entry text: keys sorted (action,
collector, evidence_id, hash, metadata, parent_hash, timestamp), separators
", " and ": ". ``parent_hash`` of an entry is the previous entry's hash in
its chain (64 zeros for the first).

Building a chain is sequential by definition *inside* one chain, parallel
across chains: rows are hash-partitioned by chain and sorted by position,
and ``mapInPandas`` streams the sorted partition in Arrow batches, carrying
only the last hash (no chain is ever collected into memory). The canonical
text around the parent hash is built in the JVM; Python only concatenates
and hashes. Verification is fully parallel (recompute per row, compare with
the previous row through the halo window).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sleuth.functions.columns import ZERO_HASH, json_quote, sha256_hex
from sleuth.plans.ordering import SEQ, drop_layout, num_partitions, halo_window, has_lag_in_key, lag_in_key, running_max, sequence

ACTION = "collected"  # fixed value: the only custody action


def hash_evidence(df: DataFrame, data_col: str, out: str = "hash") -> DataFrame:
    """Hex SHA-256 of each item (text is hashed as UTF-8 bytes)."""
    return df.withColumn(out, sha256_hex(F.col(data_col)))


def metadata_json(m: Column | None) -> Column:
    """map<string,string> -> JSON object text with sorted keys, Python separators."""
    if m is None:
        return F.lit("{}")
    entries = F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))))
    body = F.array_join(
        F.transform(entries, lambda e: F.concat(json_quote(e["key"]), F.lit(": "), json_quote(e["value"]))), ", "
    )
    return F.concat(F.lit("{"), body, F.lit("}"))


def canonical_json(text: Column) -> Column:
    """JSON text of any depth -> the text with sorted keys on every level, Python's
    separators and number texts, in ASCII. What Python counts as false (null, empty,
    0) is ``{}``; a text that is no JSON counts as a string."""

    @F.pandas_udf(T.StringType())
    def canonical(texts: pd.Series) -> pd.Series:
        def one(value: str | None) -> str:
            try:
                return json.dumps((json.loads(value) if value else None) or {}, sort_keys=True)
            except ValueError:
                return json.dumps(value)

        return texts.map(one, na_action=None)

    return canonical(text)


def metadata_text(df: DataFrame, metadata: Column | None) -> Column:
    """Canonical text of a metadata column of any type: a map of texts in the JVM;
    JSON texts, variants, structs, arrays and other maps with all their levels."""
    if metadata is None:
        return metadata_json(None)
    kind = df.select(metadata.alias("m")).schema["m"].dataType
    if kind == T.MapType(T.StringType(), T.StringType()) or kind == T.MapType(T.StringType(), T.StringType(), False):
        return metadata_json(metadata)
    text = metadata if isinstance(kind, T.StringType) else F.to_json(metadata, {"ignoreNullFields": "false"})
    return canonical_json(text)


def _parts(evidence_id: Column, data_hash: Column, collector: Column, ts: Column, meta: Column, action: Column) -> tuple[Column, Column]:
    pre = F.concat(
        F.lit('{"action": '),
        json_quote(action),
        F.lit(', "collector": '),
        json_quote(collector),
        F.lit(', "evidence_id": '),
        json_quote(evidence_id),
        F.lit(', "hash": '),
        json_quote(data_hash),
        F.lit(', "metadata": '),
        meta,
        F.lit(', "parent_hash": "'),
    )
    suf = F.concat(F.lit('", "timestamp": '), json_quote(ts), F.lit("}"))
    return pre, suf


def canonical_entry(parent_hash: Column) -> Column:
    """Canonical text of a chain frame row (columns of ``build_chain``)."""
    pre, suf = _parts(F.col("evidence_id"), F.col("hash"), F.col("collector"), F.col("timestamp"), F.col("metadata_json"), F.col("action"))
    return F.concat(pre, parent_hash, suf)


CHAIN_SCHEMA = T.StructType(
    [
        T.StructField("chain_id", T.StringType()),
        T.StructField(SEQ, T.LongType()),
        T.StructField("evidence_id", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("collector", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("metadata_json", T.StringType()),
        T.StructField("parent_hash", T.StringType()),
        T.StructField("entry_hash", T.StringType()),
    ]
)


def _chain_fold(zero: str = ZERO_HASH):
    """The per-partition fold (built here so it is shipped by value to workers). A
    chain begins with its seed: the hash of the entry before, zeros if there is none."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, last = object(), zero
        for pdf in batches:
            parents, hashes = [], []
            for c, pre, suf, seed in zip(pdf["chain_id"], pdf["_pre"], pdf["_suf"], pdf["_seed"]):
                if c != chain:
                    chain, last = c, seed or zero
                h = hashlib.sha256((pre + last + suf).encode("utf-8")).hexdigest()
                parents.append(last)
                hashes.append(h)
                last = h
            yield pdf.drop(columns=["_pre", "_suf", "_seed"]).assign(parent_hash=parents, entry_hash=hashes)

    return fold


def build_chain(
    df: DataFrame,
    chain_col: str,
    seq_col: str,
    evidence_id: Column,
    data_hash: Column,
    collector: Column,
    collected_at: Column,
    metadata: Column | None = None,
    partitions: int | None = None,
    tails: DataFrame | None = None,
) -> DataFrame:
    """One custody entry per row, linked inside each chain in ``seq_col`` order.
    ``metadata`` may be of any type (``metadata_text``). ``tails`` (``chain_id, seq,
    entry_hash`` of stored chains' last entries): the rows go on from there."""
    meta = metadata_text(df, metadata)
    pre, suf = _parts(evidence_id, data_hash, collector, collected_at, meta, F.lit(ACTION))
    rows = df.select(
        F.col(chain_col).cast("string").alias("chain_id"),
        F.col(seq_col).cast("long").alias(SEQ),
        evidence_id.cast("string").alias("evidence_id"),
        data_hash.cast("string").alias("hash"),
        collector.cast("string").alias("collector"),
        collected_at.cast("string").alias("timestamp"),
        F.lit(ACTION).alias("action"),
        meta.alias("metadata_json"),
        pre.alias("_pre"),
        suf.alias("_suf"),
    )
    n = partitions or num_partitions(rows)
    if tails is None:
        rows = rows.withColumn("_seed", F.lit(None).cast("string"))
    else:
        rows = rows.join(tails.select("chain_id", F.col("entry_hash").alias("_seed")), "chain_id", "left")
    rows = rows.select(*CHAIN_SCHEMA.names[:-2], "_pre", "_suf", "_seed")
    ordered = rows.repartition(n, "chain_id").sortWithinPartitions("chain_id", SEQ)
    return ordered.mapInPandas(_chain_fold(), CHAIN_SCHEMA)


class ForkError(ValueError):
    """Rows that do not go on from a stored chain's last entry."""


def _commit_folder(spark: SparkSession, path: str):
    """The folder of a stored chain table's appends: a file each, named by its number,
    whose text is the name of the append's folders."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, path: str) -> list[str]:
    folder, fs = _commit_folder(spark, path)
    if not fs.exists(folder):
        return []
    found = spark.read.text(f"{path}/commits").select(F.col("_metadata.file_name").alias("n"), "value").orderBy("n").collect()
    if len(found) != len(fs.listStatus(folder)):
        raise ForkError("an append is being made")
    return [r["value"] for r in found]


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """All entries of the chains stored at ``path``."""
    parts = [f"{path}/entries/{c}" for c in _commits(spark, path)]
    return spark.read.schema(CHAIN_SCHEMA).parquet(*parts) if parts else spark.createDataFrame([], CHAIN_SCHEMA)


_TAILS = "chain_id string, seq long, entry_hash string"


def chain_tails(spark: SparkSession, path: str) -> DataFrame:
    """``chain_id, seq, entry_hash`` of the last entry of each stored chain."""
    commits = _commits(spark, path)
    return spark.read.schema(_TAILS).parquet(f"{path}/tails/{commits[-1]}") if commits else spark.createDataFrame([], _TAILS)


def append_chain(df: DataFrame, path: str, chain_col: str, seq_col: str, *args, expected: int | None = None, **kwargs) -> int:
    """Continue the chains stored at ``path`` with the rows of ``df`` (other arguments as
    for ``build_chain``), and return the number of appends so far.

    Entries and the chains' new tails are written to folders of their own; the append
    counts once a file with its number is created, which only one can do. So rows are
    refused (``ForkError``) if they stand at or before a chain's last entry, if another
    append has taken place since ``expected`` appends were seen, or since this one began.
    Memory: as ``build_chain``; tails are joined by chain, a row a chain."""
    spark = df.sparkSession
    commits = _commits(spark, path)
    if expected is not None and expected != len(commits):
        raise ForkError(f"{len(commits)} appends are stored, {expected} expected")
    tails = chain_tails(spark, path)
    rows = df.select(F.col(chain_col).cast("string").alias("chain_id"), F.col(seq_col).cast("long").alias("_new"))
    behind = rows.join(tails, "chain_id").where(F.col("_new") <= F.col(SEQ))
    if not behind.isEmpty():
        first = behind.first()
        raise ForkError(f"chain {first['chain_id']} has an entry {first[SEQ]} already, {first['_new']} cannot follow it")
    name = uuid.uuid4().hex
    build_chain(df, chain_col, seq_col, *args, tails=tails, **kwargs).write.parquet(f"{path}/entries/{name}")
    new = spark.read.schema(CHAIN_SCHEMA).parquet(f"{path}/entries/{name}").select("chain_id", F.struct(SEQ, "entry_hash").alias("e"))
    old = tails.select("chain_id", F.struct(SEQ, "entry_hash").alias("e"))
    last = old.unionByName(new).groupBy("chain_id").agg(F.max("e").alias("e"))
    last.select("chain_id", f"e.{SEQ}", "e.entry_hash").write.parquet(f"{path}/tails/{name}")
    folder, fs = _commit_folder(spark, path)
    fs.mkdirs(folder)
    jvm, number = spark._jvm, len(commits) + 1
    try:
        out = fs.create(jvm.org.apache.hadoop.fs.Path(folder, f"{number:08d}"), False)  # fails if it is there
    except Py4JJavaError as exc:
        for kind in ("entries", "tails"):
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}/{name}"), True)
        raise ForkError(f"append {number} has been made by another") from exc
    out.writeBytes(name)
    out.close()
    return number


def get_chain(chain: DataFrame, chain_id: str) -> DataFrame:
    return chain.where(F.col("chain_id") == F.lit(chain_id)).orderBy(SEQ)


def verify_entries(chain: DataFrame) -> DataFrame:
    """Per entry: ``pos`` (0-based in its chain), ``hash_ok``, ``link_ok``,
    ``first_ok`` and the error texts of that entry."""
    base = chain.withColumnRenamed(SEQ, "entry_seq")
    s = sequence(base, ["entry_seq"], ["chain_id"])
    w = halo_window()
    pre = {
        "_prev": lag_in_key("entry_hash", 1, w, ["chain_id"]),
        "_h1": has_lag_in_key(1, w, ["chain_id"]),
    }
    x = running_max(s, {"_start": F.when(~F.col("_h1"), F.col(SEQ))}, k=1, pre=pre)
    pos = (F.col(SEQ) - F.col("_start")).alias("pos")
    x = x.select("*", pos)
    recomputed = sha256_hex(canonical_entry(F.col("parent_hash")))
    hash_ok = recomputed == F.col("entry_hash")
    link_ok = F.when(F.col("pos") >= 1, F.col("parent_hash").eqNullSafe(F.col("_prev"))).otherwise(F.lit(True))
    first_ok = F.when(F.col("pos") == 0, F.col("parent_hash") == F.lit(ZERO_HASH)).otherwise(F.lit(True))
    x = x.select("*", hash_ok.alias("hash_ok"), link_ok.alias("link_ok"), first_ok.alias("first_ok"))
    errors = F.filter(
        F.array(
            F.when(~F.col("hash_ok"), F.struct(F.lit(0).alias("kind"), F.format_string("Entry %d: hash mismatch (tamper detected)", F.col("pos")).alias("message"))),
            F.when(~F.col("link_ok"), F.struct(F.lit(1).alias("kind"), F.format_string("Entry %d: parent_hash chain broken", F.col("pos")).alias("message"))),
            F.when(~F.col("first_ok"), F.struct(F.lit(2).alias("kind"), F.lit("Entry 0: first entry parent_hash must be zero-hash").alias("message"))),
        ),
        lambda e: e.isNotNull(),
    )
    out = x.withColumn("errors", errors).drop("_prev", "_h1", "_start", SEQ).withColumnRenamed("entry_seq", SEQ)
    return drop_layout(out)


def chain_errors(chain: DataFrame) -> DataFrame:
    """Error rows (chain_id, kind, pos, message); order by (chain_id, kind, pos)."""
    v = verify_entries(chain)
    return v.select("chain_id", "pos", F.explode("errors").alias("e")).select("chain_id", "e.kind", "pos", "e.message")


def verify_chain(chain: DataFrame) -> DataFrame:
    """Per chain: entries, error count, valid."""
    v = verify_entries(chain)
    return v.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum(F.size("errors")).alias("error_count"),
    ).withColumn("valid", F.col("error_count") == 0)
