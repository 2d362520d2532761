"""Near-duplicate documents by circulant MinHash.

Signatures: a document's 5-word shingles fall on a circle of ``CIRCLE`` places;
permutation sigma breaks their order, and coordinate k of the signature is the
least value of permutation pi, shifted by k, over these places. So two
permutations give all coordinates. Bands of coordinates are bucket keys.

Candidates: documents with equal shingle sets are one node first (copies need
no pairs). In a bucket of up to ``SMALL`` nodes all pairs are candidates; in a
larger one, each node is compared with one hub, the node whose buckets hold most
nodes (an original has more in common with its near copies than they have with
each other). Nodes of a large bucket that are still not connected to its hub are
then held against the bucket's other members, block by block, where pairs of
different components with ``AGREE`` equal coordinates or more are confirmed there;
only links that join two components leave the task.

Links: candidates are confirmed on whole shingle sets of 64-bit hashes, before
anything is joined by them. Components are found by label propagation in tables.

Defined results: null, empty or wordless text has an empty set and is linked
with nothing; rows with the same doc_id are separate documents; rows without an
id link like others, their component is named by its least id, null if none has
one; very long texts are taken whole, each in a chunk of its own; an empty table
gives no rows; only the id and text columns are read, so others never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, lean
from .graph import components

PERCENT = 85
CIRCLE = 1 << 20
ROWS, BANDS = 4, 16  # a pair at 0.85 shares a band but for a chance of 7e-6
SMALL = 16
AGREE = 38  # of 64 coordinates; a pair at 0.85 has fewer with a chance of 2e-7, less than that of no common band
BLOCK = 1024
SEED = 20240601

_SIGNATURE = "doc_id long, n_shingles long, fp binary, bands array<bigint>, sig binary"


@lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    """sigma, and pi with its first values repeated at the end (the shift wraps)."""
    rng = np.random.default_rng(SEED)
    sigma = rng.permutation(CIRCLE).astype(np.int32)
    pi = rng.permutation(CIRCLE).astype(np.int32)
    return sigma, np.concatenate([pi, pi[: ROWS * BANDS]])


def circulant(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Signatures (rows x coordinates) of sets given as places; none is empty."""
    sigma, pi = permutations()
    at = sigma[places]
    out = np.empty((len(offsets) - 1, ROWS * BANDS), np.int32)
    for k in range(ROWS * BANDS):
        out[:, k] = np.minimum.reduceat(pi[at + k], offsets[:-1])
    return out


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from row, to row, hashes, offsets)``: each row's distinct shingles, sorted."""
    from .words import as_strings, shingles_of, text_chunks, words_of

    texts = as_strings(texts)
    for i, j in text_chunks(texts):
        hashes, offsets = shingles_of(words_of(texts.slice(i, j - i)))
        rows = np.repeat(np.arange(j - i), np.diff(offsets))
        order = np.lexsort((hashes, rows))
        hashes, rows = hashes[order], rows[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        counts = np.bincount(rows[new], minlength=j - i)
        yield i, j, hashes[new], np.concatenate([[0], np.cumsum(counts)])


def fingerprints(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """128 bits for each set (None: empty): sums of two mixes of its hashes."""
    from .words import mix

    sums = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes ^ np.uint64(salt)), out=total[1:])
        sums.append(total[offsets[1:]] - total[offsets[:-1]])
    pairs = np.stack(sums, axis=1).astype(">u8")
    return [pairs[r].tobytes() if offsets[r] < offsets[r + 1] else None for r in range(len(pairs))]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .words import mix

    for batch in batches:
        for i, j, hashes, offsets in shingle_sets(batch.column(1)):
            n = np.diff(offsets)
            some = np.flatnonzero(n)
            bands: list = [None] * (j - i)
            short: list = [None] * (j - i)
            if len(some):
                starts = np.append(offsets[:-1][some], offsets[-1])
                sig = circulant((hashes % np.uint64(CIRCLE)).astype(np.int64), starts).astype(np.uint64)
                keys = np.empty((len(some), BANDS), np.uint64)
                for b in range(BANDS):
                    key = np.full(len(some), b + 1, np.uint64)
                    for k in range(b * ROWS, (b + 1) * ROWS):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, k])
                    keys[:, b] = key
                low = (sig & np.uint64(255)).astype(np.uint8)  # 8 bits tell coordinates apart but for 1 in 256
                for k, (r, own) in enumerate(zip(some, keys.view(np.int64).tolist(), strict=True)):
                    bands[r], short[r] = own, low[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(fingerprints(hashes, offsets), pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary())],
                ["doc_id", "n_shingles", "fp", "bands", "sig"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, hashes, offsets in shingle_sets(batch.column(0)):
            fps = fingerprints(hashes, offsets)
            own = [hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(own, pa.binary())], ["fp", "set"])


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(_alike(s, t, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_())], ["a", "b", "linked"])

    return confirm


def _hold_against(percent: int):
    """Links of one bucket's block of nodes left over (``x``) to a block of members."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x = t["x"].to_numpy(zero_copy_only=False).astype(bool)
        n, fp, label = t["n"].to_numpy(), t["fp"].to_pylist(), t["label"].to_pylist()
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(fp), ROWS * BANDS)
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in t["set"].combine_chunks()]
        above: dict = {}

        def top(c: bytes) -> bytes:
            while c in above:
                c = above[c]
            return c

        y = np.flatnonzero(~x)
        links = []
        for i in np.flatnonzero(x):
            agree = (sig[y] == sig[i]).sum(axis=1)
            close = 100 * np.minimum(n[y], n[i]) >= percent * np.maximum(n[y], n[i])
            at = np.flatnonzero((agree >= AGREE) & close)
            for k in y[at[np.argsort(-agree[at], kind="stable")]].tolist():
                own, other = top(label[i]), top(label[k])
                if own != other and _alike(sets[i], sets[k], percent):
                    links.append((min(fp[i], fp[k]), max(fp[i], fp[k])))
                    above[max(own, other)] = min(own, other)
        return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})

    return run


def _common(s: np.ndarray, t: np.ndarray) -> int:
    """Values that two sorted arrays without repeats have in common."""
    if len(s) > len(t):
        s, t = t, s
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    return int((t[at] == s).sum())


def _alike(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sets share ``percent`` of their union or more."""
    both = _common(s, t)
    return 100 * both >= percent * (len(s) + len(t) - both)


def _bucket_pairs(members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs ``a < b`` of buckets, and members of large ones with their hub."""
    hub = F.max(F.struct("weight", "fp", "n"))
    stats = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), hub.alias("hub")).where("c > 1")
    tagged = members.join(stats, "key")
    close = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  else their ratio is too small
    lists = tagged.where(F.col("c") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("fp", "n")).alias("m"))
    # at most SMALL members in each list
    pairs = F.flatten(
        F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (x["fp"] < y["fp"]) & close(x["n"], y["n"])), lambda y: F.struct(x["fp"].alias("a"), y["fp"].alias("b"))))
    )
    small = lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    large = tagged.where(F.col("c") > SMALL)
    star = large.where((F.col("fp") != F.col("hub.fp")) & close(F.col("n"), F.col("hub.n")))
    star = star.select(F.least("fp", "hub.fp").alias("a"), F.greatest("fp", "hub.fp").alias("b"))
    return small.unionByName(star).distinct(), large.select("key", "fp", "n", F.col("hub.fp").alias("hub"))


def near_duplicates(docs: DataFrame, scratch: Scratch, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id, fp``: one row per input row. ``fp``
    names the document's shingle set (null: empty)."""
    columns = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = scratch.write(columns.mapInArrow(lean(_signatures), _SIGNATURE), "signatures")
    some = signed.where("fp is not null")
    nodes = scratch.write(some.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n"), F.min("bands").alias("bands"), F.min("sig").alias("sig")), "nodes")
    exploded = nodes.select("fp", "n", F.posexplode("bands").alias("band", "key"))
    several = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    several = scratch.write(several, "several")  # so that the join's own shuffle can split a hot key
    sized = scratch.write(exploded.join(several, "key"), "sized")
    weights = sized.groupBy("fp").agg(F.sum("c").alias("weight"))
    members = scratch.write(sized.drop("c").join(weights, "fp"), "members")

    ids = members.select("fp").distinct().join(nodes.select("fp", "first_id"), "fp")
    wanted = columns.join(ids.select(F.col("first_id").alias("_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    found = wanted.select("text").mapInArrow(lean(_sets), "fp binary, set binary")
    sets = scratch.write(found.dropDuplicates(["fp"]), "sets")

    pairs, large = _bucket_pairs(members, percent)
    x = pairs.join(sets.select(F.col("fp").alias("a"), F.col("set").alias("s")), "a")
    x = x.join(sets.select(F.col("fp").alias("b"), F.col("set").alias("t")), "b").select("a", "b", "s", "t")
    tested = scratch.write(x.mapInArrow(lean(_confirm(percent)), "a binary, b binary, linked boolean"), "tested")
    large = scratch.write(large.select("key", "fp", "n", "hub"), "large")
    labels = components(tested.where("linked"), scratch, "labels-0")

    # nodes of large buckets that are not connected to their bucket's hub (x), against the bucket's members
    named = large.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    hubs = labels.select(F.col("node").alias("hub"), F.col("label").alias("_hub"))
    named = named.join(hubs, "hub", "left").withColumn("x", F.col("label") != F.coalesce("_hub", "hub")).select("key", "fp", "n", "label", "x")
    named = scratch.write(named, "named")
    sizes = named.groupBy("key").agg(F.ceil(F.count_if("x") / BLOCK).cast("int").alias("xs"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("ys")).where("xs > 0")
    left = named.join(sizes, "key").join(nodes.select("fp", "sig"), "fp").join(sets, "fp")
    place = F.xxhash64("fp")
    each = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    mine = lambda c: F.array(F.pmod(place, F.col(c)).cast("int"))
    # a node left over is in one block of those, against all of members; every node is a member
    roles = F.array(F.struct(F.lit(False).alias("x"), each("xs").alias("i"), mine("ys").alias("j")), F.when(F.col("x"), F.struct(F.lit(True).alias("x"), mine("xs").alias("i"), each("ys").alias("j"))))
    dealt = left.select("key", "fp", "n", "label", "sig", "set", F.explode(F.filter(roles, lambda r: r.isNotNull())).alias("r"))
    dealt = dealt.select("key", "fp", "n", "label", "sig", "set", "r.x", F.explode("r.i").alias("i"), "r.j")
    dealt = dealt.select("key", "fp", "n", "label", "sig", "set", "x", "i", F.explode("j").alias("j"))
    more = dealt.groupBy("key", "i", "j").applyInArrow(_hold_against(percent), "a binary, b binary").distinct()
    more = scratch.write(more, "more")
    labels = components(tested.where("linked").select("a", "b").unionByName(more), scratch, "labels-1")

    named = nodes.select("fp", "first_id").join(labels, nodes["fp"] == labels["node"], "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    classes = scratch.write(named.join(least, "label").select(F.col("fp").alias("_fp"), "component_id"), "classes")
    out = signed.join(classes, signed["fp"] == classes["_fp"], "left")
    scratch.drop("sets", "sized", "members", "several", "nodes", "tested", "large", "named", "more")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "fp")


def without_near_duplicates(docs: DataFrame, scratch: Scratch, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of one document of each component, its smallest doc_id. Rows that
    are alike in id and text count as one."""
    found = near_duplicates(docs, scratch, text=text, doc_id=doc_id)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_keep")).distinct()
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(text).alias("_text"), F.struct(*docs.columns).alias("_row"))
    x = rows.join(keep, rows["_id"].eqNullSafe(keep["_keep"]), "left_semi")
    return x.dropDuplicates(["_id", "_text"]).select("_row.*")


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir), Scratch(spark))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) END AS g FROM w),
n AS (SELECT g, min(doc_id) AS node, len(g) AS n FROM g WHERE len(g) > 0 GROUP BY g),
e AS (SELECT node, n, unnest(g) AS s FROM n),
p AS (SELECT x.node AS a, y.node AS b, x.n AS na, y.n AS nb, count(*) AS k FROM e x JOIN e y ON x.s = y.s AND x.node < y.node
      AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
two AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT node AS a, node AS b FROM n UNION SELECT reach.a, two.b FROM reach JOIN two ON reach.b = two.a),
c AS (SELECT a AS node, min(b) AS component_id FROM reach GROUP BY a)
SELECT g.doc_id, len(g.g)::BIGINT AS n_shingles, coalesce(c.component_id, g.doc_id)::BIGINT AS component_id,
       g.doc_id = coalesce(c.component_id, g.doc_id) AS kept
FROM g LEFT JOIN n ON g.g = n.g LEFT JOIN c ON c.node = n.node
"""

QUERIES = {"op6_near_dup": op6_near_dup}
ORACLES = {"op6_near_dup": OP6_SQL}
