"""Approximate nearest neighbours by a permutation index.

A bounded sample of rows gives the pivots (``PIVOTS`` distinct vectors). Every
vector is represented by its ``PREFIX`` nearest pivots, nearest first, and posted
with their places in the pivots' inverted files, shard by shard. For a query,
the files of its own nearest pivots add up, for each vector, the footrule
distance between the two orders (a pivot that one of them lacks stands in place
``PREFIX``): it is PREFIX * (PREFIX + 1) less twice the sum, over common pivots,
of PREFIX - max(place, place). Orders of pivots tell angles and nearness is the
inner product, so footrule is turned into a cosine by a line, fitted for each
query on the pivots (whose cosines are known), and multiplied by the vector's
length. The vectors that are then nearest in each shard (a share of it and
``TIMES`` as many as asked for, and all that tie with the last) are ranked again
by the exact inner product, in double precision, summed in the order of the
components.

Queries in blocks meet shards of rows, each pair a task of bounded size; only
the best few of each pair are shuffled. A vector is sent once for each block.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, or whose length is not the most common one, take no part, nor do
rows without an id; a row never finds rows of its own id; rows with the same id
are found each; equal scores come in order of id; an empty table gives no rows;
only the id and vector columns are read, so others never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

PIVOTS, PREFIX = 128, 64
PIVOT_SAMPLE = 4096  # rows from which pivots are taken
SHARE, TIMES = 0.2, 5  # a fifth of a shard's vectors and five times as many as asked for are ranked exactly
SHARD_ROWS, BLOCK_ROWS = 8192, 8192
EVERY = 20  # rows whose id this divides are queries
TOP = 20


def usable(vector: Column) -> Column:
    """True for a vector with finite components, not all zero."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is not below infinity
    return F.coalesce(vector.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), "<f8").reshape(-1, width)


def lengths_of(vectors: np.ndarray) -> np.ndarray:
    """Lengths, also where squares of components leave the range of doubles."""
    most = np.abs(vectors).max(axis=1)
    return most * np.linalg.norm(vectors / most[:, None], axis=1)


def permutations(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The ``PREFIX`` nearest pivots of each vector, nearest first (by angle)."""
    unit = pivots / lengths_of(pivots)[:, None]
    return np.argsort(-(vectors @ unit.T), axis=1, kind="stable")[:, :PREFIX].astype(np.uint8)


def _represent(pivots: np.ndarray):
    def represent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(batch), -1)
            orders = permutations(v, pivots)
            columns = [batch.column(0), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in orders], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "pivots"])

    return represent


def footrule_gain(postings: tuple[np.ndarray, np.ndarray, np.ndarray], query: np.ndarray, n: int) -> np.ndarray:
    """Half of what each posted vector's footrule distance to the query is below
    its largest value."""
    at, owner, place = postings
    gain = np.zeros(n, np.int32)
    k = len(query)
    for j, p in enumerate(query.tolist()):
        a, b = at[p], at[p + 1]
        gain[owner[a:b]] += k - np.maximum(place[a:b], j)
    return gain


def post(orders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pivot inverted files: ``at[p]:at[p + 1]`` are vectors and places of pivot p."""
    flat = orders.reshape(-1)
    by = np.argsort(flat, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=PIVOTS))])
    return at, (by // orders.shape[1]).astype(np.int64), (by % orders.shape[1]).astype(np.int32)


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added in the order of components."""
    total = np.zeros(len(rows))
    for j in range(len(query)):
        total += rows[:, j] * query[j]
    return total


class Scale:
    """Turns footrule gains into cosines by a line fitted on the pivots."""

    def __init__(self, pivots: np.ndarray):
        self.unit = pivots / lengths_of(pivots)[:, None]
        orders = permutations(pivots, pivots)
        self.place = np.full((len(pivots), len(pivots)), orders.shape[1], np.int32)
        np.put_along_axis(self.place, orders.astype(np.int64), np.arange(orders.shape[1], dtype=np.int32)[None, :], axis=1)

    def line(self, query: np.ndarray, order: np.ndarray) -> tuple[float, float]:
        """Offset and slope; (0, 1) if the pivots show no growth."""
        k = len(order)
        gain = (k - np.maximum(self.place[:, order], np.arange(k))).sum(axis=1).astype(float)
        cosine = self.unit @ (query / lengths_of(query[None])[0])
        other = cosine < 1 - 1e-9  # the query itself may be a pivot
        gain, cosine = gain[other], cosine[other]
        spread = gain - gain.mean() if len(gain) else gain
        slope = (spread * cosine).sum() / (spread * spread).sum() if spread.any() else 0.0
        return (cosine.mean() - slope * gain.mean(), slope) if slope > 0 else (0.0, 1.0)


def search(ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, query_id: int, query: np.ndarray, query_order: np.ndarray, postings, scale: Scale, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of a shard's best rows for one query."""
    offset, slope = scale.line(query, query_order)
    rank = (offset + slope * footrule_gain(postings, query_order, len(ids))) * lengths
    own = ids == query_id
    rank[own] = -np.inf
    want = min(len(ids), int(np.ceil(SHARE * len(ids))) + TIMES * top + int(own.sum()))
    least = np.partition(rank, len(ids) - want)[len(ids) - want]
    near = np.flatnonzero((rank >= least) & ~own)
    rough = vectors[near] @ query
    if len(near) > top:  # the exact order only matters around the last place
        last = np.partition(rough, len(rough) - top)[len(rough) - top]
        near = near[rough >= last - 1e-9 * max(1.0, abs(last))]
    score = inner(vectors[near], query)
    best = np.lexsort((ids[near], -score))[:top]
    return ids[near][best], score[best]


def _search_block(pivots: np.ndarray, top: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        is_query = t["is_query"].to_numpy(zero_copy_only=False).astype(bool)
        ids = t["vec_id"].to_numpy()
        width = len(t["v"][0].as_buffer()) // 8
        depth = len(t["pivots"][0].as_buffer())
        vectors = _matrix(t["v"].combine_chunks(), width)
        orders = np.frombuffer(b"".join(x.as_buffer() for x in t["pivots"].combine_chunks()), np.uint8).reshape(-1, depth)
        rows = ~is_query
        postings, scale = post(orders[rows]), Scale(pivots)
        found = []
        own = (ids[rows], vectors[rows], lengths_of(vectors[rows]))
        if rows.any():
            found = [(q, *search(*own, q, vectors[i], orders[i], postings, scale, top)) for i, q in zip(np.flatnonzero(is_query), ids[is_query], strict=True)]
        return pa.table(
            {
                "query_id": pa.array(np.repeat([q for q, _, _ in found], [len(a) for _, a, _ in found]).astype(np.int64)),
                "vec_id": pa.array(np.concatenate([a for _, a, _ in found] or [np.zeros(0)]).astype(np.int64)),
                "score": pa.array(np.concatenate([s for _, _, s in found] or [np.zeros(0)])),
            }
        )

    return run


def nearest(vectors: DataFrame, scratch: Scratch, is_query: Column, top: int = TOP, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` nearest found for each query."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("is_query"))
    x = x.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = sorted((-r["n"], r["d"]) for r in x.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
    if not sizes:
        return empty
    count, width = -sizes[0][0], sizes[0][1]
    x = x.where(F.size("v") == width)
    sample = x.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").select("v").limit(PIVOT_SAMPLE).collect()
    _, first = np.unique(np.array([r["v"] for r in sample]), axis=0, return_index=True)
    pivots = np.array([sample[i]["v"] for i in sorted(first)[:PIVOTS]])
    asked = x.where("is_query").select("vec_id").count()
    shards, blocks = -(-count // SHARD_ROWS), max(1, -(-asked // BLOCK_ROWS))
    schema = "vec_id long, v binary, pivots binary"
    rows = scratch.write(x.select("vec_id", "v").mapInArrow(_represent(pivots), schema), "represented")
    queries = scratch.write(x.where("is_query").select("vec_id", "v").mapInArrow(_represent(pivots), schema), "queries")
    place = F.xxhash64("v", "vec_id")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = rows.select("vec_id", "v", "pivots", F.lit(False).alias("is_query"), F.pmod(place, F.lit(shards)).cast("int").alias("shard"), each(blocks).alias("block"))
    asks = queries.select("vec_id", "v", "pivots", F.lit(True).alias("is_query"), each(shards).alias("shard"), F.pmod(place, F.lit(blocks)).cast("int").alias("block"))
    found = cells.unionByName(asks).groupBy("shard", "block").applyInArrow(_search_block(pivots, top), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), Scratch(spark), F.col("vec_id") % EVERY == 0)


QUERIES = {"op10_neighbours": op10_neighbours}
ORACLES: dict[str, str] = {}
