"""Connected components of an edge table, without the driver holding any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``a, b`` (undirected) -> ``node, label``; the label is the least node.

    Each round takes the least label among a node's neighbours and then the
    label of its label, so chains shorten by half; it ends when nothing moves.
    Minima are combined before the shuffle, so a hub costs no more than others.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.write(both.distinct(), f"{name}-edges")
    first = both.groupBy("a").agg(F.min("b").alias("_m"))
    labels = scratch.write(first.select(F.col("a").alias("node"), F.least("a", "_m").alias("label")), f"{name}-0")
    k = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("_m"))
        nearer = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "_m").alias("_to"), F.col("label").alias("_old"))
        above = labels.select(F.col("node").alias("_to"), F.col("label").alias("_up"))
        moved = nearer.join(above, "_to").select("node", F.least("_to", "_up").alias("label"), "_old")
        k += 1
        after = scratch.write(moved, f"{name}-{k}")
        changed = after.where(F.col("label") != F.col("_old")).limit(1).count()
        labels = after.drop("_old")
        scratch.drop(f"{name}-{k - 1}")
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels
