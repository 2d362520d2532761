"""Packing documents into token windows by lexical retrieval.

Documents are dealt to shards by a hash (document-partitioned index, so no key
is hot). A shard cuts every whole window off its documents' fronts; what is left
of each is packed: the shard keeps a BM25 inverted index of its documents' token
ids, a seed document asks for its best unused neighbours by its most telling
terms, and they fill its window in that order while they fit: all neighbours are
asked, however many are too long. What gap is left
goes to a part of the best neighbour that was too long, whose rest stays for a
later window. So only the last window of a shard is not full.

Defined results: null or empty text is the end id alone; rows with the same id
are separate documents; an empty table gives no rows; only the id and text
columns are read, so others never clash. A document's pieces cover its ids once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, parts_for
from .tokens import default_tokenizer, encode_texts, encoder

WINDOW = 1024
SHARD_BYTES = 15 << 20  # of input files for a shard, about
TERMS = 32  # most telling terms of a seed that are looked up
K1, B = 1.2, 0.75

_PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Index:
    """BM25 postings of a shard: for each term the documents and their weights."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        found = [np.unique(d, return_counts=True) for d in docs]
        sizes = np.array([len(t) for t, _ in found], np.int64)
        terms = np.concatenate([t for t, _ in found])
        tf = np.concatenate([c for _, c in found]).astype(np.float32)
        doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
        df = np.bincount(terms)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        length = np.array([len(d) for d in docs], np.float64)
        norm = (K1 * (1 - B + B * length / length.mean())).astype(np.float32)
        weight = (idf[terms] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        self.terms, self.weight, self.first = terms, weight, np.concatenate([[0], np.cumsum(sizes)])
        self.df, self.n = df, n
        order = np.argsort(terms, kind="stable")
        self.doc, self.post = doc[order], weight[order]
        self.at = np.concatenate([[0], np.cumsum(df)])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of each document for the seed's most telling terms (ties: by
        term); 0 where none is shared."""
        terms = self.terms[self.first[seed] : self.first[seed + 1]]
        weight = np.where(self.df[terms] > 1, self.weight[self.first[seed] : self.first[seed + 1]], 0)
        if len(terms) > TERMS:
            best = np.argsort(-weight, kind="stable")[:TERMS]
            terms, weight = terms[best], weight[best]
        spans = [(self.at[t], self.at[t + 1]) for t, w in zip(terms.tolist(), weight.tolist(), strict=True) if w > 0]
        if not spans:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.doc[a:b] for a, b in spans]), weights=np.concatenate([self.post[a:b] for a, b in spans]), minlength=self.n)

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a telling term, best first (ties: by place)."""
        score = self.scores(seed)
        score[used] = 0
        ids = np.flatnonzero(score)
        return ids[np.argsort(-score[ids], kind="stable")]

    def filling(self, seed: int, used: np.ndarray, left: np.ndarray, room: int) -> tuple[list[int], int | None]:
        """The neighbours that fill ``room``, taken best first while they fit, and
        the best of those that do not fit, if there is one.

        What was too long for the room fits no later, when less is left; so the
        best that fits is taken again and again, and nothing needs to be sorted.
        """
        score = self.scores(seed)
        score[used] = 0
        ids = np.flatnonzero(score)
        rank, size = score[ids], left[ids]
        long = np.ones(len(ids), bool)
        fits = np.flatnonzero(size <= room)
        taken = []
        while len(fits):
            k = fits[rank[fits].argmax()]  # the first of equals
            taken.append(int(ids[k]))
            long[k] = False
            room -= int(size[k])
            fits = fits[(size[fits] <= room) & (fits != k)]
        over = np.flatnonzero(long) if room else np.zeros(0, np.int64)
        return taken, int(ids[over[rank[over].argmax()]]) if len(over) else None


def pack(docs: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """``(document, start, length, sequence, offset)`` of all pieces of a shard."""
    out, sequence = [], 0
    sizes = np.array([len(d) for d in docs], np.int64)
    for k in np.flatnonzero(sizes >= window):
        for start in range(0, sizes[k] - window + 1, window):
            out.append((int(k), start, window, sequence, 0))
            sequence += 1
    begin = sizes // window * window  # what is left of each document begins here
    left = sizes - begin
    used = left == 0
    index = Index(docs)
    for seed in range(len(docs)):
        while not used[seed]:  # again if the seed itself filled what was open
            offset = 0

            def put(k: int, room: int, sequence: int = sequence) -> int:
                n = min(int(left[k]), room)
                out.append((int(k), int(begin[k]), n, sequence, offset))
                begin[k] += n
                left[k] -= n
                used[k] = left[k] == 0
                return n

            offset += put(seed, window)
            long = None
            if offset < window:
                near, long = index.filling(seed, used, left, window - offset)
                for k in near:
                    offset += put(k, window - offset)
            k = seed
            while offset < window:
                if long is None:  # no neighbour is left: the next unused documents
                    while k < len(docs) and used[k]:
                        k += 1
                    if k == len(docs):
                        break
                    long = k
                offset += put(long, window - offset)
                long = None
            sequence += 1
    return out


def _shard(path: str, window: int):
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(path, True).kind
        names: list = []
        docs: list[np.ndarray] = []
        place = 0
        for batch in batches:
            names += batch.column(0).to_pylist()
            docs += [np.frombuffer(x, kind) for x in encode_texts(batch.column(1), path, narrow=True)]
            place = batch.column(2)[0].as_py() if len(batch) else place
        encoder(path, True).clear()
        if not docs:
            return
        pieces = pack(docs, window)
        for i in range(0, len(pieces), 2000):
            part = pieces[i : i + 2000]
            k, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*part, strict=True))
            ids = [docs[a][b : b + n].astype("<u4").tobytes() for a, b, n, _, _ in part]
            columns = [
                pa.array([names[a] for a in k], pa.int64()),
                pa.array(start),
                pa.array(length),
                pa.array(ids, pa.binary()),
                pa.array([len(docs[a]) for a in k], pa.int64()),
                pa.array(sequence + (place << 32)),
                pa.array(offset),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return shard


def packed(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece with its ids (little-endian unsigned 32-bit)."""
    columns = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shards = columns.repartition(parts_for(docs, SHARD_BYTES), F.xxhash64("doc_id", "text"))
    ordered = shards.sortWithinPartitions("doc_id", "text").select("doc_id", "text", F.spark_partition_id().cast("long").alias("shard"))
    return ordered.mapInArrow(lean(_shard(tokenizer or default_tokenizer(), window)), _PIECE)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packed(documents(spark, sf_dir))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op1_packing": op1_packing}
ORACLES: dict[str, str] = {}
