"""Token ids in files: canonical, length-limited Huffman codes in blocks.

Writing: whole texts are put in ascending id order (range partitions of the
document id, so order costs one shuffle), encoded to token ids, and written; the
ids' counts over the whole corpus give one code for all files, of at most
``MAX_BITS`` bits (package-merge over the vocabulary, the only thing that the
driver holds). Each block takes whole documents up to ``BLOCK_TOKENS`` tokens
and can be decoded alone.

Layout of a folder: ``code`` (id, bits: the code is canonical, so the lengths
say all), ``directory`` (tokens and running start of each part) and ``blocks``
(part, tokens of the part before the block, its documents' ids, its data). The
data of a block is one binary value, little-endian unsigned 32-bit unless said:

    magic "HTK1", tokens, documents, bytes of payload
    per document: its tokens
    per CHECKPOINT tokens: bit offset in the payload (unsigned 64-bit)
    payload: codes, most significant bit first
    crc32 of all before

Decoding walks all stretches between checkpoints in step: each step looks up
the next ``MAX_BITS`` bits of every stretch in one table of ids and lengths.

Defined results: null or empty text has the end id alone; rows with the same id
stand together, ordered by text; null ids come first; an empty table gives empty
files and no rows; only the id and text columns are read, so others never clash.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, parts_for
from .tokens import default_tokenizer, encode_texts

MAX_BITS = 18
BLOCK_TOKENS = 1 << 18
CHECKPOINT = 64
PART_BYTES = 20 << 20  # of input files for a part, about
MAGIC = b"HTK1"

_IDS = "part int, at long, n_tokens long, doc_id long, ids binary, counts binary"
_BLOCKS = "part int, at long, doc_ids array<bigint>, data binary"


# ---- the code ----
def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for positive counts (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids need more than {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.int64)
    leaf_flags, merged = [], np.zeros(0, np.int64)
    for _ in range(max_bits):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        by = np.argsort(both, kind="stable")
        merged = both[by]
        leaf_flags.append(by < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaves in reversed(leaf_flags):
        used = int(leaves[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical(ids: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables by id: code and length (length 0: the id has no code)."""
    size = int(ids.max()) + 1 if len(ids) else 0
    codes, lengths = np.zeros(size, np.uint64), np.zeros(size, np.int64)
    order = np.lexsort((ids, bits))
    code, last = 0, 0
    for k in order:  # one step per id of the vocabulary
        code <<= int(bits[k]) - last
        last = int(bits[k])
        codes[ids[k]], lengths[ids[k]] = code, last
        code += 1
    return codes, lengths


def decode_table(ids: np.ndarray, bits: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """For every ``max_bits``-bit look-ahead, the id (upper bits) and length (lower 5)."""
    table = np.ones(1 << max_bits, np.uint32)
    order = np.lexsort((ids, bits))
    spans = np.left_shift(1, max_bits - bits[order])
    table[: int(spans.sum())] = np.repeat((ids[order] << 5 | bits[order]).astype(np.uint32), spans)
    return table


# ---- blocks ----
def encode_block(ids: np.ndarray, doc_tokens: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    n = lengths.take(ids)
    ends = np.cumsum(n)
    begin = ends - n
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros(total // 64 + 2, np.uint64)
    if total:
        code, word, room = codes.take(ids), begin >> 6, 64 - (begin & 63) - n  # room: bits left in the word, negative if it runs over
        high = code << np.maximum(room, 0).astype(np.uint64)
        over = np.flatnonzero(room < 0)  # one code a word at most
        spill = -room[over]
        high[over] = code[over] >> spill.astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat(high, first)
        words[word[over] + 1] |= code[over] << (64 - spill).astype(np.uint64)
    payload = words.astype(">u8").tobytes()[: (total + 7) // 8]
    body = b"".join(
        (
            MAGIC,
            struct.pack("<III", len(ids), len(doc_tokens), len(payload)),
            doc_tokens.astype("<u4").tobytes(),
            begin[::CHECKPOINT].astype("<u8").tobytes(),
            payload,
        )
    )
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(block: bytes, table: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, tokens of each document)``."""
    if block[:4] != MAGIC or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("damaged block")
    n, docs, size = struct.unpack_from("<III", block, 4)
    doc_tokens = np.frombuffer(block, "<u4", docs, 16)
    lanes = -(-n // CHECKPOINT)
    at = np.frombuffer(block, "<u8", lanes, 16 + 4 * docs).astype(np.int64)
    raw = np.zeros(size + 8 + CHECKPOINT * max_bits // 8, np.uint32)  # the last stretch may run past its end
    raw[:size] = np.frombuffer(block, np.uint8, size, 16 + 4 * docs + 8 * lanes)
    ahead = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    out = np.empty((CHECKPOINT, lanes), np.uint32)
    base = np.int64(32 - max_bits)
    mask = np.uint32((1 << max_bits) - 1)
    for k in range(CHECKPOINT):
        seen = ahead[at >> 3] >> (base - (at & 7)).astype(np.uint32)
        seen &= mask
        found = table[seen]
        out[k] = found
        at += found & np.uint32(31)
    out >>= np.uint32(5)
    return out.T.reshape(-1)[:n], doc_tokens


def _narrow(path: str) -> np.dtype:
    """The integer type in which ids are kept between jobs."""
    from .tokens import encoder

    return encoder(path, True).kind


def _values(column: pa.Array, kind: np.dtype) -> np.ndarray:
    """All bytes of a binary column without nulls, as numbers."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)


def _tokenize(path: str):
    names = ["part", "at", "n_tokens", "doc_id", "ids", "counts"]

    """Ids of a part's documents, with the part's tokens before each (``at``), and
    one last row with the part's counts by id (64 bits each)."""

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import CHUNK, encoder
        from .words import as_strings, text_chunks

        kind, at = _narrow(path), 0
        total = np.zeros(0, np.int64)
        for batch in batches:
            texts = as_strings(batch.column(1))
            for i, j in text_chunks(texts, CHUNK):
                ids = encode_texts(texts.slice(i, j - i), path, narrow=True)
                n = np.array([len(x) // kind.itemsize for x in ids], np.int64)
                ends = at + np.cumsum(n)
                part = batch.column(2).slice(i, j - i)
                packed = pa.array(ids, pa.binary())
                found = np.bincount(_values(packed, kind), minlength=len(total))
                found[: len(total)] += total
                total = found
                columns = [part, pa.array(ends - n), pa.array(n), batch.column(0).slice(i, j - i), packed, pa.nulls(j - i, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)
                at = int(ends[-1])
        encoder(path, True).clear()
        if len(total):
            none = [pa.nulls(1, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([total.astype("<i8").tobytes()], pa.binary())], names)

    return tokenize


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, n`` of the parts' counts."""
    for batch in batches:
        for value in batch.column(0):
            n = np.frombuffer(value.as_buffer(), "<i8")
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some])], ["id", "n"])


def _pack(path: str, ids: np.ndarray, bits: np.ndarray):
    """Blocks of consecutive documents of a part, which come in order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _narrow(path)
        codes, lengths = canonical(ids, bits)
        names: list = []
        held: list[np.ndarray] = []
        part, begin, end = None, 0, 0

        def block() -> pa.RecordBatch:
            data = encode_block(np.concatenate(held), np.array([len(x) for x in held]), codes, lengths)
            row = [pa.array([part], pa.int32()), pa.array([begin], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["part", "at", "doc_ids", "data"])

        for batch in batches:
            rows = (batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3))
            for p, at, doc_id, value in zip(*rows, strict=True):
                if held and (p != part or at != end or end - begin >= BLOCK_TOKENS):
                    yield block()
                    names, held = [], []
                if not held:
                    part, begin, end = p, at, at
                names.append(doc_id)
                held.append(np.frombuffer(value.as_buffer(), kind))
                end += len(held[-1])
        if held:
            yield block()

    return pack


def _unpack(ids: np.ndarray, bits: np.ndarray):
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(ids, bits)
        for batch in batches:
            for start, names, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found, tokens = decode_block(data.as_py(), table)
                cuts = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
                found = found.astype("<u4")
                own = [found[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                columns = [pa.array(names, pa.int64()), pa.array(start + cuts[:-1], pa.int64()), pa.array(tokens, pa.int64()), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    return unpack


# ---- files ----
def write_ids(docs: DataFrame, folder: str, scratch: Scratch, tokenizer: str | None = None, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write the ids of every text to ``folder``, in ascending order of ``doc_id``."""
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    columns = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    ordered = columns.repartitionByRange(parts_for(docs, PART_BYTES), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    numbered = ordered.select("doc_id", "text", F.spark_partition_id().alias("part"))
    every = scratch.write(numbered.mapInArrow(_tokenize(path), _IDS), "ids", "snappy")
    ids = every.where("part is not null")
    counts = every.where("counts is not null").select("counts").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = sorted((r["id"], r["n"]) for r in counts.collect())  # one row per id of the vocabulary
    symbols = np.array([i for i, _ in found], np.int64)
    bits = code_lengths(np.array([n for _, n in found], np.int64))
    code = [(int(i), int(b)) for i, b in zip(symbols, bits, strict=True)]
    spark.createDataFrame(code, "id long, bits int").coalesce(1).write.parquet(f"{folder}/code")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    sums = ids.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    directory = sums.select("part", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("part_start"))
    directory.write.parquet(f"{folder}/directory")
    blocks = ids.select("part", "at", "doc_id", "ids").mapInArrow(_pack(path, symbols, bits), _BLOCKS)
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")
    scratch.drop("ids")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit) from the files."""
    code = sorted((r["id"], r["bits"]) for r in spark.read.schema("id long, bits int").parquet(f"{folder}/code").collect())
    ids, bits = np.array([i for i, _ in code], np.int64), np.array([b for _, b in code], np.int64)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    directory = spark.read.schema("part int, part_start long").parquet(f"{folder}/directory")
    placed = blocks.join(directory, "part").select((F.col("part_start") + F.col("at")).alias("start"), "doc_ids", "data")
    return placed.mapInArrow(_unpack(ids, bits), "doc_id long, start long, n_tokens long, ids binary")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    write_ids(documents(spark, sf_dir), scratch.path("files"), scratch)
    out = read_ids(spark, scratch.path("files"))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op2_token_files": op2_token_files}
ORACLES: dict[str, str] = {}
