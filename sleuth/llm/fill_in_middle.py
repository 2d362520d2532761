"""Fill-in-the-middle: texts are cut twice and their parts put in another order.

The places where a text may be cut are kept as a compressed set of byte offsets,
one for each code point and one for the text's end. The set is made of containers
of 65,536 offsets, each in the smallest of three forms (an array of 16-bit values,
a bitmap, or runs), with cumulative cardinalities. ``BoundarySet.select(k)`` finds
the container of the k-th boundary by binary search and selects within it; the two
selects of a text give both cuts.

A row is drawn by its id: ``h1``..``h4`` are the first four groups of 8 digits of
the hex sha256 of ``<seed>:<id>``. The prefix ends after the smaller of h1 % (n + 1)
and h2 % (n + 1) units, the middle after the larger one. Forms: ``plain`` (the text
as it is), ``psm`` (prefix, suffix, middle) and ``spm`` (suffix, prefix, middle).

Every row is transformed alone, in one pass without a shuffle. Texts go through
Python in chunks of about 512 kB; a longer text stands alone, at some 5 bytes of
memory for each of its bytes.

Defined results: null or empty text is plain, with no unit; a text that contains a
sentinel is plain; a null id is drawn as the empty id; repeated rows are drawn
alike; an empty table gives no rows; only the id and the text are read, so other
columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuth.session import let_import

from .common import documents

# ---- fixed values of the output's format ----
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_PERCENT = 90  # of the texts are transformed
SPM_PERCENT = 20  # of those with the suffix first
SEED = 1

CONTAINER = 1 << 16  # offsets of a container
_BITMAP_BYTES = CONTAINER // 8


class ArrayContainer:
    """Sorted 16-bit values."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.values[k])


class RunContainer:
    """Runs of consecutive values: their starts, and how many values stand before each."""

    def __init__(self, values: np.ndarray, breaks: np.ndarray):
        first = np.concatenate([[0], breaks])
        self.starts, self.before = values[first].astype(np.uint16), first.astype(np.int32)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


class BitmapContainer:
    """One bit a value, with the number of bits set before each 64-bit word."""

    def __init__(self, values: np.ndarray):
        bits = np.zeros(CONTAINER, np.uint8)
        bits[values] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        rest = int(self.words[word])
        for _ in range(k - int(self.before[word])):
            rest &= rest - 1
        return word * 64 + (rest & -rest).bit_length() - 1


def container(values: np.ndarray) -> ArrayContainer | RunContainer | BitmapContainer:
    """The smallest container of sorted values below ``CONTAINER``."""
    breaks = np.flatnonzero(np.diff(values) != 1) + 1
    runs_bytes, array_bytes = 2 + 4 * (len(breaks) + 1), 2 * len(values)
    if runs_bytes <= min(array_bytes, _BITMAP_BYTES):
        return RunContainer(values, breaks)
    return ArrayContainer(values) if array_bytes <= _BITMAP_BYTES else BitmapContainer(values)


class BoundarySet:
    """Byte offsets of a UTF-8 text at which a code point begins, and that of its end."""

    def __init__(self, raw: np.ndarray):
        self.containers, self.keys, counts = [], [], []
        for start in range(0, len(raw) + 1, CONTAINER):
            leads = (raw[start : start + CONTAINER] & 0xC0) != 0x80
            values = np.flatnonzero(leads)
            if start + CONTAINER > len(raw):
                values = np.append(values, len(raw) - start)
            if len(values):
                self.containers.append(container(values))
                self.keys.append(start)
                counts.append(len(values))
        self.cumulative = np.cumsum(counts)

    @property
    def units(self) -> int:
        """Code points of the text."""
        return int(self.cumulative[-1]) - 1

    def select(self, k: int) -> int:
        """The k-th boundary, from 0."""
        at = int(np.searchsorted(self.cumulative, k, side="right"))
        return self.keys[at] + self.containers[at].select(k - (int(self.cumulative[at - 1]) if at else 0))


_SENTINELS = tuple(x.encode() for x in (PREFIX, SUFFIX, MIDDLE))


def transform(raw: bytes, draws: tuple[int, int, int, int], fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple:
    """``(units, form, first cut, second cut, first offset, second offset, output)``
    of one text; cuts and offsets are None if it stays plain."""
    bounds = BoundarySet(np.frombuffer(raw, np.uint8))
    n = bounds.units
    h1, h2, h3, h4 = draws
    if not n or h3 % 100 >= fim_percent or any(s in raw for s in _SENTINELS):
        return n, "plain", None, None, None, None, raw
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = bounds.select(first), bounds.select(second)
    p, s, m = _SENTINELS
    if h4 % 100 < spm_percent:
        return n, "spm", first, second, i, j, b"".join((s, raw[j:], p, raw[:i], m, raw[i:j]))
    return n, "psm", first, second, i, j, b"".join((p, raw[:i], s, raw[j:], m, raw[i:j]))


_COLUMNS = "n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output string"


def _run(fim_percent: int, spm_percent: int):
    names = [c.split()[0] for c in _COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .words import as_strings, text_chunks

        for batch in batches:
            texts = as_strings(batch.column(0))
            draws = [batch.column(k).to_pylist() for k in range(2, 6)]
            for a, b in text_chunks(texts):
                raws = texts.slice(a, b - a).cast(pa.large_binary()).to_pylist()
                done = [transform(raw, h, fim_percent, spm_percent) for raw, *h in zip(raws, *(d[a:b] for d in draws), strict=True)]
                n, form, first, second, i, j, output = zip(*done, strict=True)
                counts = [pa.array(c, pa.int64()) for c in (first, [None if x is None else y - x for x, y in zip(first, second, strict=True)])]
                sizes = [pa.array(c, pa.int64()) for c in (i, [None if x is None else y - x for x, y in zip(i, j, strict=True)])]
                columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), *counts, *sizes, pa.array(output, pa.binary()).view(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), *columns], ["doc_id", *names])

    return run


def fill_in_middle(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, prefix_bytes, middle_bytes, output``
    of every row: code points, form, the sizes of prefix and middle in code points and
    bytes (null if plain), and the text in its new order."""
    let_import(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"), *draws)
    return rows.mapInArrow(_run(fim_percent, spm_percent), f"doc_id long, {_COLUMNS}")


def restored(form: Column, output: Column) -> Column:
    """The text of an output, found from the output and its form alone. A part holds no
    sentinel, so each sentinel's first place after the one before is its own."""
    skip = len(PREFIX)

    def parts(second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(skip + 1))
        one = F.substring_index(body, second, 1)
        body = F.substr(body, F.char_length(one) + skip + 1)
        two = F.substring_index(body, MIDDLE, 1)
        return one, two, F.substr(body, F.char_length(two) + skip + 1)

    prefix, suffix, middle = parts(SUFFIX)
    suffix_, prefix_, middle_ = parts(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(documents(spark, sf_dir))
    return out.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t)::BIGINT AS n,
             ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
             ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || substr(t, 1, i) || '<S>' || substr(t, j + 1) || '<M>' || substr(t, i + 1, j - i)
                        ELSE '<S>' || substr(t, j + 1) || '<P>' || substr(t, 1, i) || '<M>' || substr(t, i + 1, j - i) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""

QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
ORACLES = {"op11_fill_in_middle": OP11_SQL}
