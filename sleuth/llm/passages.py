"""Repeated passages by compact windows.

Texts that are equal are one class first; the class's smallest doc_id keeps the
text, its copies are repeats as a whole. The words of a class's text give a
sequence of 5-word shingle hashes. For each of ``FUNCTIONS`` min-hash functions
the Cartesian tree of the sequence splits all its subsequences of at least
``MIN_WORDS`` words into compact windows (l, c, r): every subsequence within l..r
that holds c has its least hash at c. So two texts that share a passage share,
for most functions, a value whose windows both cover it.

Equal rows count once. Windows whose value occurs in one class only are dropped.
Those of the others are grouped by value, and linked with the earliest class of their
group. Per pair of classes, windows on close diagonals are joined to one interval on
either side, over all functions, and the shared values are counted. With ``AGREE``
or more, both intervals' shingles are compared: runs of common shingles, joined over
small gaps, are repeats if they have ``MIN_WORDS`` words or more and the Jaccard similarity of both sides is
``SIMILARITY`` or more. The later class's words are marked.

The earliest class of a group may share less than a passage with members that
share one among themselves. So members whose shared value lies in no span that was
found with their group's earliest class are grouped anew, by what stands around the
value: the hash of the ``left`` shingles before it and the ``right`` ones after it,
in step. A passage with one changed word of 50 has a run of 20 shingles or more
without it, so for most functions the value stands in such a run, and its members
meet in a group of one of the ``SHORT`` shapes (11 shingles). Each group's members
are linked with its earliest one, and with the earliest but the class tried before.
Those still confirmed with none go on to the ``LONG`` shapes (41 shingles), and then
to all windows of ``SPAN`` shingles that hold the value: there, equal keys are equal
passages, so the earliest one is every other's partner.
All of it is joins by key: work grows with the members, and no pairs are made
within a group.

The texts of the classes are dealt into buckets by class once, so that each step
that reads them shuffles what it asks of them only. Windows and contexts are dealt
by their value in blocks of many rows; where they meet, those of one class go, the
first of each value's others are told, and what is left is an ordinary table.

Defined results: null, empty and short texts have no passages and stay whole; rows
with the same id are separate documents, and equal rows copies of the first; an
empty table gives no rows; only the id and text columns are read, so others never
clash. A text of one word over and over has one shingle and no passage. Texts go
through Python in chunks of 512 kB; a longer text stands alone, at some 100 bytes of
memory for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .common import Scratch, documents, job_settings, lean, parts_for

MIN_WORDS = 50
WIDTH = 5
SPAN = MIN_WORDS - WIDTH + 1  # shingles of the shortest passage
SIMILARITY = 0.8
FUNCTIONS = 6
GAP = 10  # shingles between runs that may be joined: two changed words
SLACK = 8  # shingles beyond the common part of two windows that are compared too
DIAGONALS = 64
REQUESTS = 1000  # intervals cut from one copy of a text
AGREE = 2  # values that two texts share on one diagonal, to be compared at once
#: Shapes (left, right) of the context of a value: shingles before and after it.
SHORT = [(k, 10 - k) for k in range(0, 11, 5)]
LONG = [(k, 40 - k) for k in range(0, 41, 5)]
WHOLE = [(k, SPAN - 1 - k) for k in range(SPAN)]

HELD = 32 << 20  # bytes of rows that a task deals or joins at once
SLICED = 1 << 20  # shingles of intervals that a task returns at once
PART_BYTES = 10 << 20  # of input files for a partition of windows, about
_DEALT_ROW = "part int, data binary, uid long, n_words long"
_DEALT = ["part", "data", "uid", "n_words"]
_MEMBER = ["uid", "pid", "c", "l", "r", "open", "first_uid"]
_MEMBER_ROW = "uid long, pid long, c int, l int, r int, open boolean, first_uid long"
_NONE = np.uint32(0xFFFFFFFF)
#: Joins whose smaller side turns out to be so small in each partition do without sorting.
HASH_JOINS = {"spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m"}


def compact_windows(h: np.ndarray, width: int = SPAN, offsets: np.ndarray | None = None) -> np.ndarray:
    """Rows ``(l, c, r)`` of the Cartesian trees' nodes that are ``width`` or wider, for
    each of the texts between ``offsets`` (none: one text).

    A node is that wide if it is the least of some ``width`` values in a row; its bounds
    are the next smaller ones on both sides, which are such nodes too."""
    offsets = np.array([0, len(h)]) if offsets is None else offsets
    none = np.zeros((0, 3), np.int64)
    if len(h) < width:
        return none
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    packed = h.astype(np.uint64) << np.uint64(32) | np.arange(1, len(h) + 1, dtype=np.uint64)  # of equal ones the first
    least, span = packed, 1
    while span < width:
        step = min(span, width - span)
        least, span = np.minimum(least[:-step], least[step:]), span + step
    least = least[text[: len(least)] == text[width - 1 :]]
    if not len(least):
        return none
    least = least[np.append(True, least[1:] != least[:-1])]
    c = (least & np.uint64(0xFFFFFFFF)).astype(np.int64) - 1
    own = text[c]
    at = np.arange(1, len(c) + 1) + np.cumsum(np.append(False, own[1:] != own[:-1]))
    values, places = np.zeros(at[-1] + 2, np.uint64), np.zeros(at[-1] + 2, np.int64)  # zeros stand between texts
    values[at], places[at] = least, c
    bounds = []
    for side in (-1, 1):
        smaller, todo = np.arange(len(values)) + side, at
        while len(todo := todo[values[smaller[todo]] > values[todo]]):
            smaller[todo] = smaller[smaller[todo]]
        bounds.append(smaller[at])
    l = np.where(values[bounds[0]] == 0, offsets[own], places[bounds[0]] + 1)
    r = np.where(values[bounds[1]] == 0, offsets[own + 1], places[bounds[1]]) - 1
    return np.stack([l, c, r], axis=1)[h[c] != _NONE]


def shingle_rows(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(from row, to row, shingle hashes, offsets, words of each row)``."""
    from .words import as_strings, shingles_of, text_chunks, words_of

    texts = as_strings(texts)
    for i, j in text_chunks(texts):
        batch = words_of(texts.slice(i, j - i))
        yield (i, j, *shingles_of(batch, WIDTH, whole=False), np.diff(batch.first))


def _windows(parts: int):
    """Windows of each text dealt by their value, and the texts' words: rows with the
    key null and the words as c, which go to some partition as they are."""
    from .words import mix

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | np.ndarray]:
        for batch in batches:
            uids = batch.column(0).to_numpy()
            for i, j, hashes, offsets, words in shingle_rows(batch.column(1)):
                again = np.zeros(len(hashes), bool)  # the same shingle as just before: no window of its own
                again[1:] = hashes[1:] == hashes[:-1]
                for f in range(FUNCTIONS):
                    full = mix(hashes ^ np.uint64(0xA0761D6478BD642F * (f + 1) & (2**64 - 1)))
                    order = (full >> np.uint64(32)).astype(np.uint32)
                    order[again] = _NONE
                    l, c, r = compact_windows(order, SPAN, offsets).T
                    d = np.searchsorted(offsets, c, side="right") - 1
                    yield np.stack([full.view(np.int64)[c], uids[i + d], *(x - offsets[d] for x in (c, l, r))])
                yield pa.RecordBatch.from_arrays([pa.array((uids[i:j] % parts).astype(np.int32)), pa.nulls(j - i, pa.binary()), pa.array(uids[i:j]), pa.array(words, pa.int64())], _DEALT)

    return lambda batches: _dealt(rows(batches), parts)


def _dealt(rows: Iterator[pa.RecordBatch | np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """Columns of rows (the first is their key) cut by key into one value for each of
    ``parts`` partitions; batches pass as they are."""

    def cut(held: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(held, axis=1)
        part = ((every[0] & 0xFFFFFFFF) * parts) >> 32
        order = np.argsort(part, kind="stable")
        first = np.searchsorted(part[order], np.arange(parts + 1))
        some = np.flatnonzero(np.diff(first))
        every = every[:, order]
        data = [every[:, first[k] : first[k + 1]].tobytes() for k in some.tolist()]
        none = pa.nulls(len(some), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(data, pa.binary()), none, none], _DEALT)

    held, size = [], 0
    for x in rows:
        if isinstance(x, pa.RecordBatch):
            yield x
        elif x.shape[1]:
            held.append(x)
            size += x.nbytes
            if size >= HELD:
                yield cut(held)
                held, size = [], 0
    if held:
        yield cut(held)


def _hulls(rows: np.ndarray) -> np.ndarray:
    """Windows (key, uid, c, l, r) with what their text has in their group: whether the
    row is the first (``lead``), least and greatest c, and farthest reach to both sides."""
    key, uid, c, l, r = rows = rows[:, np.lexsort(rows[1::-1])]
    new = np.append(True, (key[1:] != key[:-1]) | (uid[1:] != uid[:-1]))
    first = np.flatnonzero(new)
    ends = [f.reduceat(x, first) for f, x in ((np.minimum, c), (np.maximum, c), (np.maximum, c - l), (np.maximum, r - c))]
    return np.concatenate([rows, new[None].astype(np.int64), np.stack(ends)[:, np.cumsum(new) - 1]])


def _earliest(rows: np.ndarray, order: list[int]) -> np.ndarray:
    """Of each key the first row by the columns ``order``, which begin with the key."""
    rows = rows[:, np.lexsort(rows[order[::-1]])]
    return rows[:, np.append(True, rows[0, 1:] != rows[0, :-1])] if rows.shape[1] else rows


def _several(names: list[str], kinds: list[pa.DataType], wide: int, more=lambda rows: rows, order: list[int] | None = None, some=lambda rows: [rows]):
    """The rows (``wide`` columns) whose key occurs with two values or more of the second
    column, with what ``more`` adds, and rows without a key. Rows of a key with one value
    are held, so a frequent key costs no memory.

    With ``order``, rows have a last column ``place``, 0; then follow, for the k-th of
    ``some`` selections of rows, each key's first row by ``order`` with the place k."""

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, alone = np.zeros(0, np.int64), np.zeros((wide, 0), np.int64)
        new: list[np.ndarray] = []
        first: dict[int, np.ndarray] = {}

        def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not rows.shape[1]:
                return
            rows = more(rows)
            if order:
                for k, x in enumerate(some(rows), 1):
                    first[k] = _earliest(np.concatenate([first[k], x], axis=1) if k in first else x, order)
            yield from placed(rows, 0)

        def placed(rows: np.ndarray, place: int) -> Iterator[pa.RecordBatch]:
            if order:
                rows = np.concatenate([rows, np.full((1, rows.shape[1]), place)])
            for a in range(0, rows.shape[1], 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)]).cast(t) for x, t in zip(rows, kinds, strict=True)], names)

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal known, alone
            rows = np.concatenate(new, axis=1)
            new.clear()
            if len(known):
                again = known[np.minimum(np.searchsorted(known, rows[0]), len(known) - 1)] == rows[0]
                yield from out(rows[:, again])
                rows = rows[:, ~again]
            rows = np.concatenate([alone, rows], axis=1)
            rows = rows[:, np.argsort(rows[0], kind="stable")]
            begin = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1])) if rows.shape[1] else np.zeros(0, np.int64)
            if not len(begin):
                return
            two = np.minimum.reduceat(rows[1], begin) < np.maximum.reduceat(rows[1], begin)
            known = np.sort(np.concatenate([known, rows[0, begin[two]]]))
            here = np.repeat(two, np.diff(np.append(begin, rows.shape[1])))
            alone = rows[:, ~here]
            yield from out(rows[:, here])

        for batch in batches:
            alike = batch.filter(batch.column(0).is_null())
            if len(alike):
                none = pa.nulls(len(alike), pa.int64())
                yield pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip([none, alike.column(1), alike.column(2), *[none] * (len(names) - 3)], kinds, strict=True)], names)
            for value in batch.column(0).drop_null():
                new.append(np.frombuffer(value.as_buffer(), np.int64).reshape(wide, -1))
                if sum(x.nbytes for x in new) >= 2 * HELD + alone.nbytes:
                    yield from settle()
        if new:
            yield from settle()
        for k, x in first.items():
            yield from placed(x, k)

    return several


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StructArray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(asks, shingle hashes, begin, end)`` of a chunk's texts: where the text of each
    ask stands in the hashes."""
    for batch in batches:
        for i, j, hashes, offsets, _ in shingle_rows(batch.column(0)):
            lists = batch.column(1).slice(i, j - i)
            text = np.repeat(np.arange(j - i), lists.value_lengths().to_numpy())
            yield lists.flatten(), hashes, offsets[text], offsets[text + 1]


def _field(asks: pa.StructArray, name: str) -> np.ndarray:
    return asks.field(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of requested intervals (32 bits each), with the asks' other fields."""
    for asks, hashes, low, high in _asked(batches):
        begin = np.maximum(_field(asks, "begin"), 0)
        first = np.minimum(low + begin, high)
        n = np.maximum(np.minimum(low + _field(asks, "end") + 1, high) - first, 0)
        low, ends, a = hashes.astype("<u4"), np.append(0, np.cumsum(n)), 0
        while a < len(n):
            b = max(int(np.searchsorted(ends, ends[a] + SLICED, side="right")) - 1, a + 1)
            own = ends[a : b + 1] - ends[a]
            cut = low[np.repeat(first[a:b] - own[:-1], n[a:b]) + np.arange(own[-1])]
            data = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((4 * own).astype(np.int32)), pa.py_buffer(cut)])
            part, own = asks.slice(a, b - a), [f.name for f in asks.type if f.name not in ("begin", "end")]
            yield pa.RecordBatch.from_arrays([*[part.field(c) for c in own], pa.array(begin[a:b].astype(np.int32)), data], [*own, "begin", "shingles"])
            a = b


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])]


def _among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in ``some``, which is sorted and not empty."""
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x


def common_spans(first: np.ndarray, later: np.ndarray) -> list[tuple[int, int]]:
    """Spans (shingle positions, ends included) of ``later`` that repeat ``first``.

    Runs of common shingles with small gaps are tried as one span, which is cut at
    its widest gap until its parts are alike enough or too short."""
    places = np.sort(first.astype(np.uint64) << np.uint64(32) | np.arange(len(first), dtype=np.uint64))
    values = (places >> np.uint64(32)).astype(first.dtype)
    at = np.minimum(np.searchsorted(values, later), len(first) - 1)
    where = (places[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of equal ones the first
    hit = values[at] == later
    if hit.sum() < SPAN * SIMILARITY * 0.5:
        return []
    hits = np.concatenate([[0], np.cumsum(hit)])
    plain = len(_distinct(later)) == len(later)  # no shingle twice: hits are distinct
    pos = np.flatnonzero(hit)
    gaps = np.diff(pos)

    def alike(a: int, b: int) -> bool:
        if plain and hits[b + 1] - hits[a] < SIMILARITY * (b + 1 - a):
            return False
        t = _distinct(later[a : b + 1])
        on = np.arange(a, b + 1)[hit[a : b + 1]]
        leans = np.sort(where[on] - on)
        lean = int((leans[(len(on) - 1) // 2] + leans[len(on) // 2]) / 2)  # the median
        x, y = max(a + lean - GAP, 0), min(b + lean + GAP, len(first) - 1)
        there = np.flatnonzero(_among(first[x : y + 1], t))
        if not len(there):
            return False
        s = _distinct(first[x + there[0] : x + there[-1] + 1])
        both = int(_among(s, t).sum())
        return both >= SIMILARITY * (len(s) + len(t) - both)

    cuts = np.flatnonzero(gaps > GAP + 1)
    todo = list(zip([0, *(cuts + 1)], [*cuts, len(pos) - 1], strict=True))  # ranges of hits
    out = []
    while todo:
        i, j = todo.pop()
        a, b = int(pos[i]), int(pos[j])
        if b - a + 1 < SPAN:
            continue
        if alike(a, b):
            out.append((a, b))
        elif (inner := gaps[i:j]).max() > 1:
            widest = np.flatnonzero(inner == inner.max())
            k = i + int(widest[len(widest) // 2])  # the middle one of the widest
            todo += [(i, k), (k + 1, j)]
    return sorted(out)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        a, b, shift = (batch.column(k).to_pylist() for k in (0, 1, 2))
        for k, (x, y) in enumerate(zip(batch.column(3), batch.column(4), strict=True)):
            first, later = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
            if len(first) and len(later):
                rows += [(a[k], b[k], shift[k] + i, shift[k] + j + WIDTH) for i, j in common_spans(first, later)]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["a", "b", "begin", "end"])


def contexts(hashes: np.ndarray, at: np.ndarray, shapes: list[tuple[int, int]], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles around the places ``at``, a column for each shape, and
    whether the place's text, from ``low`` to ``high`` - 1, reaches that far."""
    from .words import _powers, mix

    up, down = _powers(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    left, right = np.array(shapes, np.int64).T
    begin, end = at[:, None] - left, at[:, None] + right + 1
    inside = (begin >= low[:, None]) & (end <= high[:, None])
    begin, end = np.where(inside, begin, 0), np.where(inside, end, 0)
    salt = mix(np.arange(1, len(shapes) + 1, dtype=np.uint64) + np.uint64(1000 * len(shapes)))
    return mix((sums[end] - sums[begin]) * down[begin] ^ salt), inside


def _contexts(shapes: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asks, hashes, low, high in _asked(batches):
            at = low + _field(asks, "c")
            for a in range(0, len(at), 1 << 14):
                part, here = asks.slice(a, 1 << 14), slice(a, a + (1 << 14))
                keys, inside = contexts(hashes, at[here], shapes, low[here], high[here])
                ends = pa.array(np.arange(0, keys.size + 1, len(shapes), dtype=np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64).ravel(), mask=~inside.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.field(c) for c in _MEMBER], lists], [*_MEMBER, "keys"])

    return run


def _dealt_contexts(first: int, number: int, parts: int):
    """Members once for each of ``number`` keys from ``first`` on, dealt by the key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            if not len(batch):
                continue
            own = np.stack([batch.column(batch.schema.get_field_index(c)).cast(pa.int64()).to_numpy() for c in _MEMBER])
            lists = batch.column(batch.schema.get_field_index("keys")).flatten()
            wide = len(lists) // len(batch)  # all have one length
            keys = lists.fill_null(0).to_numpy().reshape(-1, wide)[:, first : first + number].ravel()
            some = ~lists.is_null().to_numpy(zero_copy_only=False).reshape(-1, wide)[:, first : first + number].ravel()
            yield np.concatenate([keys[None, some], own[:, np.repeat(np.arange(len(batch)), number)[some]]])

    return lambda batches: _dealt(rows(batches), parts)


def repeats(docs: DataFrame, scratch: Scratch, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``(classes, spans)``.

    classes: ``md5, first_id, uid, n_words, spans, from_id, repeated_by``: one row
    per distinct text; ``spans`` are its repeated words (``begin`` to ``end`` - 1),
    merged and in order, ``from_id`` the least first_id among the texts it repeats,
    ``repeated_by`` the number of later texts that repeat words of its own.
    spans: ``a, b, begin, end``: the words of class b that repeat class a.
    """
    with job_settings(docs.sparkSession, HASH_JOINS):
        return _repeats(docs, scratch, text, doc_id)


def _repeats(docs: DataFrame, scratch: Scratch, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    columns = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    columns = columns.select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), "text")
    rows = columns.groupBy("md5", "doc_id").agg(F.count(F.lit(1)).alias("n"))  # equal rows count once
    grouped = rows.groupBy("md5").agg(F.min(F.struct("doc_id", "n")).alias("f")).select("md5", F.col("f.doc_id").alias("first_id"), F.col("f.n").alias("first_rows"))
    grouped = grouped.repartitionByRange("first_id", "md5").sortWithinPartitions("first_id", "md5")
    classes = scratch.write(grouped.withColumn("uid", F.monotonically_increasing_id()), "classes")  # in order of first_id
    some_equal = not classes.where("first_rows > 1").isEmpty()

    # the text of each class: that of its first row, and of equal rows one
    ids = classes.select(F.col("first_id").alias("_id"), F.col("md5").alias("_md5"), "first_rows", "uid")
    found = columns.join(ids.hint("shuffle_hash"), (columns["md5"] == ids["_md5"]) & columns["doc_id"].eqNullSafe(ids["_id"]))
    if some_equal:
        found = found.where("first_rows = 1").unionByName(found.where("first_rows > 1").dropDuplicates(["uid"]))
    parts = parts_for(docs, PART_BYTES)
    texts = scratch.bucketed(found.select("uid", "text"), "texts", parts, "uid")  # read often, so dealt once

    def shared_rows(dealt: DataFrame, schema: str, wide: int, *more) -> DataFrame:
        """Dealt rows (key, uid and more) whose key occurs in several classes, and first rows."""
        schema += ", place int"
        kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        names, types = zip(*(x.split(" ") for x in schema.split(", ")), strict=True)
        return dealt.repartitionById(parts, "part").select("data", "uid", "n_words").mapInArrow(lean(_several([*names], [kinds[t] for t in types], wide, *more)), schema)

    # all windows of a text with one value are dealt together, so that they meet with their hull
    windows = shared_rows(texts.mapInArrow(lean(_windows(parts)), _DEALT_ROW), "key long, uid long, c int, l int, r int, lead boolean, hull_c int, hull_d int, hull_l int, hull_r int", 5, _hulls, [0, 1, 6, 7, 8, 9], lambda rows: [rows[:, rows[5] == 1]])
    windows = scratch.write(windows, "windows")  # and a row without a key for each text
    words = windows.where("key is null").select("uid", F.col("c").cast("long").alias("n_words"))
    shared = windows.where("place = 0")

    # groups by value; the least class is every member's partner
    # a text whose words come round again has many windows in a group: one row with their hull
    members, least = (windows.where(x).select(F.col("key").alias("group"), "uid", *[F.col(f"hull_{x}").alias(x) for x in "cdlr"]) for x in ("place = 0 and lead", "place = 1"))
    least = least.select("group", F.struct("uid", "c", "d", "l", "r").alias("first"))
    linked = members.join(least, "group").where(F.col("uid") > F.col("first.uid"))

    def gathered(asks: DataFrame, function, schema: str, name: str) -> DataFrame:
        """``function`` of the texts and what is asked of them; a text is read once per
        REQUESTS asks."""
        asks = asks.repartition(parts, "uid")  # as the texts are dealt
        copies = asks.groupBy("uid").agg(F.ceil(F.count(F.lit(1)) / REQUESTS).alias("copies"))
        dealt = asks.join(copies.hint("shuffle_hash"), "uid").withColumn("copy", F.pmod(F.xxhash64("ask.pid"), F.col("copies")))
        lists = dealt.groupBy("uid", "copy").agg(F.collect_list("ask").alias("asks"))  # about REQUESTS each
        both = texts.join(lists.hint("shuffle_hash"), "uid").select("text", "asks")  # texts are not sorted
        return scratch.write(both.mapInArrow(lean(function), schema), name)

    def cut(asks: DataFrame, name: str) -> DataFrame:
        """``pid, side, uid, begin, shingles`` of intervals."""
        return gathered(asks, _slices, "pid long, side int, uid long, begin int, shingles binary", name)

    def asked(rows: DataFrame, side: int, uid: str, begin: Column, end: Column) -> DataFrame:
        return rows.select(F.col(uid).alias("uid"), F.struct("pid", F.lit(side).alias("side"), F.col(uid).alias("uid"), begin.cast("int").alias("begin"), end.cast("int").alias("end")).alias("ask"))

    def verified(linked: DataFrame, k: int, agree: int = 1) -> DataFrame:
        """Spans ``a, b, begin, end`` of linked members (``first`` is the earlier one)
        that are linked on a diagonal ``agree`` times or more."""
        left, right = F.least("l", "first.l") + SLACK, F.least("r", "first.r") + SLACK
        pairs = linked.groupBy(F.col("first.uid").alias("a"), F.col("uid").alias("b"), F.floor((F.col("first.c") - F.col("c")) / DIAGONALS).alias("diagonal")).agg(
            F.min(F.col("first.c") - left).alias("a_begin"),
            F.max(F.col("first.d") + right).alias("a_end"),
            F.min(F.col("c") - left).alias("b_begin"),
            F.max(F.col("d") + right).alias("b_end"),
            F.count(F.lit(1)).alias("agree"),
        )
        pairs = pairs.where(F.col("agree") >= agree).drop("agree")
        pairs = scratch.write(pairs.withColumn("pid", F.monotonically_increasing_id()), f"pairs-{k}")
        asks = [asked(pairs, side, uid, F.col(f"{uid}_begin"), F.col(f"{uid}_end")) for side, uid in enumerate("ab")]
        slices = cut(asks[0].unionByName(asks[1]), f"slices-{k}")
        one = lambda side, name, *more: slices.where(F.col("side") == side).select("pid", F.col("shingles").alias(name), *more)
        both = one(0, "first", F.col("uid").alias("a")).join(one(1, "later", "begin", F.col("uid").alias("b")), "pid")
        out = both.select("a", "b", "begin", "first", "later").mapInArrow(lean(_verify), "a long, b long, begin int, end int").distinct()
        out = scratch.write(out, f"spans-{k}")
        scratch.drop(f"slices-{k}")
        return out

    spans = verified(linked, 0, AGREE)

    # members whose value lies in no span with their group's least class are open
    groups = least.select("group", F.col("first.uid").alias("first_uid"))
    reach = (F.col("c") - F.col("l")).alias("l"), (F.col("r") - F.col("c")).alias("r")  # of a window from its value
    rest = shared.select(F.col("key").alias("group"), "uid", "c", *reach).join(groups, "group")
    inside = (F.col("begin") <= F.col("c")) & (F.col("c") <= F.col("end") - WIDTH)
    own = spans.groupBy(F.col("a").alias("first_uid"), F.col("b").alias("uid")).agg(F.collect_list(F.struct("begin", "end")).alias("own"))
    held = F.exists("own", lambda x: (x["begin"] <= F.col("c")) & (F.col("c") <= x["end"] - WIDTH))
    open_ = (F.col("uid") > F.col("first_uid")) & ~F.coalesce(held, F.lit(False))
    rest = rest.join(own, ["first_uid", "uid"], "left").select("group", "uid", "c", "l", "r", "first_uid", open_.alias("open"))
    rest = scratch.write(rest.withColumn("pid", F.monotonically_increasing_id()), "rest")
    left = scratch.write(rest.join(rest.where("open").select("group").distinct(), "group", "left_semi"), "left")

    def keys_of(rows: DataFrame, shapes: list[tuple[int, int]], name: str) -> DataFrame:
        """``rows`` with the hashes of the contexts of their values (``keys``)."""
        places = rows.select("uid", F.struct(*_MEMBER).alias("ask"))
        return gathered(places, _contexts(shapes), f"{_MEMBER_ROW}, keys array<long>", f"{name}-keys")

    def around(rows: DataFrame, first: int, number: int, name: str) -> DataFrame:
        """``rows`` once for each context (of ``number`` shapes from ``first`` on) that
        another class has too, with its key."""
        dealt = rows.select(*_MEMBER, "keys").mapInArrow(lean(_dealt_contexts(first, number, parts)), _DEALT_ROW)
        keyed = shared_rows(dealt, f"key long, {_MEMBER_ROW}", 1 + len(_MEMBER), lambda rows: rows, [0, 1, 3, 4, 5], lambda rows: [rows, rows[:, rows[1] != rows[7]]])
        keyed = scratch.write(keyed, f"{name}-shared")
        member = F.struct("uid", "c", F.col("c").alias("d"), "l", "r")
        first, second = (keyed.where(F.col("place") == k).select("key", member.alias(x)) for k, x in ((1, "first"), (2, "second")))
        return scratch.write(keyed.where("place = 0").drop("place").join(first, "key").join(second, "key", "left"), name)

    def linked_with_first(rows: DataFrame) -> DataFrame:
        """Open members with the earliest of their context, and with the earliest but the
        class that they could not be confirmed with before."""
        each = rows.where("open").select("uid", "c", F.col("c").alias("d"), "l", "r", F.explode(F.array_distinct(F.array("first", "second"))).alias("first"))
        return each.where(F.col("uid") > F.col("first.uid"))  # equal rows make one pair

    found = [spans]
    if not left.isEmpty():
        rows = every = keys_of(left, SHORT + LONG, "near")
        for k, (first, shapes) in enumerate(((0, SHORT), (len(SHORT), LONG), (0, WHOLE)), 1):
            name = ("short", "long", "whole")[k - 1]
            if shapes is WHOLE:
                rows = keys_of(scratch.write(rows.select(*_MEMBER), "long-left"), WHOLE, "whole")
            near = around(rows, first, len(shapes), name)
            found.append(verified(linked_with_first(near), k))
            if shapes is WHOLE:
                break
            # contexts with later members that are still confirmed with none, and all who share them
            mine = near.where(F.col("open") & (F.col("uid") > F.col("first.uid")))
            own = found[-1].select(F.col("b").alias("_b"), "begin", "end").distinct()
            unsettled = mine.select("pid", "key", "uid", "c").join(own, (F.col("uid") == F.col("_b")) & inside, "left_anti").select("key").distinct()
            unsettled = scratch.write(unsettled, f"{name}-unsettled")
            if unsettled.isEmpty():
                break
            pids = near.join(unsettled, "key", "left_semi").select("pid").distinct()
            rows = every.join(pids, "pid", "left_semi")  # fewer each time
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    spans = scratch.write(spans.distinct(), "spans")

    # overlapping spans of a class are merged: a span starts a new one if all before it end earlier
    in_text = Window.partitionBy("b").orderBy("begin", "end")
    before = F.max("end").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    parts = spans.select("b", "begin", "end").distinct().withColumn("_new", F.coalesce(before < F.col("begin"), F.lit(True)).cast("int"))
    parts = parts.withColumn("_part", F.sum("_new").over(in_text)).groupBy("b", "_part").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    lists = parts.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    found = lists.join(spans.groupBy("b").agg(F.min("a").alias("a")), "b").withColumnRenamed("b", "uid")
    found = found.join(classes.select(F.col("uid").alias("a"), F.col("first_id").alias("from_id")), "a").drop("a")
    later = spans.groupBy(F.col("a").alias("uid")).agg(F.count_distinct("b").alias("repeated_by"))
    out = classes.join(words, "uid", "left").join(found, "uid", "left").join(later, "uid", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_words", "repeated_by")]
    out = scratch.write(out.select("md5", "first_id", "uid", "spans", "from_id", *counts), "repeats")
    scratch.drop_bucketed("texts")
    scratch.drop("windows", "rest", "left", "near-keys", "whole-keys", "long-left")
    scratch.drop(*[f"{name}{x}" for name in ("short", "long", "whole") for x in ("", "-shared", "-unsettled")])
    return out, spans


def marked(docs: DataFrame, classes: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, n_words, spans, from_id, repeated_by`` (0 for
    copies) and the document's columns as ``row``. A copy of an earlier document is a repeat as a whole if it
    has ``MIN_WORDS`` words."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("doc_id"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_md5"))
    x = rows.join(classes.drop("uid"), rows["_md5"] == classes["md5"])
    copy = ~F.col("doc_id").cast("long").eqNullSafe(F.col("first_id")) & (F.col("n_words") >= MIN_WORDS)
    whole = F.array(F.struct(F.lit(0).alias("begin"), F.col("n_words").cast("int").alias("end")))
    none = F.array().cast("array<struct<begin:int,end:int>>")
    spans = F.when(copy, whole).otherwise(F.coalesce("spans", none))
    return x.select("doc_id", "n_words", spans.alias("spans"), F.when(copy, F.col("first_id")).otherwise(F.col("from_id")).alias("from_id"), F.when(copy, F.lit(0)).otherwise(F.col("repeated_by")).alias("repeated_by"), "row")


def _cut(text: str):
    """New texts of rows (first column) without the words of their spans (second);
    ``keep`` is false where no word is left. Rows without spans stay as they are."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .words import as_strings, text_chunks, words_of

        for batch in batches:
            rows, spans = batch.column(0), batch.column(1)
            if not len(batch):
                continue
            out: list = [None] * len(batch)
            keep = np.ones(len(batch), bool)
            at = np.flatnonzero(np.diff(spans.offsets.to_numpy()))
            some = as_strings(rows.field(rows.type.get_field_index(text))).take(pa.array(at))
            for i, j in text_chunks(some):
                chunk = some.slice(i, j - i)
                w, base = words_of(chunk), 0
                for d, t in enumerate(chunk.to_pylist()):
                    raw, left, kept, begin = t.encode("utf-8", "surrogatepass"), int(w.first[d + 1] - w.first[d]), [], 0
                    for s in spans[int(at[i + d])].as_py():
                        a, b = int(w.first[d]) + s["begin"], int(w.first[d]) + s["end"] - 1
                        kept.append(raw[begin : int(w.start[a]) - base])
                        begin = int(w.end[b]) - base
                        left -= s["end"] - s["begin"]
                    kept.append(raw[begin:])
                    out[at[i + d]], keep[at[i + d]] = b"".join(kept).decode("utf-8", "surrogatepass").strip(), left > 0
                    base += len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(keep), rows], ["new", "keep", "row"])

    return cut


def without_repeats(docs: DataFrame, classes: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the words of repeated passages cut from their texts; a text of
    which no word is left goes."""
    schema = StructType([StructField("new", StringType()), StructField("keep", BooleanType()), StructField("row", docs.schema)])
    x = marked(docs, classes, text, doc_id).select("row", "spans").mapInArrow(lean(_cut(text)), schema).where("keep")
    return x.select(*[F.coalesce("new", F.col(f"row.`{c}`")).alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    classes, _ = repeats(docs, Scratch(spark))
    out = marked(docs, classes)
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return out.select("doc_id", "n_words", words.alias("repeated_words"), "spans", "from_id", "repeated_by")


QUERIES = {"op5_passages": op5_passages}
ORACLES: dict[str, str] = {}
