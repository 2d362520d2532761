"""Spelling variants: words of the corpus that lie one edit apart.

Words are counted in the JVM. Two words lie one edit apart if one code point was
inserted, deleted or replaced; their error is at the first place where they differ.

Groups. A pair belongs to the class of its shorter length ``l`` and to one window
``[a, b)`` of error places; all words of a window's group have the same code points
before ``a`` and the same last ``l - b``, so a pair meets in the one window that
holds its error, and in no other. A class starts with two windows, the halves.
Groups of more than ``GROUP`` words are halved again, as often as needed: in a window
of one place only one code point (two in the longer words) is free, so a group ends
at the square of the alphabet. No pair is lost, and none is found twice.

Index. In a task, whole groups of one window are put together to blocks. For each
(position, letter) of the window a bitset over the block's words says which of them
have that letter there. All words of the block are asked at once: ``zero`` holds the
words that agree so far, ``one`` those with one error behind them, and one pass over
the positions moves both,

    replaced   one = one & has[i][q_i]      | zero & ~has[i][q_i]
    inserted   one = one & has[i + 1][q_i]  | zero & ~has[i][q_i]
    deleted    one = one & has[i][q_(i+1)]  | zero & ~has[i][q_i]
    zero = zero & has[i][q_i]

(64 words a step). The bits stand in the order (group, falling count, word), so the
number of bits is the number of near words and the lowest bit is the best of them:
no pair is ever written.

Defined results: null or empty texts have no words; a null id counts as the empty id
where runs are damaged; repeated rows count each time; an empty table gives no rows;
only the id and the text are read, so other columns never clash. Memory of a task: one
block (at most ``CELLS`` letters, or one group), whatever the texts; a text is cut
into words in the JVM, where the list of its words of 6 letters or more must fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuth.session import let_import

from .common import Scratch, documents

# ---- fixed values of the query's contract ----
MIN_LENGTH = 6  # code points of a word
MIN_COUNT = 5  # occurrences of a word
RATIO = 5  # a form is at least so many times as frequent
DAMAGE = 199  # one run in so many loses a code point

GROUP = 2048  # words of a group before its window is halved
BLOCK = 1024  # words of a block, or one group
CELLS = 1 << 18  # letters of a block's window, of a stripe of the index

_CAPITALS, _SMALL = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
_KEYS = ["l", "a", "b", "head", "tail"]


# ---- words ----
def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int = DAMAGE) -> DataFrame:
    """``word, n`` of the letter runs of whole texts, of at least ``min_length`` code
    points after the damage and ``min_count`` occurrences."""
    runs = F.regexp_extract_all(F.col(text), F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{min_length},}})"), F.lit(1))
    found = docs.select(F.col(doc_id).cast("string").alias("_id"), F.explode(runs).alias("_run"))
    run = F.when(F.col("_run").rlike("[A-Z]"), F.translate("_run", _CAPITALS, _SMALL)).otherwise(F.col("_run"))
    found = found.select("_id", run.alias("_run"))
    h = F.crc32(F.concat(F.coalesce(F.col("_id"), F.lit("")), F.lit(":"), F.col("_run")).cast("binary"))
    found = found.select("_run", h.alias("_h"))
    at = F.pmod(F.col("_h"), F.char_length("_run")).cast("int")
    cut = F.concat(F.substr("_run", F.lit(1), at), F.substr("_run", at + 2))
    word = F.when(F.pmod(F.col("_h"), F.lit(damage)) == 0, cut).otherwise(F.col("_run"))
    counts = found.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") >= min_count) & (F.char_length("word") >= min_length))


# ---- groups ----
def _keyed(entries: DataFrame) -> DataFrame:
    """``entries`` (word, n, l, a, b) with the code points outside the window."""
    outside = F.greatest(F.col("l") - F.col("b"), F.lit(0))
    tail = F.substr("word", F.char_length("word") - outside + 1, outside)
    return entries.select("word", "n", "l", "a", "b", F.substr("word", F.lit(1), F.col("a")).alias("head"), tail.alias("tail"))


def _halves(a: Column, b: Column) -> Column:
    middle = F.floor((a + b) / 2).cast("int")
    return F.array(F.struct(a.alias("a"), middle.alias("b")), F.struct(middle.alias("a"), b.alias("b")))


def _halved(entries: DataFrame) -> DataFrame:
    return entries.select("word", "n", "l", F.explode(_halves(F.col("a"), F.col("b"))).alias("w")).select("word", "n", "l", "w.a", "w.b")


def grouped(words: DataFrame, scratch: Scratch, group: int = GROUP) -> DataFrame:
    """``word, n, l, a, b, head, tail``: each word once for each group it stands in."""
    size = F.char_length("word")
    entries = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("l"))
    entries = _keyed(_halved(entries.where("l > 0").select("word", "n", "l", F.lit(0).alias("a"), (F.col("l") + 1).alias("b"))))
    done = None
    while True:
        large = entries.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("_c")).where((F.col("_c") > group) & (F.col("b") - F.col("a") > 1))
        large = scratch.write(large.drop("_c"), f"large-{0 if done is None else done[1]}")
        if large.isEmpty():
            return entries if done is None else done[0].unionByName(entries)
        small = entries.join(large, _KEYS, "left_anti").select("word", "n", *_KEYS)
        k = 1 if done is None else done[1] + 1
        done = (small if done is None else done[0].unionByName(small), k)
        entries = scratch.write(_keyed(_halved(entries.join(large, _KEYS, "left_semi"))), f"halved-{k}")


# ---- the bit-sliced index ----
class Index:
    """Bitsets over words of one length: which have a letter at a position."""

    def __init__(self, codes: np.ndarray, letters: int):
        self.codes, self.letters, self.size = codes, letters, len(codes)
        self.words64 = -(-max(len(codes), 1) // 64)
        self.stripe = max(1, CELLS // max(len(codes), 64))
        self.at, self.table = None, None

    def bits(self, members: np.ndarray) -> np.ndarray:
        """Packed rows of a boolean array whose last axis is the words."""
        packed = np.packbits(members, axis=-1, bitorder="little")
        out = np.zeros((*members.shape[:-1], self.words64 * 8), np.uint8)
        out[..., : packed.shape[-1]] = packed
        return out.view("<u8")

    def has(self, position: int, letter: np.ndarray) -> np.ndarray:
        """For each asked letter the words that have it at ``position``."""
        start = position // self.stripe * self.stripe
        if self.at != start:  # positions are asked in rising order: one stripe is held
            part = self.codes[:, start : start + self.stripe]
            self.table = self.bits(part.T[:, None, :] == np.arange(self.letters, dtype=part.dtype)[None, :, None])
            self.at = start
        return self.table[position - start, letter]


def replaced(index: Index, zero: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Words with one other code point than the words asked (rows of ``q``)."""
    one = np.zeros_like(zero)
    for i in range(q.shape[1]):
        has = index.has(i, q[:, i])
        one = (one & has) | (zero & ~has)
        zero = zero & has
    return one


def inserted(index: Index, zero: np.ndarray, q: np.ndarray, ends: bool) -> np.ndarray:
    """Words with one code point more; ``ends``: it may stand after the last one."""
    one = np.zeros_like(zero)
    has = index.has(0, q[:, 0]) if q.shape[1] else None
    for i in range(q.shape[1]):
        after = index.has(i + 1, q[:, i]) if i + 1 < index.codes.shape[1] else np.zeros_like(zero)
        one = (one | (zero & ~has)) & after
        zero = zero & has
        if i + 1 < q.shape[1]:
            has = index.has(i + 1, q[:, i + 1])
    return one | zero if ends else one


def deleted(index: Index, zero: np.ndarray, q: np.ndarray, ends: bool) -> np.ndarray:
    """Words with one code point less than the words asked."""
    one = np.zeros_like(zero)
    for i in range(index.codes.shape[1]):
        has = index.has(i, q[:, i])
        one = (one | (zero & ~has)) & index.has(i, q[:, i + 1])
        zero = zero & has
    return one | zero if ends else one


def _found(one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits set in each row, and the lowest of them."""
    count = np.bitwise_count(one).sum(axis=1, dtype=np.int64)
    first = (one != 0).argmax(axis=1)
    word = one[np.arange(len(one)), first]
    return count, first * 64 + np.bitwise_count((word & -word) - np.uint64(1)).astype(np.int64)


def _letters(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length)


def near_in_block(words: list[str], group: np.ndarray, l: int, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(word, near words, best near word)`` as indices, of words with any. ``words``
    stand in the order (group, falling count, word); ``group`` numbers their groups."""
    length = np.array([len(w) for w in words])
    short, long = np.flatnonzero(length == l), np.flatnonzero(length == l + 1)
    if not len(short):
        return
    end = min(b, l)
    parts = [
        _letters([words[i] for i in short], l)[:, a:end],
        _letters([words[i] for i in long], l + 1)[:, a : min(b + 1, l + 1)],
    ]
    alphabet, codes = np.unique(np.concatenate([p.ravel() for p in parts]), return_inverse=True)
    codes = codes.astype(np.int32)
    s = codes[: parts[0].size].reshape(parts[0].shape)
    t = codes[parts[0].size :].reshape(parts[1].shape)
    ends = b == l + 1
    for asked, q, target, kind in ((short, s, short, "replaced"), (short, s, long, "inserted"), (long, t, short, "deleted")):
        if not len(asked) or not len(target) or (kind == "replaced" and len(short) < 2):
            continue
        index = Index(s if target is short else t, len(alphabet))
        step = max(1, (1 << 16) // index.words64)
        for x in range(0, len(asked), step):
            who, rows = asked[x : x + step], q[x : x + step]
            own, at = np.unique(group[who], return_inverse=True)
            zero = index.bits(own[:, None] == group[target][None, :])[at]
            if kind == "replaced":
                one = replaced(index, zero, rows)
            else:
                one = inserted(index, zero, rows, ends) if kind == "inserted" else deleted(index, zero, rows, ends)
            count, best = _found(one)
            hit = np.flatnonzero(count)
            yield who[hit], count[hit], target[best[hit]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows in whole groups, with the groups' numbers: groups of one window together, up
    to ``BLOCK`` rows and ``CELLS`` letters; a larger group stands alone."""

    def complete(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """``starts``: the first row of each group and the end of the last."""
        l, a, b = (rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in "lab")
        i = 0
        while i + 1 < len(starts):
            x, j = int(starts[i]), i + 1
            limit = min(BLOCK, max(1, CELLS // int(b[x] - a[x])))
            while j + 1 < len(starts) and starts[j + 1] - x <= limit and (l[starts[j]], a[starts[j]], b[starts[j]]) == (l[x], a[x], b[x]):
                j += 1
            yield rows.slice(x, int(starts[j]) - x), np.repeat(np.arange(j - i), np.diff(starts[i : j + 1]))
            i = j

    rest = None
    for batch in batches:
        rows = batch if rest is None else pa.concat_batches([rest, batch])
        if rows.num_rows:
            starts = np.flatnonzero(_changes(rows))
            yield from complete(rows.slice(0, int(starts[-1])), starts)
            rest = rows.slice(int(starts[-1]))
    if rest is not None and rest.num_rows:
        yield from complete(rest, np.array([0, rest.num_rows]))


def _changes(rows: pa.RecordBatch) -> np.ndarray:
    """True at the first row of each group."""
    out = np.zeros(rows.num_rows, bool)
    out[0] = True
    for c in _KEYS:
        column = rows.column(rows.schema.get_field_index(c))
        out[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return out


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, group in _blocks(batches):
        if rows.num_rows > 1:
            words = rows.column(0).to_pylist()
            l, a, b = (rows.column(rows.schema.get_field_index(c))[0].as_py() for c in "lab")
            for who, count, best in near_in_block(words, group, l, a, b):
                word, n = rows.column(0), rows.column(1)
                columns = [word.take(pa.array(who)), pa.array(count), word.take(pa.array(best)), n.take(pa.array(best))]
                yield pa.RecordBatch.from_arrays(columns, ["word", "count", "best", "best_n"])


def near_words(words: DataFrame, scratch: Scratch, group: int = GROUP) -> DataFrame:
    """``word, n_near, best, best_n`` of the words that have a near word: how many, and
    the most frequent of them (ties: the smallest in code-point order)."""
    let_import(words.sparkSession)
    entries = grouped(words, scratch, group).repartition(*_KEYS).sortWithinPartitions(*_KEYS, F.desc("n"), "word")
    found = entries.mapInArrow(_near, "word string, count long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("count").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n"))


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, root`` of ``word, form``: each round takes the root of the root, so chains
    shorten by half (counts rise along a chain, so there are no rings)."""
    at = scratch.write(links.select("word", F.col("form").alias("root")), "roots-0")
    k = 0
    while True:
        k += 1
        up = at.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        moved = scratch.write(at.join(up, "root", "left").select("word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")), f"roots-{k}")
        at = moved.drop("_moved")
        scratch.drop(f"roots-{k - 1}")
        if moved.where("_moved").isEmpty():
            return at


def variants(words: DataFrame, scratch: Scratch, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``word, n`` (a word once)."""
    near = near_words(words, scratch, group)
    has_form = F.col("best_n") >= ratio * F.col("n")
    out = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, F.col("best")).alias("form"),
        F.when(has_form, F.col("best_n")).alias("form_n"),
    )
    out = scratch.write(out, "forms")
    root = roots(out.where("form is not null").select("word", "form"), scratch)
    return out.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    words = scratch.write(word_counts(documents(spark, sf_dir)), "words")
    return variants(words, scratch)


#: The crc32 of all runs is taken byte by byte, all runs in step.
OP12_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS i))),
occ AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
        FROM documents),
runs AS (SELECT doc_id, run, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM occ WHERE length(run) >= 6 GROUP BY ALL),
crc AS (
  SELECT doc_id, run, c, x, 4294967295::BIGINT AS s FROM runs
  UNION ALL
  SELECT doc_id, run, c, substr(x, 3), xor(s >> 8, t[(xor(s, ('0x' || substr(x, 1, 2))::BIGINT) & 255) + 1]) FROM crc, tab WHERE x <> ''),
h AS (SELECT run, c, xor(s, 4294967295) AS h FROM crc WHERE x = ''),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
w AS (SELECT word, sum(c)::BIGINT AS n FROM cut GROUP BY word HAVING length(word) >= 6 AND sum(c) >= 5),
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM v a JOIN v b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT v.word, w.word, w.n FROM v JOIN w ON v.d = w.word
  UNION
  SELECT w.word, v.word, v.n FROM v JOIN w ON v.d = w.word),
near AS (SELECT word, count(*)::BIGINT AS n_near, max(near_n) AS best_n FROM pairs GROUP BY word),
best AS (SELECT p.word, min(near) AS best FROM pairs p JOIN near b ON p.word = b.word AND p.near_n = b.best_n GROUP BY p.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form,
             CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n
      FROM w LEFT JOIN near USING (word) LEFT JOIN best USING (word)),
up AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL
       UNION ALL SELECT up.word, f.form FROM up JOIN f ON up.at = f.word WHERE f.form IS NOT NULL),
r AS (SELECT up.word, up.at AS root FROM up JOIN f ON up.at = f.word WHERE f.form IS NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN r USING (word)
"""

QUERIES = {"op12_spelling": op12_spelling}
ORACLES = {"op12_spelling": OP12_SQL}
