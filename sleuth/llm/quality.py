"""Quality scores from random Fourier features of document statistics.

Each whole text is reduced to ``STATISTICS`` (one pass of the texts; what follows reads
the small table of statistics only). Statistics are centred and scaled by their mean
and deviation over all documents and held to ``CLIP`` deviations. ``FEATURES`` random
Fourier features approximate a Gaussian kernel of them; the normal equations of ridge
regression are summed within partitions and then over partitions, in two levels and in
partition order, so that no task or driver holds more than a few matrices of FEATURES x
FEATURES. Isotonic regression on a fold of its own turns raw scores into shares of good
documents: rows are counted on a grid of raw scores (``GRID`` cells a unit, so the
table is bounded), pooled to a rising curve, and read by interpolation.

All labelled rows of the folds that may be learned from take part: four fifths of
them in the regression, a fifth in the calibration.

Defined results: null, empty or blank text has all statistics 0 and is scored like
any other; repeated rows learn each time; a document with several labels counts as
the lowest; a null id has no label and is held out; without labels every score is
0.5, with labels of one kind only it is that label; an empty table gives no rows; only
the id and the text are read, so other columns never clash. Texts go through Python
in chunks of about 1 MB; a longer text stands alone, at some 60 bytes of memory for
each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuth.session import let_import

from .common import Scratch, documents, table

FEATURES = 512
WIDTH = 3.0  # of the kernel, in deviations
RIDGE = 1e-4  # of a row's weight
CLIP = 6.0
GRID = 512  # cells of the calibration's table in a unit of raw score
RANGE = (-1.0, 2.0)  # raw scores beyond are counted at its ends
SEED = 20
THRESHOLD = 0.3

STATISTICS = (
    "words",  # logarithm
    "lines",
    "word_length",
    "words_per_line",
    "capitals",  # share of letters
    "capital_words",  # share of words without a small letter
    "digits",  # share of characters
    "marks",  # share of characters: neither letter, digit nor space
    "symbols",  # share of characters: ASCII marks other than .,;:'"()-!?
    "mark_kinds",
    "alone",  # share of words without letter or digit
    "doubled",  # share of words that end in two equal marks
    "tripled",  # in three
    "beyond_ascii",
    "repeats",  # share of words equal to the word before
    "repeat_run",  # logarithm of the longest run of one word
    "distinct",  # share of words, of 200
    "commonest",  # share of the commonest word
    "same_lines",  # share of lines equal to an earlier one
    "capital_count",  # logarithms of counts, for texts with some such words only
    "symbol_count",
    "doubled_count",
    "alone_count",
    "repeat_count",
)
_DIM = len(STATISTICS)

# ---- classes of bytes ----
_SMALL, _LARGE, _DIGIT, _MARK, _SYMBOL, _BLANK, _LEAD = (np.zeros(256, bool) for _ in range(7))
_SMALL[97:123] = True
_LARGE[65:91] = True
_DIGIT[48:58] = True
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_MARK[33:127] = True
_MARK &= ~(_SMALL | _LARGE | _DIGIT)
_SYMBOL |= _MARK
_SYMBOL[[ord(c) for c in ".,;:'\"()-!?"]] = False
_LEAD[:128] = _LEAD[192:] = True


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` a text (an array from ``as_strings``, sliced)."""
    from .words import _offsets, mix, words_of

    batch = words_of(texts)
    n_docs = len(texts)
    out = np.zeros((n_docs, _DIM))
    if not len(batch.start):
        return out
    offsets = _offsets(texts)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]

    def total(member: np.ndarray) -> np.ndarray:
        """Prefix sums of a class of bytes."""
        sums = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(member, out=sums[1:])
        return sums

    def per_doc(sums: np.ndarray) -> np.ndarray:
        return np.diff(sums[bounds]).astype(float)

    first = batch.first
    n_words = np.diff(first).astype(float)
    words_, owner = np.maximum(n_words, 1), np.repeat(np.arange(n_docs), np.diff(first))

    def words_with(member: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=member, minlength=n_docs)

    small, large, digit, mark, lead = (total(c[raw]) for c in (_SMALL, _LARGE, _DIGIT, _MARK, _LEAD))
    blank = total(_BLANK[raw])
    n_chars = np.maximum(per_doc(lead) - per_doc(blank), 1)
    wide = total(raw >= 192)

    def in_words(sums: np.ndarray) -> np.ndarray:
        return sums[batch.end] - sums[batch.start]

    letters = in_words(small) + in_words(large) + in_words(wide)
    shouted = (in_words(large) > 1) & (in_words(small) == 0) & (in_words(wide) * 2 <= in_words(large))
    alone = (letters == 0) & (in_words(digit) == 0)
    last, size = raw[batch.end - 1], batch.end - batch.start
    second, third = raw[np.maximum(batch.end - 2, 0)], raw[np.maximum(batch.end - 3, 0)]
    doubled = (size > 2) & _MARK[last] & (last == second)
    tripled = doubled & (size > 3) & (second == third)
    again = np.zeros(len(owner), bool)
    again[1:] = (batch.hash[1:] == batch.hash[:-1]) & (owner[1:] == owner[:-1])
    run_start = np.flatnonzero(~again)
    run_size = np.diff(np.append(run_start, len(owner)))
    longest = np.zeros(n_docs)
    np.maximum.at(longest, owner[run_start], run_size)
    # words of the first, second, ... 200 of a text, so that long texts have a like share
    order = np.lexsort((batch.hash, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (batch.hash[order][1:] != batch.hash[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    kinds = np.flatnonzero(fresh)
    often = np.zeros(n_docs)
    np.maximum.at(often, owner[order][kinds], np.diff(np.append(kinds, len(order))))
    place = np.arange(len(owner)) - first[owner]
    block = (owner.astype(np.uint64) << np.uint64(32)) | (place // 200).astype(np.uint64)
    in_block = mix(mix(block) ^ batch.hash)
    distinct = np.zeros(n_docs)
    np.add.at(distinct, owner[np.unique(in_block, return_index=True)[1]], 1)
    # lines with a word: a line's words are those up to the next one that follows a break
    breaks = total(raw == 10)
    new_line = np.ones(len(owner), bool)
    new_line[1:] = (breaks[batch.start[1:]] != breaks[batch.start[:-1]]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new_line)
    in_line = np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))
    line_hash = np.add.reduceat(mix(batch.hash + in_line.astype(np.uint64)), begin)
    line_owner = owner[begin]
    n_lines = np.bincount(line_owner, minlength=n_docs).astype(float)
    unlike = np.unique(mix(line_hash) ^ mix(line_owner.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    n_unlike = np.bincount(line_owner[unlike], minlength=n_docs)

    n_letters = np.maximum(per_doc(small) + per_doc(large) + per_doc(wide), 1)
    symbols = per_doc(total(_SYMBOL[raw]))
    mark_kinds = np.zeros(n_docs)
    for code in np.flatnonzero(_MARK):
        if (raw == code).any():
            mark_kinds += per_doc(total(raw == code)) > 0
    share = np.sqrt  # small shares count: a text may be bad in a few lines only
    columns = (
        np.log1p(n_words),
        np.log1p(n_lines),
        np.bincount(owner, weights=in_words(lead), minlength=n_docs) / words_,
        np.log1p(n_words / np.maximum(n_lines, 1)),
        share(per_doc(large) / n_letters),
        share(words_with(shouted) / words_),
        share(per_doc(digit) / n_chars),
        share(per_doc(mark) / n_chars),
        share(symbols / n_chars),
        mark_kinds,
        share(words_with(alone) / words_),
        share(words_with(doubled) / words_),
        share(words_with(tripled) / words_),
        share(per_doc(wide) / n_chars),
        share(words_with(again) / words_),
        np.log1p(longest),
        distinct / words_,
        share(often / words_),
        share((n_lines - n_unlike) / np.maximum(n_lines, 1)),
        np.log1p(words_with(shouted)),
        np.log1p(symbols),
        np.log1p(words_with(doubled)),
        np.log1p(words_with(alone)),
        np.log1p(words_with(again)),
    )
    out[:] = np.stack(columns, axis=1)
    out[n_words == 0] = 0.0
    return out


def _lists(rows: np.ndarray) -> pa.Array:
    """A two-dimensional array as a list column."""
    offsets = pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), pa.float64()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .words import as_strings, text_chunks

    for batch in batches:
        texts = as_strings(batch.column(0))
        for i, j in text_chunks(texts, 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), _lists(statistics(texts.slice(i, j - i)))], ["doc_id", "s"])


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, s``: the statistics of every whole text."""
    let_import(docs.sparkSession)
    return docs.select(F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id")).mapInArrow(_measure, "doc_id long, s array<double>")


# ---- the model ----
class Model(NamedTuple):
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # of the features, the constant last; empty: no regression
    at: np.ndarray  # raw scores and their calibrated shares
    share: np.ndarray


def projection(dim: int = _DIM, features: int = FEATURES, width: float = WIDTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Directions and phases of the random features."""
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, 1.0 / width, (dim, features)), rng.uniform(0.0, 2 * np.pi, features)


def fourier(s: np.ndarray, mean: np.ndarray, spread: np.ndarray, drawn: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Random Fourier features of statistics, and a constant."""
    x = np.clip((s - mean) / spread, -CLIP, CLIP)
    directions, phases = drawn
    z = np.cos(x @ directions + phases) * np.sqrt(2.0 / len(phases))
    return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def _partial_sums(mean: np.ndarray, spread: np.ndarray, features: int):
    """One row a partition: the sums of z z', z y and rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        drawn = projection(len(mean), features)
        total = np.zeros((features + 1, features + 2))
        rows = 0
        for batch in batches:
            s, y = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            for i in range(0, len(s), 4096):
                z = fourier(s[i : i + 4096], mean, spread, drawn)
                total[:, :-1] += z.T @ z
                total[:, -1] += z.T @ y[i : i + 4096]
                rows += len(z)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, part = None, 0
    for batch in batches:
        for p, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            value = np.frombuffer(sums.as_buffer(), np.float64)
            total, part = (value.copy(), p) if total is None else (total + value, part)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])


def normal_equations(rows: DataFrame, mean: np.ndarray, spread: np.ndarray, scratch: Scratch, features: int = FEATURES) -> np.ndarray | None:
    """``rows``: ``s, y``. Sums over all rows, added in partition order by about the
    square root of the partitions' number of tasks, and then by one."""
    parts = scratch.write(rows.select("s", F.col("y").cast("double").alias("y")).mapInArrow(_partial_sums(mean, spread, features), "part int, sums binary"), "sums")
    n = parts.count()
    if not n:
        return None
    groups = max(1, int(np.sqrt(n)))
    some = parts.repartitionByRange(groups, "part").sortWithinPartitions("part").mapInArrow(_add, "part int, sums binary")
    row = some.repartition(1).sortWithinPartitions("part").mapInArrow(_add, "part int, sums binary").first()
    return np.frombuffer(row["sums"], np.float64).reshape(features + 1, features + 2)


def pooled(at: np.ndarray, good: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling neighbours: ``(raw score, share)`` of the pools.
    ``at`` rises; ``good`` of ``rows`` at each have the label 1."""
    pools: list[list[float]] = []
    for x, g, n in zip(at.tolist(), good.tolist(), rows.tolist(), strict=True):
        pools.append([x * n, g, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([x / n for x, _, n in pools]), np.array([g / n for _, g, n in pools])


def raw_scores(s: np.ndarray, model: Model, drawn: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return fourier(s, model.mean, model.spread, drawn) @ model.weights


def calibrated(raw: np.ndarray, model: Model) -> np.ndarray:
    return np.interp(raw, model.at, model.share)


def _cells(model: Model):
    """Raw scores as cells of the grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = projection(len(model.mean), len(model.weights) - 1)
        for batch in batches:
            raw = raw_scores(_matrix(batch.column(0)), model, drawn)
            cell = np.round(np.clip(raw, *RANGE) * GRID).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(1)], ["cell", "y"])

    return run


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = projection(len(model.mean), len(model.weights) - 1) if len(model.weights) else None
        for batch in batches:
            if drawn is None:
                score = np.full(batch.num_rows, model.share[0])
            else:
                score = calibrated(raw_scores(_matrix(batch.column(1)), model, drawn), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def quality_fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; 0 is the held-out fold, 1 the calibration's."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)).cast("int")


def train(stats: DataFrame, labels: DataFrame, scratch: Scratch, features: int = FEATURES) -> Model:
    """``stats`` (``doc_id, s``) of all documents, ``labels`` (``doc_id, quality``)."""
    let_import(stats.sparkSession)
    moments = stats.select(F.posexplode("s")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("d")).collect()  # a row a statistic
    mean, spread = np.zeros(_DIM), np.ones(_DIM)
    for r in moments:
        mean[r["pos"]], spread[r["pos"]] = r["m"], max(r["d"], 1e-6)
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    known = known.withColumn("fold", quality_fold(F.col("doc_id"))).where("fold <> 0")
    rows = scratch.write(stats.join(known, "doc_id").select("s", F.col("y").cast("int").alias("y"), "fold"), "labelled")
    kinds = {(r["fold"] == 1, r["y"]): r["n"] for r in rows.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = {y for _, y in kinds}
    none = np.zeros(0)
    if len(found) < 2:
        return Model(mean, spread, none, none, np.array([float(found.pop()) if found else 0.5]))
    learn = rows.where("fold <> 1") if {y for c, y in kinds if not c} == found else rows
    check = rows.where("fold = 1") if {y for c, y in kinds if c} == found else rows
    sums = normal_equations(learn, mean, spread, scratch, features)
    n = sums[-1, -2]  # the constant's square, summed
    ridge = np.full(features + 1, RIDGE * n)
    ridge[-1] = 0.0
    weights = np.linalg.solve(sums[:, :-1] + np.diag(ridge), sums[:, -1])
    model = Model(mean, spread, weights, none, none)
    cells = check.select("s", "y").mapInArrow(_cells(model), "cell long, y int").groupBy("cell").agg(F.sum("y").alias("good"), F.count(F.lit(1)).alias("n"))
    table_ = sorted((r["cell"], r["good"], r["n"]) for r in cells.collect())  # cells of the grid
    cell, good, count = (np.array(c, float) for c in zip(*table_, strict=True))
    at, share = pooled(cell / GRID, good, count)
    return model._replace(at=at, share=share)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row of ``doc_id, s``."""
    let_import(stats.sparkSession)
    return stats.select("doc_id", "s").mapInArrow(_scores(model), "doc_id long, score double")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    stats = scratch.write(measured(documents(spark, sf_dir)), "statistics")
    out = score(stats, train(stats, table(spark, sf_dir, "labels"), scratch))
    return out.select(
        "doc_id",
        F.coalesce(quality_fold(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op13_quality": op13_quality}
ORACLES: dict[str, str] = {}
