"""Toxicity of deobfuscated text.

Noisy channel: a writer may replace letters by look-alikes, set letters apart,
or repeat them. Every token in which that may have happened becomes a lattice of
the letters each character may stand for, and Viterbi decoding finds its most
likely reading under a character trigram model of the corpus, where each kind
of change costs. The model counts the letters of all texts; a text is scored with
the readings beside it, so nothing is lost by a wrong one.

Score: hashed words, their beginnings and letter 4- and 5-grams (with word
bounds) are set features of the restored text. Those that mark toxic rows beyond chance, in a
bounded sample of the labelled rows that are not held out, get log-odds
weights; a logistic curve, fitted on the same rows, turns the largest of a text's
weights and their sum into the score.

Defined results: null or empty text has no features and gets the score of a text
without any; the same holds for all texts if there are no labels to learn from;
rows with the same id count each (a label holds for all of them; contradicting
labels count as toxic); an empty table gives no rows; only id, text and labels
are read, so other columns never clash.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, held_out, let_import, table

THRESHOLD = 0.7
PER_CLASS = (4000, 8000)  # toxic and other rows to learn from, about
BUCKETS = 1 << 22  # of feature hashes
PREFIXES = (6, 7)  # bytes of the beginnings of words that are features
MIN_ROWS = 4  # toxic sample rows that must have a feature
MIN_GAIN = 12.0  # log-likelihood ratio beyond which a feature counts
MAX_FEATURES = 20_000  # best features kept in the model

#: What a character may stand for in a word.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y",
    "*": "aeiou", "#": "h", "%": "", "^": "", "_": "", "-": "", ".": "", "~": "", "'": "", " ": "",
}
COST_LOOKALIKE, COST_DROP, COST_REPEAT = 0.7, 0.4, 0.3
COST_KEEP = 9.0  # a character that is no letter is left as it is

# ---- the character model ----
_LATIN = range(0xDF, 0x100)
LETTERS = 1 + 26 + len(_LATIN) + 1  # word bound, a-z, Latin-1 letters, any other letter
_OTHER = LETTERS - 1


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x250):
        if chr(c).isalpha():
            out[c] = _OTHER
    out[0x250:0xE000] = out[0xF900:0xFE00] = out[0x10000:0x14000] = _OTHER
    for k in range(26):
        out[ord("a") + k] = 1 + k
    for k, c in enumerate(_LATIN):
        out[c] = 27 + k
    return out


def letter_class(c: str) -> int:
    return int(_classes()[ord(c)])


def count_letters(texts: list[str]) -> np.ndarray:
    """Counts of letter-class trigrams; words begin and end with the bound twice."""
    joined = "  ".join(["", *texts, ""]).lower().encode("utf-32-le", "surrogatepass")
    c = _classes()[np.frombuffer(joined, "<u4")].astype(np.int32)
    bound = c == 0
    # single bounds are doubled, longer runs of them cut to two
    reps = np.ones(len(c), np.int64)
    before = np.concatenate([[False], bound[:-1]])
    reps[bound & before] = 0
    reps[bound & ~before] = 2
    c = np.repeat(c, reps)
    code = (c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:]
    return np.bincount(code, minlength=LETTERS**3)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .words import as_strings, text_chunks

    total = np.zeros(LETTERS**3, np.int64)
    for batch in batches:
        texts = as_strings(batch.column(0))
        for i, j in text_chunks(texts):
            total += count_letters(texts.slice(i, j - i).to_pylist())
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["code", "n"])


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-probability of a letter after two others, from all texts: a table of
    ``LETTERS`` cubed whatever the corpus."""
    counts = docs.select(text).mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(LETTERS**3)
    for r in counts:
        total[r["code"]] = r["n"]
    return smoothed(total)


def smoothed(total: np.ndarray) -> np.ndarray:
    three = total.reshape(LETTERS, LETTERS, LETTERS)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 0.5) / (one.sum() + 0.5 * LETTERS)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


# ---- decoding ----
_WITHIN = b"0123456789@$!|+*#(<%^~_.'-"  # between letters
_OUTER = b"0123456789@$!|+("  # at either end of a token
_SYMBOL, _END_SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(_WITHIN)] = _END_SYMBOL[list(_OUTER)] = True
_EDGE = "\"`,;:?)]}>([{<"  # marks around a token that are no part of it
_DIGITS = "0123456789@$|+#€£¥"  # may stand for a letter among letters set apart
_ALONE = "!(<*"  # the same, but only as a token of their own
_DIGIT, _LONE = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[[ord(c) for c in _DIGITS if c < "\x80"]] = _LONE[list(_ALONE.encode())] = True


@functools.lru_cache(maxsize=1)
def _small() -> np.ndarray:
    """Code points in lower case (where that is one code point)."""
    out = np.arange(0x110000, dtype=np.int32)
    for c in range(0x80, 0x1E944):
        if not 0xD800 <= c < 0xE000 and len(low := chr(c).lower()) == 1:
            out[c] = ord(low)
    return out


def beyond_ascii(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks of bytes beyond ASCII of UTF-8 text: the currency signs of ``LOOKALIKES``,
    marks (signs of Latin-1, general punctuation), and the first byte of a letter that
    two equal ones precede directly."""
    sign, mark, third = (np.zeros(len(raw), bool) for _ in range(3))
    at = np.flatnonzero(raw >= 0xC0)
    if not len(at):
        return sign, mark, third
    lead = raw[at].astype(np.int32)
    width = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    tail = [raw[np.minimum(at + k, len(raw) - 1)].astype(np.int32) & 63 for k in (1, 2, 3)]
    two, three = ((lead & 31) << 6) | tail[0], ((lead & 15) << 12) | (tail[0] << 6) | tail[1]
    four = ((lead & 7) << 18) | (tail[0] << 12) | (tail[1] << 6) | tail[2]
    point = np.minimum(np.where(width == 2, two, np.where(width == 3, three, four)), 0x10FFFF)
    signs = np.isin(point, [ord(c) for c in _DIGITS if c >= "\x80"])
    marks = ~signs & ((point < 0xC0) & ~np.isin(point, [0xAA, 0xB5, 0xBA]) | (point >= 0x2010) & (point < 0x2070))
    for k in range(3):
        for out, which in ((sign, signs), (mark, marks)):
            out[at[which & (width > k)] + k] = True
    point = _small()[point]
    again = (at[1:] == at[:-1] + width[:-1]) & (point[1:] == point[:-1]) & ~signs[1:] & ~marks[1:]
    third[at[2:][again[1:] & again[:-1]]] = True
    return sign, mark, third


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of a character, its readings and their costs."""
    out, i = [], 0
    while i < len(token):
        c, j = token[i], i + 1
        while j < len(token) and token[j] == c:
            j += 1
        run = j - i
        if c.isalpha():
            keep = [(c * min(run, 2), 0.0)] if run <= 2 else [(c, COST_REPEAT), (c * 2, COST_REPEAT)]
        else:
            stands = LOOKALIKES.get(c, "")
            keep = [(x * n, COST_LOOKALIKE * run) for x in stands for n in ((1,) if run == 1 else (1, 2))]
            keep.append(("", COST_DROP if c in LOOKALIKES and not stands else COST_KEEP))
        out.append(keep)
        i = j
    return out


def decode(token: str, model: np.ndarray) -> str:
    """The most likely reading of a token (Viterbi over pairs of letters)."""
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for readings in lattice(token):
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, text) in best.items():
            for letters, price in readings:
                x, y, total = a, b, cost + price
                for c in letters:
                    z = letter_class(c)
                    total -= float(model[x, y, z])
                    x, y = y, z
                old = after.get((x, y))
                if old is None or total < old[0]:
                    after[x, y] = (total, text + letters)
        best = after
    return min((cost - float(model[a, b, 0]), text) for (a, b), (cost, text) in best.items())[1]


class Restorer:
    """Readings of suspect tokens; frequent ones are remembered, up to a bound."""

    def __init__(self, model: np.ndarray):
        self.read = functools.lru_cache(maxsize=100_000)(lambda token: decode(token, model))

    def readings(self, text: str) -> str:
        """Readings of one text's suspect tokens, joined with spaces."""
        return self.of_chunk(pa.array([text], pa.large_string()))[0]

    def of_chunk(self, texts: pa.Array) -> list[str]:
        """The same for every text of a chunk: suspects are found on its bytes."""
        from .words import _offsets, words_of

        out: list[list[str]] = [[] for _ in range(len(texts))]
        w = words_of(texts)
        if not len(w.start):
            return [""] * len(texts)
        offsets = _offsets(texts)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        low = lowered(raw)
        sign, other, third = beyond_ascii(raw)
        letter = is_letter(low) & ~sign
        symbol = _SYMBOL[raw] | sign
        n = len(raw)
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        first[w.start], last[w.end - 1] = True, True
        mark = np.zeros(n, bool)
        mark[1:-1] = symbol[1:-1] & (letter[:-2] | symbol[:-2]) & (letter[2:] | symbol[2:]) & ~first[1:-1] & ~last[1:-1]
        outer = _END_SYMBOL[raw]
        mark[:-1] |= outer[:-1] & first[:-1] & letter[1:]
        mark[1:] |= outer[1:] & last[1:] & letter[:-1] & (raw[1:] != ord("!"))
        mark[2:] |= letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & (raw[2:] < 128)
        mark |= third
        tokens = np.unique(np.searchsorted(w.start, np.flatnonzero(mark), side="right") - 1)
        letters = np.concatenate([[0], np.cumsum(letter)])
        has = letters[w.end[tokens]] - letters[w.start[tokens]]
        row = np.searchsorted(w.first, tokens, side="right") - 1
        for t, r, some in zip(tokens.tolist(), row.tolist(), has.tolist(), strict=True):
            if some:
                token = raw[w.start[t] : w.end[t]].tobytes().decode("utf-8", "surrogatepass").lower().strip(_EDGE).rstrip(".!")
                self._add(out[r], token)
        # letters set apart: three or more in tokens in a row in which, but for marks, none
        # stands directly beside another; digits and symbols may stand for letters
        solid = letter & ~other | _DIGIT[raw] | sign
        alone = w.start[(w.end - w.start == 1) & _LONE[raw[w.start]]]
        solid[alone] = True
        begins = solid & ((raw < 128) | (raw >= 0xC0))  # of characters
        beside = np.zeros(n, bool)
        beside[1:] = begins[1:] & solid[:-1] & ~first[1:]
        per = lambda m: (lambda total: total[w.end] - total[w.start])(np.concatenate([[0], np.cumsum(m)]))
        units, true = per(begins), per(begins & letter)
        single = ((units > 0) | (w.end - w.start == 1)) & (per(beside) == 0)  # a mark alone may stand between
        runs = np.flatnonzero(np.diff(np.concatenate([[False], single, [False]]).astype(np.int8)))
        for a, b in zip(runs[::2].tolist(), runs[1::2].tolist(), strict=True):
            if b - a >= 2 and units[a:b].sum() >= 3 and true[a:b].any():
                for r in range(int(np.searchsorted(w.first, a, side="right")) - 1, int(np.searchsorted(w.first, b - 1, side="right"))):
                    x, y = max(a, int(w.first[r])), min(b, int(w.first[r + 1]))
                    if y - x >= 2 and units[x:y].sum() >= 3 and true[x:y].any():
                        tokens_ = [raw[w.start[t] : w.end[t]].tobytes().decode("utf-8", "surrogatepass").lower() for t in range(x, y)]
                        out[r].append(self.read(" ".join(c for t in tokens_ for c in t if c.isalpha() or c in _DIGITS or t in _ALONE)))
        return [" ".join(x) for x in out]

    def _add(self, out: list[str], token: str) -> None:
        reading = self.read(token) if token else ""
        if reading and reading != token:
            out.append(reading)


# ---- features ----
def lowered(raw: np.ndarray) -> np.ndarray:
    """Bytes of UTF-8 text with A-Z and the capitals of Latin-1 in lower case."""
    from .words import _LOWER

    low = _LOWER[raw]
    after = np.flatnonzero(raw[:-1] == 0xC3) + 1 if len(raw) else np.zeros(0, np.int64)
    after = after[(raw[after] >= 0x80) & (raw[after] <= 0x9E) & (raw[after] != 0x97)]
    low[after] += 0x20
    return low


def is_letter(low: np.ndarray) -> np.ndarray:
    """Letters are a-z and all bytes beyond ASCII; the rest counts as a word bound."""
    return ((low >= 97) & (low <= 122)) | (low >= 128)


def _hashed(value: np.ndarray, salt: int) -> np.ndarray:
    value = (value ^ np.uint32(salt * 0x632BE5AB & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
    return ((value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(buckets, rows)`` of the features of texts, kind by kind, with repeats."""
    from .words import _offsets

    offsets = _offsets(texts)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    low = lowered(raw)
    low = np.where(is_letter(low), low, 0).astype(np.uint8)
    low = np.insert(low, np.stack([bounds[:-1], bounds[1:]], axis=1).reshape(-1), 0)  # a bound before and after each text
    low = np.append(low, np.zeros(max(8, max(PREFIXES)), np.uint8))
    ends = bounds[1:] + 2 * np.arange(1, len(texts) + 1)  # of texts with their bounds

    def row(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(ends, at, side="right")

    wide = low.astype(np.uint32)
    solid = low != 0
    inner = solid[1:-2] & solid[2:-1]
    four = (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]
    at = np.flatnonzero(inner)  # bounds may stand first or last in an n-gram, but not inside
    yield _hashed(four[at], 4), row(at)
    at = np.flatnonzero(inner[:-1] & solid[3:-1])
    yield _hashed(four[at] * np.uint32(0x01000193) + wide[at + 4], 5), row(at)
    start = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    if not len(start):
        return
    # whole words: sums of hashed (letter, place) pairs from one bound to the next
    place = (np.arange(len(low)) - np.repeat(np.append(0, start), np.diff(np.concatenate([[0], start, [len(low)]])))).astype(np.uint32)
    term = (wide + (place << np.uint32(8))) * np.uint32(0xC2B2AE3D)
    term = np.where(solid, (term ^ (term >> np.uint32(13))) * np.uint32(0x27D4EB2F), np.uint32(0))
    rows = row(start)
    yield _hashed(np.add.reduceat(term, start, dtype=np.uint32), 1), rows
    head, own = np.zeros(len(start), np.uint32), np.ones(len(start), bool)  # beginnings of words
    for k in range(max(PREFIXES)):
        byte = wide[start + k]
        own &= byte != 0
        head = head * np.uint32(0x01000193) + byte
        if k + 1 in PREFIXES:
            yield _hashed(head[own], 10 + k), rows[own]


class Model(NamedTuple):
    letters: np.ndarray
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    curve: tuple[float, float, float]  # of the largest weight, of the weights' sum, constant


def pairs_of(texts: pa.Array, restorer: Restorer, weights: np.ndarray | None = None) -> np.ndarray:
    """Distinct ``row * BUCKETS + bucket`` of the texts and of their suspects'
    readings; with weights, of weighted features only."""
    found = []
    for part in (texts, pa.array(restorer.of_chunk(texts), pa.large_string())):
        for bucket, row in features(part):
            bucket = bucket.astype(np.int64)
            if weights is not None:
                hit = np.flatnonzero(weights[bucket])
                bucket, row = bucket[hit], row[hit]
            found.append(row * BUCKETS + bucket)
    return np.unique(np.concatenate(found))


def totals(texts: pa.Array, restorer: Restorer, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest weight among each restored text's features, and the logarithm of
    1 + the sum over its distinct ones."""
    pair = pairs_of(texts, restorer, weights)
    row, found = pair // BUCKETS, weights[pair % BUCKETS]
    most = np.zeros(len(texts))
    np.maximum.at(most, row, found)
    return most, np.log1p(np.bincount(row, weights=found, minlength=len(texts)))


def _train(letters: np.ndarray):
    """Rows of the sample that have each feature, by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .words import as_strings, text_chunks

        restorer = Restorer(letters)
        for batch in batches:
            texts, toxic = as_strings(batch.column(0)), np.array(batch.column(1).to_pylist(), np.int64)
            for i, j in text_chunks(texts, 4 << 20):
                pair = pairs_of(texts.slice(i, j - i), restorer)
                bucket, label = pair % BUCKETS, toxic[i:j][pair // BUCKETS]
                found, at = np.unique(bucket, return_inverse=True)
                yes = np.bincount(at, weights=label, minlength=len(found)).astype(np.int64)
                every = np.bincount(at, minlength=len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(yes), pa.array(every - yes)], ["bucket", "toxic", "clean"])

    return run


def _dense(buckets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(BUCKETS, np.float32)
    out[buckets] = weights
    return out


def _sums(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .words import as_strings, text_chunks

        restorer, weights = Restorer(model.letters), _dense(model.buckets, model.weights)
        for batch in batches:
            texts = as_strings(batch.column(0))
            for i, j in text_chunks(texts, 1 << 20):
                most, total = totals(texts.slice(i, j - i), restorer, weights)
                columns = [batch.column(1).slice(i, j - i), pa.array(most, pa.float64()), pa.array(total, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names[1:] + ["most", "total"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients (the constant last) by Newton steps, lightly regularised."""
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    a = np.concatenate([(x - middle) / spread, np.ones((len(x), 1))], axis=1)
    ridge = np.diag([1.0] * x.shape[1] + [1e-3])

    def loss(b: np.ndarray) -> float:
        z = a @ b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * b @ ridge @ b)

    b = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (p - y)) + ridge @ b)
        size = 1.0
        while size > 1e-4 and loss(b - size * step) > loss(b):
            size /= 2
        b = b - size * step
    slopes = b[:-1] / spread
    return np.append(slopes, b[-1] - slopes @ middle)


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, text: str = "text", doc_id: str = "doc_id", learnable: Column | None = None) -> Model:
    """Learn from a bounded sample of labelled rows where ``learnable`` holds
    (default: the fold that is not held out)."""
    letters = character_model(docs, text)
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = known.where(~held_out(F.col("doc_id")) if learnable is None else learnable)
    usable = usable.withColumn("h", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)), F.lit(1 << 30)))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = {t: min(1.0, PER_CLASS[0 if t else 1] / n) for t, n in counts.items()}
    if not counts.get(1) or not counts.get(0):
        base = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
        return Model(letters, np.zeros(0, np.int64), np.zeros(0, np.float32), (0.0, 0.0, math.log(base / (1 - base))))
    chosen = usable.where(((F.col("toxic") == 1) & (F.col("h") < int(part[1] * (1 << 30)))) | ((F.col("toxic") == 0) & (F.col("h") < int(part[0] * (1 << 30)))))
    sample = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id").select("text", "toxic")  # PER_CLASS rows, about
    sample = scratch.write(sample.where("text is not null").withColumn("toxic", F.col("toxic").cast("long")), "sample")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = float(n.get(1, 0)) or 0.5, float(n.get(0, 0)) or 0.5
    seen = sample.mapInArrow(_train(letters), "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    odds = F.log((t + 0.5) / (n1 + 1)) - F.log((c + 0.5) / (n0 + 1))
    both = (t + c) / (n1 + n0)
    gain = 2 * (t * F.log(t / (n1 * both)) + F.when(c > 0, c * F.log(c / (n0 * both))).otherwise(0.0))
    best = seen.where((F.col("t") >= MIN_ROWS) & (odds > 1.5) & (gain > MIN_GAIN)).select("bucket", odds.alias("w"), gain.alias("g"))
    rows = sorted((r["bucket"], r["w"]) for r in best.orderBy(F.desc("g"), "bucket").limit(MAX_FEATURES).collect())
    model = Model(letters, np.array([b for b, _ in rows], np.int64), np.array([w for _, w in rows], np.float32), (0.0, 0.0, 0.0))
    found = sample.mapInArrow(_sums(model), "toxic long, most double, total double").collect()  # three numbers a sample row
    x, y = np.array([(r["most"], r["total"]) for r in found]), np.array([r["toxic"] for r in found], np.float64)
    # the sample's rows stand for all labelled rows of their class
    curve = _logistic(x, y, np.where(y == 1, 1 / part[1], 1 / part[0]))
    return model._replace(curve=tuple(map(float, curve)))


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, score`` of every row."""
    let_import(docs.sparkSession)
    rows = docs.select(F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    total = rows.mapInArrow(_sums(model), "doc_id long, most double, total double")
    a, b, c = (F.lit(v) for v in model.curve)
    z = a * F.col("most") + b * F.col("total") + c
    return total.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, table(spark, sf_dir, "labels"), Scratch(spark))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
