"""Language identification in two levels.

A document's features are the relative frequencies of its hashed byte n-grams
(2 to 4 bytes, A-Z lower-cased), each divided by its spread in the training
sample. First, one-versus-rest linear support vector machines choose the family
of languages; then one-versus-one machines separate the languages within it,
and the language with most won duels is predicted. Families come from the table
``FAMILIES``; a language that it lacks is a family of its own.

Training uses a sample of the labelled rows, about ``PER_LANGUAGE`` rows of each
language and ``SAMPLE`` in all, chosen by a hash of the id; one task holds
their feature vectors (``DIMENSIONS`` 4-byte numbers each), and the driver the
machines learned from them. Texts are used whole.

Defined results: a text that is null or has no letter is ``und`` with score 0,
as is any text if nothing could be learned; with one language learned, it is
predicted always; rows with the same id count each; an empty table gives no
rows; only id, text and (to learn) language are read, so others never clash.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import documents, held_out, lean, let_import

DIMENSIONS = 4096
GRAMS = (2, 3, 4)
PER_LANGUAGE = 500
SAMPLE = 5000
UNDETERMINED = "und"
STEEPNESS = 3.0  # of the logistic curve from margins to scores

#: Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
}


class Machine(NamedTuple):
    weights: np.ndarray  # by hashed n-gram, scaled to relative frequencies
    bias: float


class Model(NamedTuple):
    families: list[str]
    members: dict[str, list[str]]
    rest: dict[str, Machine]  # family against the rest
    duels: dict[tuple[str, str], Machine]  # first language (positive) against second


def family_of(language: str) -> str:
    base = language.lower().split("-")[0].split("_")[0]
    return next((f for f, codes in FAMILIES.items() if base in codes), language)


def grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(hashed n-grams, offsets per document)`` for each n-gram size."""
    from .words import _LOWER, _offsets

    offsets = _offsets(texts)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    size = np.diff(bounds)
    low = _LOWER[raw].astype(np.uint32)
    value, shift = low + np.uint32(1), np.uint32(32 - DIMENSIONS.bit_length() + 1)
    for n in range(2, max(GRAMS) + 1):
        value = value[:-1] * np.uint32(0x01000193) + low[n - 1 :] + np.uint32(1) if len(low) >= n else value[:0]
        if n not in GRAMS:
            continue
        inside = np.ones(len(value), bool)
        for k in range(1, n):  # n-grams that would run into the next document
            at = bounds[1:] - k
            at = at[(at >= bounds[:-1]) & (at < len(value))]
            inside[at] = False
        counts = np.maximum(size - n + 1, 0)
        hashed = ((value[inside] + np.uint32(n)) * np.uint32(0x9E3779B1)) >> shift
        yield hashed, np.concatenate([[0], np.cumsum(counts)])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .words import as_strings, text_chunks

    for batch in batches:
        texts = as_strings(batch.column(0))
        for i, j in text_chunks(texts, 1 << 18, 128):
            total = np.zeros((j - i) * DIMENSIONS, np.float32)
            for hashed, offsets in grams(texts.slice(i, j - i)):
                rows = np.repeat(np.arange(j - i), np.diff(offsets))
                total += np.bincount(rows * DIMENSIONS + hashed, minlength=len(total)).astype(np.float32)
            total = total.reshape(j - i, DIMENSIONS)
            total /= np.maximum(total.sum(axis=1, keepdims=True), 1)
            packed = pa.array([x.astype("<f4").tobytes() for x in total], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), packed], ["lang", "x"])


def fit_machine(x: np.ndarray, y: np.ndarray, scale: np.ndarray, strength: float = 1.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, classes weighted alike, by
    accelerated gradient descent, on the rows of ``x`` times ``scale`` and a constant.
    No copy of ``x`` is made."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    weight = (weight * len(y)).astype(x.dtype)

    def forward(w: np.ndarray) -> np.ndarray:
        return x @ (w[:-1] * scale) + w[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.append((r @ x) * scale, r.sum()).astype(x.dtype)

    v = np.ones(x.shape[1] + 1, x.dtype) / np.sqrt(np.float32(x.shape[1] + 1))
    for _ in range(10):  # largest curvature
        v = back(weight * forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = np.float32(1.0 / (2 * norm + strength))
    strength = np.float32(strength)
    w = last = np.zeros(x.shape[1] + 1, x.dtype)
    for k in range(rounds):
        z = w + np.float32(k / (k + 3)) * (w - last)
        slack = np.maximum(1 - y * forward(z), 0)
        last, w = w, z - step * (strength * z - 2 * back(weight * y * slack))
    return w[:-1], float(w[-1])


def hash_of_row(row: np.ndarray) -> int:
    return zlib.crc32(row.tobytes())


def _spread(x: np.ndarray) -> np.ndarray:
    """Standard deviation of each column, without a copy of all."""
    mean = x.mean(axis=0, dtype=np.float64)
    square = np.zeros(x.shape[1])
    for i in range(0, len(x), 256):
        square += ((x[i : i + 256] - mean) ** 2).sum(axis=0)
    return np.sqrt(square / max(len(x), 1))


def learn(labels: list[str], x: np.ndarray) -> Model:
    """Machines from languages and feature vectors (a row each), in any order."""
    marks = [hash_of_row(row) for row in x]
    order = np.array(sorted(range(len(labels)), key=lambda i: (labels[i], marks[i])), np.int64)
    labels = np.array(labels, object)[order]
    x = x[order]
    languages = sorted(set(labels))
    members: dict[str, list[str]] = {}
    for name in languages:
        members.setdefault(family_of(name), []).append(name)
    scale = (1 / (_spread(x) + 1e-5) / np.sqrt(DIMENSIONS)).astype(np.float32) if len(x) else 1.0

    def machine(rows: np.ndarray | slice, positive: np.ndarray) -> Machine:
        w, bias = fit_machine(x[rows], np.where(positive, 1.0, -1.0).astype(np.float32), scale)
        return Machine((w * scale).astype(np.float32), bias)

    family = np.array([family_of(name) for name in labels], object)
    rest = {f: machine(slice(None), family == f) for f in members} if len(members) > 1 else {}
    duels = {}
    for own in members.values():
        for a in range(len(own)):
            for b in range(a + 1, len(own)):
                at = np.flatnonzero((labels == own[a]) | (labels == own[b]))
                duels[own[a], own[b]] = machine(at, labels[at] == own[a])
    return Model(sorted(members), members, rest, duels)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row, the model of all rows ``lang, x``."""
    labels: list[str] = []
    parts = [np.zeros((0, DIMENSIONS), np.float32)]
    for batch in batches:
        labels += batch.column(0).to_pylist()
        parts += [np.frombuffer(value.as_buffer(), "<f4")[None] for value in batch.column(1)]
    x = np.concatenate(parts)
    parts.clear()
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(labels, x))], pa.binary())], ["model"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def predict(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """Languages and scores of a chunk of texts; the score is the family's share
    among the families times the mean share won in the language's duels."""
    n = len(texts)
    machines = [*model.rest.values(), *model.duels.values()]
    margin = np.zeros((n, len(machines)))
    if machines:
        table = np.stack([m.weights for m in machines], axis=1)
        count = np.zeros(n)
        for hashed, offsets in grams(texts):
            some = np.flatnonzero(np.diff(offsets))
            if len(some):
                margin[some] += np.add.reduceat(table[hashed], offsets[:-1][some], axis=0)
            count += np.diff(offsets)
        margin = margin / np.maximum(count, 1)[:, None] + np.array([m.bias for m in machines])
    won = {pair: _sigmoid(STEEPNESS * margin[:, len(model.rest) + k]) for k, pair in enumerate(model.duels)}
    share = np.ones((n, max(len(model.families), 1)))
    if model.rest:
        order = [list(model.rest).index(f) for f in model.families]
        share = _sigmoid(STEEPNESS * margin[:, order])
        share = share / share.sum(axis=1, keepdims=True)
    names, scores = np.full(n, UNDETERMINED, object), np.zeros(n)
    best = share.argmax(axis=1)
    for f, family in enumerate(model.families):
        own, at = model.members[family], np.flatnonzero(best == f)
        if not len(at):
            continue
        votes, part = np.zeros((len(at), len(own))), np.zeros((len(at), len(own)))
        for a in range(len(own)):
            for b in range(len(own)):
                if a != b:
                    p = won[own[a], own[b]][at] if a < b else 1 - won[own[b], own[a]][at]
                    votes[:, a] += p > 0.5
                    part[:, a] += p
        pick = (votes + part / (2 * max(len(own), 1))).argmax(axis=1)
        duel = part[np.arange(len(at)), pick] / (len(own) - 1) if len(own) > 1 else np.ones(len(at))
        names[at], scores[at] = np.array(own, object)[pick], share[at, f] * duel
    lettered = np.array([any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
    names[~lettered], scores[~lettered] = UNDETERMINED, 0.0
    return names.tolist(), np.clip(scores, 0, 1)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .words import as_strings, text_chunks

        for batch in batches:
            texts = as_strings(batch.column(0))
            rest = pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:])
            for i, j in text_chunks(texts, 1 << 20):
                names, scores = predict(texts.slice(i, j - i), model)
                columns = [*rest.slice(i, j - i).columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*rest.schema.names, "lang_pred", "score"])

    return run


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", learnable: Column | None = None) -> Model:
    """Learn from a bounded sample of the rows where ``learnable`` holds (default:
    the fold that is not held out)."""
    let_import(docs.sparkSession)
    usable = F.col(lang).isNotNull() & F.col(text).isNotNull() & (~held_out(F.col(doc_id)) if learnable is None else learnable)
    rows = docs.where(usable).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(doc_id).cast("string"), F.lit(7)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    want = max(min(PER_LANGUAGE, SAMPLE // max(len(sizes), 1)), 1)  # some of every language, however many
    parts = 1 << 30
    keep = F.lit(False)
    for name, n in sizes.items():
        keep = keep | ((F.col("lang") == name) & (F.pmod("h", F.lit(parts)) < int(parts * min(1.0, want / n))))
    sample = rows.where(keep).select("text", "lang").mapInArrow(lean(_features), "lang string, x binary")
    # some MB for each hundred rows: they meet in a task, and the driver gets the machines only
    found = sample.repartition(1).mapInArrow(lean(_learn), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else learn([], np.zeros((0, DIMENSIONS), np.float32))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` (without its text) with ``lang_pred`` and ``score``."""
    let_import(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    schema = StructType([docs.schema[c] for c in rest]).add("lang_pred", "string").add("score", "double")
    return docs.select(text, *rest).mapInArrow(_predict(model), schema)


def accepted(docs: DataFrame, model: Model, min_score: float, text: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, whose language is told with ``min_score``."""
    let_import(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .words import as_strings, text_chunks

        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for i, j in text_chunks(as_strings(column), 1 << 20):
                names, scores = predict(as_strings(column.slice(i, j - i)), model)
                good = (np.array(names, object) != UNDETERMINED) & (scores >= min_score)
                yield batch.slice(i, j - i).filter(pa.array(good))

    return docs.mapInArrow(lean(keep), docs.schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identify(docs.select("text", "doc_id"), train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language": op4_language}
ORACLES: dict[str, str] = {}
