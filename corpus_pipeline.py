"""From raw documents to packed token windows, in five stages.

1. language: documents whose language cannot be told are rejected (no letters, or
   a score below ``MIN_SCORE``);
2. near_dup: one document of each component of near duplicates stays;
3. passages: passages that repeat an earlier document's are cut out;
4. mixing: sources are mixed to their target weights; a document appears once for
   each reading, cut to the words that the reading takes;
5. packing: what is left is packed into windows of token ids.

Each stage reads what the one before it wrote. All but the last return the columns
of ``documents`` (``n_chars`` is that of the new text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuth.llm import language, mixing, near_dup, packing, passages
from sleuth.llm.common import Scratch, documents

MIN_SCORE = 0.2  # of a language; texts in a language that was learned have 0.38 or more


def _written(spark: SparkSession, out: DataFrame, name: str) -> DataFrame:
    """``out`` written by a job with small batches, as whole texts pass through Python:
    whoever writes the stage's result has batches of 10,000 rows in the JVM and the worker."""
    return Scratch(spark).write(out, name)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(docs)
    return _written(spark, language.accepted(docs, model, MIN_SCORE), "accepted")


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.without_near_duplicates(docs, Scratch(spark))


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes, _ = passages.repeats(docs, Scratch(spark))
    return _sized(_written(spark, passages.without_repeats(docs, classes), "cut"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(_written(spark, mixing.mixed_texts(docs, Scratch(spark)), "mixed"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = packing.packed(docs)
    return out.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _sized(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("language", language_stage),
    ("near_dup", near_dup_stage),
    ("passages", passages_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each but the last returns was written to the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name == "near_dup":  # the others write their results themselves
            docs = Scratch(spark).write(docs, name)
    return docs


#: Models and tokenizers are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
