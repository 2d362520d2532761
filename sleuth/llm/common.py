"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuth.plans.ordering import input_bytes
from sleuth.session import let_import

#: Settings of the operators' own jobs: shuffle files go when a query ends, not at
#: some garbage collection of the driver, and Python gets small batches of texts.
JOB_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="llm-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


@contextlib.contextmanager
def job_settings(spark: SparkSession, settings: dict[str, str] = JOB_SETTINGS):
    """``settings`` for the jobs within, then what was before."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Tables written to the shared folder: they cut lineage, so that a lost
    executor costs no more than its own tasks."""

    def __init__(self, spark: SparkSession):
        let_import(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        with job_settings(self.spark):
            df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
        """A table dealt into buckets by ``key``, as joins on it deal their rows: they
        shuffle the other side only. The catalog knows it until ``drop_bucketed``."""
        table = self._table(name)
        with job_settings(self.spark):
            dealt = df.repartition(buckets, key).write.format("parquet").option("compression", "zstd").option("path", self.path(name))
            dealt.bucketBy(buckets, key).saveAsTable(table)
        return self.spark.table(table)

    def drop_bucketed(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
        self.drop(name)

    def _table(self, name: str) -> str:
        return f"{self.root.rsplit('/', 1)[-1]}_{name}".replace("-", "_")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, *names: str) -> None:
        """Delete tables that no frame in use reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return the memory that this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function`` of a task's batches; at its end the task's worker, which waits for
    later tasks beside the JVM's, keeps no memory that it has freed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def parts_for(docs: DataFrame, part_bytes: int) -> int:
    """Partitions of about ``part_bytes`` by the size of the plan's inputs (files); if
    that is not known, the session's number of shuffle partitions."""
    let_import(docs.sparkSession)
    size = input_bytes(docs)
    return -(-size // part_bytes) if size else int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3; 1 is the held-out fold."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)).cast("int")


def held_out(doc_id: Column) -> Column:
    """True for the held-out fold; a null id belongs to no fold and is held out."""
    return F.coalesce(fold_of(doc_id) == 1, F.lit(True))


#: The white space that separates words: 0x20 and 0x09-0x0D.
SPACE = " \t\n\x0b\x0c\r"


def split_words(text: Column) -> Column:
    """Maximal runs of characters other than ``SPACE``; null or blank text: []."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(words)
