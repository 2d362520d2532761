"""Spark session and checkpoint-directory helpers."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkConf
from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "sleuth", shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests, bench and local runs.

    On a cluster the caller's session is used as-is; this helper only fills
    in settings that are unset.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SLEUTH_DRIVER_MEMORY", "16g"))
    )
    if master or SparkSession.getActiveSession() is None and "spark.master" not in dict(SparkConf().getAll()):
        builder = builder.master(master or f"local[{cpus}]")  # spark-submit's master stays
    log_dir = os.environ.get("SLEUTH_EVENT_LOG_DIR")
    if log_dir:  # stage timings for profiling, written to a scratch folder
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir).config("spark.eventLog.compress", "false")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Each job's shuffle files go when the job ends; else they stay until the driver's
    garbage collection finds them, and the shuffles of many jobs fill the disk together."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def let_import(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder that the driver has it
    in, as when it is only on the driver's ``sys.path`` (on a cluster: installed,
    shipped with --py-files, or in a folder that all machines see)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory.

    Uses the directory the cluster names in ``spark.checkpoint.dir``. Only a local
    session without that setting gets a fresh folder under /tmp; elsewhere each
    executor would write to its own disk, so a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="sleuth-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
