"""Session settings the jobs are written for."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for local runs and tests; on a cluster the submitted settings win."""
    builder = (
        SparkSession.builder.appName("tradesift")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TRADESIFT_DRIVER_MEMORY", "8g"))
        # wide generated projections stay compiled instead of interpreted
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .config("spark.executor.extraJavaOptions", "-XX:-DontCompileHugeMethods")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpointed(rows: DataFrame) -> DataFrame:
    """Rows kept in the shared folder: what reads them twice reads the same ranges, also after a lost executor."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(rows.sparkSession))
    return rows.checkpoint()


#: Folders that the open ``scratch`` blocks delete at their ends, innermost last.
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())
#: Spark drops the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(rows: DataFrame, out: int = 0) -> DataFrame:
    """As ``checkpointed``, as compressed columns: a fraction of the disk that rows in Spark's own form take.

    The shuffle files of the rows go when they are written. In a ``scratch`` block the rows go at its end, or at the end of
    the block ``out`` levels further out; outside of such blocks they stay.
    """
    spark = rows.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(spark))
    folder = f"{context.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    blocks = _SCRATCH.get()
    if len(blocks) > out:
        blocks[-1 - out].append(folder)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        rows.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(rows.schema).parquet(folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is kept inside is deleted at the end, so nothing that leaves the block may read it; see ``kept`` for what does."""
    folders: list[str] = []
    token = _SCRATCH.set((*_SCRATCH.get(), folders))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local session without one gets a temporary folder, as in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tradesift-checkpoint-")
