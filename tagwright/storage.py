"""Shared-folder storage for fitted tables.

Fitted tables (dictionaries, vocabularies, ranked ids) are written once to the folder the cluster names in
``spark.checkpoint.dir`` and read back. Reads then have a short lineage, survive the loss of executors, and are cheap
to measure before a broadcast is considered. A session writes into one folder of its own, which goes when it ends;
tables stored inside a ``scratch`` block go when the block ends. Shuffle files go with the write that needed them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a private one is made only in local mode when none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="tagwright-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


_MARKED: set[str] = set()
_OPEN: ContextVar[tuple[str, ...]] = ContextVar("open scratch folders", default=())
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_ROW_BYTES = 2**11  # taken for a row where batches cannot be held to bytes


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _run_folder(spark: SparkSession) -> str:
    """The session's folder below the checkpoint folder (which is new for every session); removed when the JVM ends."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/tagwright"
    if folder not in _MARKED:
        _MARKED.add(folder)
        path, files = _path(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the innermost scratch block, or the session's run folder outside of any."""
    return f"{(_OPEN.get() or (_run_folder(spark),))[-1]}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    path, files = _path(spark, folder)
    files.delete(path, True)


def drop(table: DataFrame) -> None:
    """Delete a table that ``store`` wrote, before its block or session ends."""
    files = table.inputFiles()
    if files:
        remove(table.sparkSession, files[0].rsplit("/", 1)[0])


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block whose stored tables go when it ends; what it yields stores a table that stays, in the block around it.

    Nothing lazy that reads a table of the block may leave it.
    """
    outer, folder = _OPEN.get(), scratch_path(spark, name)

    def keep(df: DataFrame, kept: str = name) -> DataFrame:
        inner = _OPEN.set(outer)
        try:
            return store(df, kept)
        finally:
            _OPEN.reset(inner)

    mark = _OPEN.set((*outer, folder))
    try:
        yield keep
    finally:
        _OPEN.reset(mark)
        remove(spark, folder)


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function of tables that stores its result and leaves no other stored table behind."""

    @wraps(f)
    def run(*args, **kwargs) -> DataFrame:
        spark = SparkSession.active()
        with scratch(spark, f.__name__) as keep:
            return keep(f(*args, **kwargs))

    return run


def store(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and return the stored table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the shuffles of this write serve nothing else
    try:
        writer.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_bytes(spark: SparkSession, size: int) -> Iterator[None]:
    """A block in which tasks hand about ``size`` bytes at once to Python, one row at least; a smaller setting of the session stays.

    For steps whose result is many times as large as what they read, as a whole batch of it is held on both sides.
    """
    before = spark.conf.get(_ARROW_BYTES, None)
    if before is None:  # a release that counts rows only
        with arrow_rows(spark, max(1, size // _ROW_BYTES)):
            yield
        return
    now = int(before.rstrip("b"))
    spark.conf.set(_ARROW_BYTES, str(size if now <= 0 else min(size, now)))
    try:
        yield
    finally:
        spark.conf.set(_ARROW_BYTES, before)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """A block in which tasks hand at most ``rows`` rows at once to Python; a smaller setting of the session stays."""
    before = spark.conf.get(_ARROW_ROWS)
    now = int(before)
    spark.conf.set(_ARROW_ROWS, str(rows if now <= 0 else min(rows, now)))
    try:
        yield
    finally:
        spark.conf.set(_ARROW_ROWS, before)
