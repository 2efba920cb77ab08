"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of narrow keys is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs in one process is a temporary folder made.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lectorium-")
        atexit.register(shutil.rmtree, folder, True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def own_checkpoints(spark: SparkSession, folder: str) -> Iterator[None]:
    """Checkpoints made inside go to a folder of their own, which is deleted at the end: what needs them must be written by then."""
    context = spark.sparkContext
    shared = shared_folder(spark)
    context.setCheckpointDir(folder)
    try:
        yield
    finally:
        context.setCheckpointDir(shared)
        remove(spark, folder)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_narrow(df: DataFrame, rows_each: int = 50_000) -> DataFrame:
    """A checkpoint of narrow rows, in as many partitions as these rows are worth."""
    kept = checkpoint(df)
    return kept.coalesce(kept.count() // rows_each + 1)


def few(keys: DataFrame) -> DataFrame:
    """``keys`` with a broadcast hint if counting shows that it has few enough rows.

    It must be cheap to compute twice, or checkpointed.
    """
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def tidy(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kernel; when it is done, its memory goes back to the system, as workers are used again by other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return run


def squeeze(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``; byte searches, no regex."""
    for c in "\x20\x09\x0a\x0b\x0c\x0d":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def table_partitions(df: DataFrame) -> int:
    """How many partitions a shuffle of ``df`` gets."""
    return max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fresh(name: str, df: DataFrame) -> str:
    """``name``, with underscores until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
