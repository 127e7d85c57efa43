"""Tables written to the shared scratch folder, so that a lost executor costs no recomputation."""

import ctypes
import ctypes.util

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import scratch_path


def saved(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes ``df`` as a fresh Parquet table and reads it back."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, written once so that it never changes; and its column."""
    column = "row"
    while column in docs.columns:
        column += "_"
    return saved(docs.withColumn(column, F.monotonically_increasing_id()), name), column


def lean(work):
    """``work`` over the batches of a task, after which the Python worker gives back what it freed.

    Workers are kept for later tasks, and beside a stage that runs no Python what they still hold
    counts against the memory of their executor.
    """
    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(ctypes.util.find_library("c")).malloc_trim(0)
        except (AttributeError, OSError, TypeError):  # a C library without it
            pass
    return run
