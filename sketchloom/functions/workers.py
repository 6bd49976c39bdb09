"""Care for the memory of Python workers, which Spark keeps between tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of one Arrow batch: long texts make batches of fewer rows, not of more memory.
BATCH_BYTES = 8 << 20


def give_back() -> None:
    """Return what the allocators hold but don't use to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def frugal(function: Callable, every: int = 32) -> Callable:
    """``function`` over Arrow batches, giving memory back as it goes and when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for n, out in enumerate(function(batches)):
                yield out
                del out
                if n % every == every - 1:
                    give_back()
        finally:
            give_back()

    return run


def bounded_batches(spark: SparkSession, n_bytes: int = BATCH_BYTES) -> None:
    """Let the session cut Arrow batches by size, if it doesn't cut them smaller already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > n_bytes:
        spark.conf.set(name, str(n_bytes))
