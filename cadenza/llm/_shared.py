"""Tables in the shared folder, and memory that a worker gives back at a task's end."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession

from cadenza import tables
from cadenza.tables import dropped, release, shared_dir

__all__ = ["BATCH_ROWS", "dropped", "lean", "leaning", "release", "shared_dir", "small_batches", "written"]

#: Rows sent to a Python worker at once. Spark's 10,000 whole texts take memory on both sides, which workers and executors keep from stage to stage.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python by ``BATCH_ROWS`` from now on in this session; a plan takes the setting when it runs, so it can't be put back on return."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """``tables.written``, after which shuffle files that are out of use can go: these operators write several tables as large as their input."""
    out = tables.written(df, name)
    release(df.sparkSession)
    return out


@contextmanager
def lean(*caches) -> Iterator[None]:
    """Inside a task: at its end the caches (what has ``clear``) are emptied and freed memory goes back to the system, as workers are used again by later stages."""
    try:
        yield
    finally:
        for c in caches:
            c.clear()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


def leaning(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function over batches, inside ``lean``."""

    def inside(batches: Iterator) -> Iterator:
        with lean():
            yield from run(batches)

    return inside
