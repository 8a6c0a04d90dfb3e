"""Arrow batch functions on executors that may not have the package yet."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship_package

Batches = Iterator[pa.RecordBatch]


def _tidy() -> None:
    """Give memory that a finished task freed back to the system, as workers
    wait for their next task for long."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, function: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``df.mapInArrow``, on workers that keep little between tasks."""
    ship_package(df.sparkSession)

    def run(batches: Batches) -> Batches:
        yield from function(batches)
        _tidy()

    return df.mapInArrow(run, schema)
