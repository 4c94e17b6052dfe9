"""Running a function of Arrow batches over a DataFrame, with batches of bounded rows and bytes.

Spark keeps as many idle Python workers as ever ran at once and deals tasks to them in turn, so what
each still holds after its task adds up: a task gives back what it freed and, but for what its
operator names, what was remembered in the worker.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows and bytes of a batch that goes to Python, the same for all operators: plans are lazy, and the session has one setting.
BATCH_ROWS, BATCH_BYTES = 200, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches of this session's Arrow operators; one row of more bytes is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What is remembered in this worker, from task to task of one operator or within a task, by name.
_remembered: dict[str, dict] = {}


def remembered(operator: str) -> dict:
    """What this worker remembers by this name; the operator's tasks pass it to tidied() or map_arrow() to find it again."""
    return _remembered.setdefault(operator, {})


def give_back() -> None:
    """Returns freed memory to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # not glibc


def tidied(run: Callable[[Iterator], Iterator], remembers: str = "") -> Callable[[Iterator], Iterator]:
    """run, in a worker that before and after it forgets what is not this operator's, and then gives back what was freed."""

    def forget() -> None:
        for operator in [x for x in _remembered if x != remembers]:
            del _remembered[operator]

    def whole(batches: Iterator) -> Iterator:
        forget()
        try:
            yield from run(batches)
        finally:
            forget()
            give_back()

    return whole


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str | StructType, remembers: str = "") -> DataFrame:
    """f of every batch of df; f returns a batch or yields some."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = f(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(tidied(run, remembers), schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
