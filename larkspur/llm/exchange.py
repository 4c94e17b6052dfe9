"""Dealing packed arrays to buckets and back.

A mapper turns a run of documents into one row for each bucket of hash values, packed
as binary columns, so that a shuffle moves few large rows of bare numbers. A bucket
is one partition; its number of values is the total over the number of partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm.arrowmap import small_batches, tidied
from larkspur.llm.textvec import mix

_U = np.uint64


#: Bytes of files behind one bucket at most; a bucket's numbers take about three times as much memory.
BUCKET_BYTES = 128 << 20


def size_of(df: DataFrame) -> int:
    """Bytes of the files behind df as Spark knows them, or 0 where it does not."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def partitions(df: DataFrame) -> int:
    """Buckets for what is made of df: the session's shuffle partitions, or as many as its size asks for."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size_of(df) // BUCKET_BYTES))


def _murmur(k: np.ndarray) -> np.ndarray:
    """Spark's hash of an int column, as signed 32-bit values (MurmurHash3 with seed 42)."""
    with np.errstate(over="ignore"):
        turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
        x = turn(k.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(np.uint32(42) ^ x, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
    return h.view(np.int32)


def keys(n: int) -> np.ndarray:
    """For each of n partitions an int that Spark's hash partitioning sends there."""
    found = np.full(n, -1, np.int64)
    lo = 0
    while (found < 0).any():
        k = np.arange(lo, lo + 16 * n + 64)
        at = np.mod(_murmur(k).astype(np.int64), n)
        place, first = np.unique(at, return_index=True)
        new = found[place] < 0
        found[place[new]] = k[first[new]]
        lo += len(k)
    return found


def deal(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket (their order within it stays) and the bounds of the n buckets; a bucket is a value's upper half modulo n."""
    bucket = ((values >> _U(32)) % _U(n)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def to_buckets(df: DataFrame, n: int) -> DataFrame:
    """One partition for each value that keys(n) gave column `bucket`."""
    return df.repartition(n, "bucket")


def whole_partitions(df: DataFrame, f: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f of all batches of a partition."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            yield from f(got)

    return df.mapInArrow(tidied(run), schema)


def blob(x: np.ndarray) -> bytes:
    return x.tobytes()


def run_id(first: int) -> int:
    """A number of this run of documents: the same if the task is run again, and another for every other run.

    A task that is run again must read the same rows in the same order, as a scan of files does (see shared.settled).
    """
    from pyspark import TaskContext

    task = TaskContext.get()
    part = task.partitionId() if task else 0
    return int(mix(np.array([(part << 32) + first], _U))[0].astype(np.int64))
