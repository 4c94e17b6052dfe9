"""A Bloom filter of bounded size, which may be broadcast however large the input is.

What it lets through is checked exactly later, so when a large input fills it, only
work is lost and no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrowmap import tidied
from larkspur.llm.shared import keep
from larkspur.llm.textvec import mix

_U = np.uint64
#: Least and greatest number of bits of a filter: 128 KB and 64 MB.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
HASHES = 3
#: Ids at most that are looked up by broadcast.
MOST_SENT = 1 << 20


def bits_for(entries: int, each: int = 16) -> int:
    """A power of two of about so many bits for each entry, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, entries * each - 1).bit_length()))


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    x = ids.astype(np.int64).view(_U)
    return np.stack([mix(x + _U(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1))) & _U(bits - 1) for k in range(HASHES)])


def of_ids(df: DataFrame, column: str, bits: int | None = None) -> np.ndarray:
    """A filter of the ids in a column, by default of bits for their number: at most bits / 64 words come to the driver."""
    import pyarrow as pa

    bits = bits or bits_for(df.count())

    def run(batches):
        for b in batches:
            at = _places(b.column(0).to_numpy(zero_copy_only=False), bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((at >> _U(6)).astype(np.int32)), pa.array((_U(1) << (at & _U(63))).view(np.int64))], names=["w", "b"])

    words = df.where(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("i")).mapInArrow(tidied(run), "w int, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out.view(_U)


def has(filter_words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.ones(len(ids), bool)
    for at in _places(ids, len(filter_words) * 64):
        out &= (filter_words[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) == 1
    return out


def only(df: DataFrame, filter_words: np.ndarray, column: str) -> DataFrame:
    """The rows of df whose id the filter lets through."""
    sent = df.sparkSession.sparkContext.broadcast(filter_words)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids = b.column(b.schema.get_field_index(column)).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(has(sent.value, ids)))

    return df.mapInArrow(tidied(run), df.schema)


def let_through(df: DataFrame, words: np.ndarray, ids: Column) -> Column:
    """Whether a filter has the ids, as a column of df."""
    sent = df.sparkSession.sparkContext.broadcast(words)

    def found(x: pd.Series) -> pd.Series:
        return pd.Series(has(sent.value, x.to_numpy()))

    return F.pandas_udf(found, "boolean")(ids)


def without(df: DataFrame, column: str, ids: DataFrame, goes: Column) -> DataFrame:
    """The rows of df but those whose id in column is one of the ids that go; ids has the column with all ids of df, each of which goes or stays.

    A filter of the ids that go tells most that stay; the ids that it lets through without need are
    looked up. So no row of df is shuffled, unless these are more than MOST_SENT.
    """
    hashed = ids.where(F.col(column).isNotNull()).select(column, F.xxhash64(column).alias("_hash"), goes.alias("_goes"))
    words = of_ids(hashed.where("_goes"), "_hash")
    stay = keep(hashed.where(~F.col("_goes") & let_through(hashed, words, F.col("_hash"))).select(F.col(column).alias("_stays")).distinct(), "stay")
    table = F.broadcast(stay) if stay.count() <= MOST_SENT else stay
    may = let_through(df, words, F.xxhash64(column))
    return df.where(F.col(column).isNull() | ~may).unionByName(df.where(may).join(table, F.col(column) == F.col("_stays"), "left_semi"))
