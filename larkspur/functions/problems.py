"""Closed-form regression and boolean problems: their targets as Columns of their inputs, and frames of sampled rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.frame import ROW
from larkspur.operators.sampling import uniform


def paraboloid(x: list[Column]) -> Column:
    return F.sqrt(x[0] * x[0] + x[1] * x[1])


def _up(x: Column) -> Column:
    return F.round(x)


def lexp(x: list[Column]) -> Column:
    """Two exponential surfaces, by the half in which the first input lies."""
    a, b, c, d, e = x
    one = 1 + 2 * b + 3 * c - F.exp(-2 * (d + e))
    other = 1 - 1.2 * b - 3.1 * c + F.exp(-3 * (d - e))
    return _up(a) * one + (1 - _up(a)) * other


def losc(x: list[Column]) -> Column:
    """Two oscillating surfaces, by the half in which the first input lies."""
    a, b, c, d, e = x
    one = 1 + 1.5 * b + c + F.sin(2 * (d + e)) * F.exp(-2 * (b + d))
    other = -1 - 2 * b - c + F.sin(3 * (d + e)) * F.exp(-3 * (c - d))
    return _up(a) * one + (1 - _up(a)) * other


def cart(x: list[Column]) -> Column:
    """Two planes on either side of 0 of the first input."""
    return F.when(x[0] < 0, 3 + 3 * x[1] + 2 * x[2] + 3 * x[3]).otherwise(-3 + 3 * x[4] + 2 * x[5] + x[6])


def friedman(x: list[Column]) -> Column:
    """Without its noise, which is normal with deviation 1."""
    return 10 * F.sin(math.pi * x[0] * x[1]) + 20 * (x[2] - 0.5) * (x[2] - 0.5) + 10 * x[3] + 5 * x[4]


def quartic(x: list[Column]) -> Column:
    v = x[0]
    return v * v * v * v + v * v * v + v * v + v


@dataclass(frozen=True)
class Sampled:
    inputs: int
    low: float
    high: float
    target: Callable[[list[Column]], Column]


PROBLEMS = {"paraboloid": Sampled(2, -4, 4, paraboloid), "lexp": Sampled(5, 0, 1, lexp), "losc": Sampled(5, 0, 1, losc), "cart": Sampled(10, -1, 1, cart), "friedman": Sampled(10, 0, 1, friedman), "quartic": Sampled(1, -1, 1, quartic)}


def rows_of(spark: SparkSession, name: str, n: int, seed: int = 0) -> DataFrame:
    """row_id, x1.. uniform over the problem's box, and y."""
    p = PROBLEMS[name]
    names = [f"x{i + 1}" for i in range(p.inputs)]
    x = spark.range(n).select(F.col("id").alias(ROW), *(uniform(seed + 37 * i, F.col("id"), p.low, p.high).alias(c) for i, c in enumerate(names)))
    return x.withColumn("y", p.target([F.col(c) for c in names]))


def bits_of(spark: SparkSession, n: int) -> DataFrame:
    """row_id and all combinations of b0.. as booleans."""
    return spark.range(2**n).select(F.col("id").alias(ROW), *((F.shiftright("id", k).bitwiseAND(F.lit(1)) == 1).alias(f"b{k}") for k in range(n)))


def parity(spark: SparkSession, n: int) -> DataFrame:
    """All rows of n bits; y is whether an odd number is set."""
    return bits_of(spark, n).withColumn("y", F.bit_count(ROW) % 2 == 1)


def multiplexer(spark: SparkSession, address: int) -> DataFrame:
    """All rows of address bits, the most significant first, and data bits; y is the addressed one."""
    rows = bits_of(spark, address + 2**address)
    at = sum((F.col(f"b{k}").cast("int") * 2 ** (address - 1 - k) for k in range(address)), F.lit(0))
    return rows.withColumn("y", F.get(F.array(*(F.col(f"b{address + k}") for k in range(2**address))), at))
