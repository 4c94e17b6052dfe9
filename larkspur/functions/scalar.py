"""Scalar functions as Columns (inventory F1-F40).

A null argument gives null, without exception: logic is strict, not three-valued, and
least/greatest do not skip nulls. Results outside a function's domain are null or the
protected value that the function names; nothing raises under ANSI mode.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROTECTED_LOG, PROTECTED_DIVISOR, EXP_LIMIT = 1e-6, 0.001, 100.0


def strict(result: Column, *arguments: Column) -> Column:
    """result where no argument is null, else null."""
    known = arguments[0].isNotNull()
    for a in arguments[1:]:
        known = known & a.isNotNull()
    return F.when(known, result)


# logic


def not_(a: Column) -> Column:
    return ~a


def and_(a: Column, b: Column) -> Column:
    return strict(a & b, a, b)


def or_(a: Column, b: Column) -> Column:
    return strict(a | b, a, b)


def nand(a: Column, b: Column) -> Column:
    return strict(~(a & b), a, b)


def nor(a: Column, b: Column) -> Column:
    return strict(~(a | b), a, b)


def equal(a: Column, b: Column) -> Column:
    return a == b


def if_then_else(condition: Column, a: Column, b: Column) -> Column:
    """A null condition gives null, not the else branch."""
    return F.when(condition.isNull(), F.lit(None)).when(condition, a).otherwise(b)


# whole numbers: what overflows is null


def int_add(a: Column, b: Column) -> Column:
    return F.try_add(a.cast("long"), b.cast("long"))


def int_subtract(a: Column, b: Column) -> Column:
    return F.try_subtract(a.cast("long"), b.cast("long"))


def int_multiply(a: Column, b: Column) -> Column:
    return F.try_multiply(a.cast("long"), b.cast("long"))


def int_divide(a: Column, b: Column) -> Column:
    """Truncating division; null for a zero divisor and for the one quotient that overflows."""
    a, b = a.cast("long"), b.cast("long")
    quotient = F.call_function("div", a, F.when(b != 0, b))
    return F.when(~((a == F.lit(-(2**63))) & (b == -1)), quotient)


# doubles


def opposite(x: Column) -> Column:
    return -x


def inverse(x: Column) -> Column:
    return F.try_divide(F.lit(1.0), x)


def absolute(x: Column) -> Column:
    return F.abs(x)


def log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def protected_log(x: Column) -> Column:
    return strict(F.when(x > PROTECTED_LOG, F.ln(x)).otherwise(1.0), x)


def exp(x: Column) -> Column:
    return F.when(x < EXP_LIMIT, F.exp(x))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def cos(x: Column) -> Column:
    return F.cos(x)


def sin(x: Column) -> Column:
    return F.sin(x)


def add(a: Column, b: Column) -> Column:
    return a + b


def subtract(a: Column, b: Column) -> Column:
    return a - b


def multiply(a: Column, b: Column) -> Column:
    return a * b


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def protected_divide(a: Column, b: Column) -> Column:
    return strict(F.when(F.abs(b) > PROTECTED_DIVISOR, F.try_divide(a, b)).otherwise(1.0), a, b)


def power(a: Column, b: Column) -> Column:
    """Null for 0 to the 0, and where the power is no number."""
    p = F.pow(a, b)
    return strict(F.when(((a != 0) | (b != 0)) & ~F.isnan(p), p), a, b)


def minimum(a: Column, b: Column) -> Column:
    return strict(F.least(a, b), a, b)


def maximum(a: Column, b: Column) -> Column:
    return strict(F.greatest(a, b), a, b)


# comparisons and fitted functions


def equals_constant(x: Column, value) -> Column:
    return x == F.lit(value)


def stump(x: Column, threshold: float) -> Column:
    return x >= F.lit(threshold)


def greater(a: Column, b: Column) -> Column:
    return a > b


def percentile_knots(df: DataFrame, column: str, count: int) -> list[float]:
    """Knots of the normaliser: the values at positions floor(i * (n - 1) / (count - 1)) of the sorted column.

    Ranks are made by a distributed sort: counts by value are summed up in order, so no window holds the rows.
    """
    from pyspark.sql import Window

    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    n = values.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    if not n:
        return []
    count = max(2, min(count, n))
    wanted = sorted({i * (n - 1) // (count - 1) for i in range(count)})
    # two levels: totals of value ranges first, then ranks within the ranges
    cuts = values.approxQuantile("v", [i / 64 for i in range(1, 64)], 0.01)
    part = sum(((F.col("v") > c).cast("int") for c in sorted(set(cuts))), F.lit(0))
    values = values.withColumn("part", part)
    totals = values.groupBy("part").agg(F.sum("c").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    upto = F.sum("c").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = values.withColumn("upto", upto).join(F.broadcast(totals.select("part", "before")), "part").select("v", (F.col("before") + F.col("upto")).alias("hi"), (F.col("before") + F.col("upto") - F.col("c")).alias("lo"))
    at = F.explode(F.array(*(F.lit(w) for w in wanted)))
    hit = {r.w: r.v for r in ranked.select("v", "lo", "hi", at.alias("w")).where("lo <= w and w < hi").select("w", "v").collect()}
    return [hit[i * (n - 1) // (count - 1)] for i in range(count)]


def normalise(x: Column, knots: Sequence[float]) -> Column:
    """The piecewise-linear share of values below x: 0 up to the first knot, 1 from the last."""
    if not knots:
        return F.lit(None).cast("double")
    last = len(knots) - 1
    out = F.when(x.isNull(), F.lit(None).cast("double")).when(x <= knots[0], F.lit(0.0))
    for i in range(1, len(knots)):
        if knots[i] > knots[i - 1]:
            out = out.when(x < knots[i], (F.lit(float(i - 1)) + (x - knots[i - 1]) / (knots[i] - knots[i - 1])) / last)
    return out.otherwise(F.lit(1.0))


# objects and votes


def field(x: Column, name: str) -> Column:
    return x.getField(name)


def length(v: Column) -> Column:
    return strict(F.size(v), v)


def element(v: Column, index: int) -> Column:
    """Null beyond the end."""
    return F.get(v, F.lit(index))


def scalar_vote(x: Column, vote: float | Column) -> Column:
    return (2.0 * x.cast("double") - 1.0) * (vote if isinstance(vote, Column) else F.lit(float(vote)))


def vector_vote(x: Column, vote: Column) -> Column:
    return strict(F.transform(vote, lambda v: v * (2.0 * x.cast("double") - 1.0)), x)


def on_columns(f: Callable, returns: str = "double") -> Callable[..., Column]:
    """Any function of pandas Series as a function of Columns: the fallback where no expression will do."""
    return F.pandas_udf(f, returns)
