"""Functions of dense vectors (array<double>) and sparse ones (map<int,double>), as Columns (inventory F36, F37, V1-V13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.scalar import strict

EPSILON = 2.220446049250313e-16


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product; what one vector has beyond the other's end counts as zero."""
    return total(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))))


def sparse_dot(a: Column, b: Column) -> Column:
    """Of a sparse and a dense vector; keys beyond the dense one's end count as zero."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e.value.cast("double") * F.coalesce(F.get(b, e.key), F.lit(0.0)))


def l0_norm(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: x != 0))


def l1_norm(v: Column) -> Column:
    return total(F.transform(v, lambda x: F.abs(x)))


def sum_of_squares(v: Column) -> Column:
    return total(F.transform(v, lambda x: x * x))


def l2_norm(v: Column) -> Column:
    return F.sqrt(sum_of_squares(v))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: F.pow(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)), F.lit(2.0)))))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))


def scale(v: Column, by: float | Column) -> Column:
    return F.transform(v, lambda x: x * by)


def divide(v: Column, by: float | Column) -> Column:
    by = by if isinstance(by, Column) else F.lit(float(by))
    return F.transform(v, lambda x: F.try_divide(x, by))


def add_weighted(a: Column, b: Column, weight: float) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + weight * F.coalesce(y, F.lit(0.0)))


def argmax(v: Column) -> Column:
    """Position from 0 of the first greatest element; null for an empty vector."""
    return F.when(F.size(v) > 0, (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def argmin(v: Column) -> Column:
    return F.when(F.size(v) > 0, (F.array_position(v, F.array_min(v)) - 1).cast("int"))


def extremums(v: Column) -> Column:
    return strict(F.struct(argmin(v).alias("argmin"), argmax(v).alias("argmax")), v)


def entropy(v: Column, z: Column | None = None) -> Column:
    """In bits, of the elements over their l1 norm (or z); 0 where that is 0."""
    z = l1_norm(v) if z is None else z
    h = F.aggregate(v, F.lit(0.0), lambda s, x: s - F.when(x != 0, F.try_divide(x, z) * F.log2(F.try_divide(x, z))).otherwise(F.lit(0.0)))
    return F.when(z == 0, F.lit(0.0)).otherwise(h)


def log_sum_exp(v: Column) -> Column:
    m = F.array_max(v)
    return F.ln(total(F.transform(v, lambda x: F.exp(x - m)))) + m


def mean(v: Column) -> Column:
    return F.try_divide(total(v), F.size(v).cast("double"))


def variance(v: Column) -> Column:
    """Of the population; rounding can't make it negative."""
    n = F.size(v).cast("double")
    return F.greatest(F.try_divide(sum_of_squares(v), n) - F.pow(F.try_divide(total(v), n), F.lit(2.0)), F.lit(0.0))


def stats(v: Column) -> Column:
    """mean, stddev, min, max, sum, l0, l1, l2 of a dense vector."""
    var = variance(v)
    return strict(
        F.struct(
            mean(v).alias("mean"), F.when(var > EPSILON, F.sqrt(var)).otherwise(F.lit(0.0)).alias("stddev"), F.array_min(v).alias("min"), F.array_max(v).alias("max"), total(v).alias("sum"), l0_norm(v).alias("l0"), l1_norm(v).alias("l1"), l2_norm(v).alias("l2")
        ),
        v,
    )


def to_sparse(v: Column) -> Column:
    indexed = F.transform(v, lambda x, i: F.struct(i.alias("key"), x.alias("value")))
    return F.map_from_entries(F.filter(indexed, lambda e: e.value != 0))


def to_dense(m: Column, size: int | Column) -> Column:
    last = (size if isinstance(size, Column) else F.lit(size)) - 1
    full = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0)))
    return strict(F.when(last < 0, F.array().cast("array<double>")).otherwise(full), m)


def increment(m: Column, index: int | Column, by: float | Column) -> Column:
    one = F.create_map(index if isinstance(index, Column) else F.lit(index), by if isinstance(by, Column) else F.lit(float(by)))
    return sparse_add(m, one)


def sparse_add(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def append(m: Column, index: int | Column, value: float | Column) -> Column:
    """A sparse vector with one more entry, whose index is above all others."""
    return F.map_concat(m, F.create_map(index if isinstance(index, Column) else F.lit(index), value if isinstance(value, Column) else F.lit(float(value))))


def prune(m: Column, epsilon: float = 0.0) -> Column:
    return F.map_filter(m, lambda k, v: F.abs(v) > epsilon)


def get(m: Column, index: int | Column) -> Column:
    return strict(F.coalesce(F.element_at(m, index if isinstance(index, Column) else F.lit(index)), F.lit(0.0)), m)


def concat(*parts: Column) -> Column:
    """A composite vector: the parts' elements, each part's offset by the sizes of those before."""
    return F.concat(*parts)
