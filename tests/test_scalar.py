"""Null rules and edge values of scalar and vector functions."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from larkspur.functions import scalar as s
from larkspur.functions import vectors as v

T = (True, False, None)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x, kind="double"):
    return F.lit(x).cast(kind)


@pytest.mark.parametrize("f,g", [(s.and_, lambda a, b: a and b), (s.or_, lambda a, b: a or b), (s.nand, lambda a, b: not (a and b)), (s.nor, lambda a, b: not (a or b)), (s.equal, lambda a, b: a == b)])
def test_strict_logic(spark, f, g):
    pairs = list(itertools.product(T, T))
    df = spark.createDataFrame(pairs, "a boolean, b boolean")
    for r in df.select("a", "b", f(F.col("a"), F.col("b")).alias("x")).collect():
        assert r.x == (None if r.a is None or r.b is None else g(r.a, r.b))


def test_condition_of_null_is_null(spark):
    df = spark.createDataFrame(list(itertools.product(T, T, T)), "c boolean, a boolean, b boolean")
    for r in df.select("*", s.if_then_else(F.col("c"), F.col("a"), F.col("b")).alias("x")).collect():
        assert r.x == (None if r.c is None else r.a if r.c else r.b)


@pytest.mark.parametrize("a,b,x", [(7, 2, 3), (-7, 2, -3), (7, -2, -3), (1, 0, None), (None, 2, None), (-(2**63), -1, None)])
def test_whole_division(spark, a, b, x):
    assert one(spark, s.int_divide(lit(a, "long"), lit(b, "long"))) == x


def test_overflow_is_null(spark):
    big = lit(2**63 - 1, "long")
    assert one(spark, s.int_add(big, lit(1, "long"))) is None
    assert one(spark, s.int_multiply(big, lit(2, "long"))) is None


@pytest.mark.parametrize(
    "f,x,y",
    [(s.log, 0.0, None), (s.log, math.e, 1.0), (s.protected_log, 1e-7, 1.0), (s.protected_log, None, None), (s.exp, 100.0, None), (s.exp, 0.0, 1.0), (s.sqrt, -1.0, None), (s.inverse, 0.0, None), (s.inverse, 4.0, 0.25)],
)
def test_guards(spark, f, x, y):
    got = one(spark, f(lit(x)))
    assert got == y or got == pytest.approx(y)


@pytest.mark.parametrize("f,a,b,x", [(s.divide, 1.0, 0.0, None), (s.protected_divide, 1.0, 0.001, 1.0), (s.protected_divide, 1.0, None, None), (s.power, 0.0, 0.0, None), (s.power, -1.0, 0.5, None), (s.power, 2.0, 3.0, 8.0), (s.minimum, 1.0, None, None), (s.maximum, 1.0, 2.0, 2.0)])
def test_guards_of_two(spark, f, a, b, x):
    assert one(spark, f(lit(a), lit(b))) == x


def test_vectors(spark):
    e = F.array(*(F.lit(x) for x in (3.0, 0.0, -4.0)))
    none = F.lit(None).cast("array<double>")
    empty = F.array().cast("array<double>")
    assert one(spark, v.l0_norm(e)) == 2
    assert one(spark, v.l2_norm(e)) == 5.0
    assert one(spark, v.argmax(e)) == 0
    assert one(spark, v.argmin(e)) == 2
    assert one(spark, v.argmax(empty)) is None
    assert one(spark, v.l1_norm(none)) is None
    assert one(spark, v.entropy(empty)) == 0.0
    assert one(spark, v.entropy(F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(1.0)
    assert one(spark, v.to_dense(v.prune(v.to_sparse(e), 3.5), 3)) == [0.0, 0.0, -4.0]
    assert one(spark, s.element(e, 9)) is None


def test_normaliser(spark):
    df = spark.createDataFrame([(float(x),) for x in range(101)] + [(None,)], "x double")
    knots = s.percentile_knots(df, "x", 5)
    assert knots == [0.0, 25.0, 50.0, 75.0, 100.0]
    got = {r.x: r.y for r in df.select("x", s.normalise(F.col("x"), knots).alias("y")).collect()}
    assert got[0.0] == 0.0 and got[100.0] == 1.0 and got[None] is None and got[30.0] == pytest.approx(0.3)
