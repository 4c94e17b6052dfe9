"""Queries for scalar and vector functions (F1-F39, V1-V13, E1-E3): one each, over inputs with nulls and edge values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import scalar as s
from larkspur.functions import vectors as v
from larkspur.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_NUMBERS_SQL = """(SELECT l_orderkey * 10 + l_linenumber AS k,
  CASE WHEN l_linenumber % 5 <> 0 THEN (l_quantity - 25) / 10 END AS a,
  CASE WHEN l_suppkey % 7 = 1 THEN 0.0 WHEN l_suppkey % 7 <> 0 THEN l_discount * 100 - 5 END AS b,
  CASE WHEN l_linenumber % 6 <> 0 THEN l_extendedprice / 400 END AS c,
  CASE WHEN l_linenumber % 5 <> 0 THEN CAST(l_partkey % 23 - 11 AS BIGINT) END AS i,
  CASE WHEN l_suppkey % 7 <> 0 THEN CAST(l_suppkey % 5 - 2 AS BIGINT) END AS j,
  CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity > 20 END AS p,
  CASE WHEN l_suppkey % 4 <> 0 THEN l_discount > 0.04 END AS q,
  CASE WHEN l_partkey % 3 <> 0 THEN l_tax > 0.03 END AS r,
  l_returnflag AS flag FROM lineitem)"""


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles a, b (with 0), c (large), whole numbers i, j, truth values p, q, r and a flag, with nulls."""
    c = F.col
    when = lambda test, value: F.when(test, value)
    return table(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("k"),
        when(c("l_linenumber") % 5 != 0, (c("l_quantity") - 25) / 10).alias("a"),
        when(c("l_suppkey") % 7 == 1, F.lit(0.0)).when(c("l_suppkey") % 7 != 0, c("l_discount") * 100 - 5).alias("b"),
        when(c("l_linenumber") % 6 != 0, c("l_extendedprice") / 400).alias("c"),
        when(c("l_linenumber") % 5 != 0, (c("l_partkey") % 23 - 11).cast("long")).alias("i"),
        when(c("l_suppkey") % 7 != 0, (c("l_suppkey") % 5 - 2).cast("long")).alias("j"),
        when(c("l_linenumber") % 3 != 0, c("l_quantity") > 20).alias("p"),
        when(c("l_suppkey") % 4 != 0, c("l_discount") > 0.04).alias("q"),
        when(c("l_partkey") % 3 != 0, c("l_tax") > 0.03).alias("r"),
        c("l_returnflag").alias("flag"),
    )


def _number(name: str, made: Callable[..., Column], sql: str, arguments: str, rounded: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = made(*(F.col(x) for x in arguments))
        return numbers(spark, sf_dir).select("k", (F.round(out, 6) if rounded else out).alias("result"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT k, {f'round({sql}, 6)' if rounded else sql} AS result FROM {_NUMBERS_SQL}"


_known = lambda names, sql: f"CASE WHEN {' AND '.join(f'{n} IS NOT NULL' for n in names)} THEN {sql} END"

_number("f01_not", s.not_, "NOT p", "p")
_number("f02_and", s.and_, _known("pq", "p AND q"), "pq")
_number("f03_or", s.or_, _known("pq", "p OR q"), "pq")
_number("f04_nand", s.nand, _known("pq", "NOT (p AND q)"), "pq")
_number("f05_nor", s.nor, _known("pq", "NOT (p OR q)"), "pq")
_number("f06_equal", s.equal, "p = q", "pq")
_number("f07_if_then_else", s.if_then_else, "CASE WHEN p IS NULL THEN NULL WHEN p THEN q ELSE r END", "pqr")
_number("f08_int_add", s.int_add, "i + j", "ij")
_number("f09_int_subtract", s.int_subtract, "i - j", "ij")
_number("f10_int_multiply", s.int_multiply, "i * j", "ij")
_number("f11_int_divide", s.int_divide, "CASE WHEN j <> 0 THEN CAST(trunc(i / j) AS BIGINT) END", "ij")
_number("f12_opposite", s.opposite, "-a", "a", True)
_number("f13_inverse", s.inverse, "CASE WHEN b <> 0 THEN 1 / b END", "b", True)
_number("f14_abs", s.absolute, "abs(a)", "a", True)
_number("f15_log", s.log, "CASE WHEN a > 0 THEN ln(a) END", "a", True)
_number("f16_protected_log", s.protected_log, "CASE WHEN a > 1e-6 THEN ln(a) WHEN a IS NOT NULL THEN 1.0 END", "a", True)
_number("f17_exp", lambda c: F.ln(s.exp(c - 60)), "CASE WHEN c - 60 < 100 THEN ln(exp(c - 60)) END", "c", True)
_number("f18_sqrt", s.sqrt, "CASE WHEN a >= 0 THEN sqrt(a) END", "a", True)
_number("f19_cos", s.cos, "cos(a)", "a", True)
_number("f20_sin", s.sin, "sin(a)", "a", True)
_number("f21_add", s.add, "a + b", "ab", True)
_number("f22_subtract", s.subtract, "a - b", "ab", True)
_number("f23_multiply", s.multiply, "a * b", "ab", True)
_number("f24_divide", s.divide, "CASE WHEN b <> 0 THEN a / b END", "ab", True)
_number("f25_protected_divide", s.protected_divide, _known("ab", "CASE WHEN abs(b) > 0.001 THEN a / b ELSE 1.0 END"), "ab", True)
_number("f26_power", lambda a, i: s.power(F.abs(a) + 0.5, i.cast("double") / 4), _known("ai", "pow(abs(a) + 0.5, CAST(i AS DOUBLE) / 4)"), "ai", True)
_number("f27_min", s.minimum, _known("ab", "least(a, b)"), "ab", True)
_number("f28_max", s.maximum, _known("ab", "greatest(a, b)"), "ab", True)
_number("f29_equals_constant", lambda f: s.equals_constant(f, "R"), "flag = 'R'", ["flag"])
_number("f30_stump", lambda a: s.stump(a, 0.5), "a >= 0.5", "a")
_number("f31_greater", s.greater, "a > b", "ab")
_number("f33_field", lambda a, b: s.field(F.struct(a.alias("x"), b.alias("y")), "y"), "b", "ab", True)
_number("f38_scalar_vote", lambda p: s.scalar_vote(p, 0.75), "(2 * CAST(p AS DOUBLE) - 1) * 0.75", "p")
_number("e03_function_application", lambda a, b: s.add(s.multiply(a, a), s.divide(a, b)), "a * a + CASE WHEN b <> 0 THEN a / b END", "ab", True)

KNOTS = 11


def f32_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = numbers(spark, sf_dir)
    knots = s.percentile_knots(df, "c", KNOTS)
    return df.select("k", F.round(s.normalise(F.col("c"), knots), 6).alias("result"))


QUERIES["f32_normalise"] = f32_normalise
ORACLE_SQL["f32_normalise"] = f"""
WITH x AS {_NUMBERS_SQL[:-1]}), o AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS pos, count(*) OVER () AS n FROM x WHERE c IS NOT NULL),
w AS (SELECT CAST(floor(g * (n - 1) / {KNOTS - 1}) AS BIGINT) AS pos, g FROM range({KNOTS}) t(g), (SELECT DISTINCT n FROM o)),
p AS (SELECT g, c AS v, lead(c) OVER (ORDER BY g) AS nxt FROM w JOIN o USING (pos))
SELECT x.k, round(CASE WHEN x.c IS NULL THEN NULL WHEN x.c <= (SELECT min(v) FROM p) THEN 0.0 WHEN x.c >= (SELECT max(v) FROM p) THEN 1.0
  ELSE (p.g + (x.c - p.v) / (p.nxt - p.v)) / {KNOTS - 1} END, 6) AS result
FROM x LEFT JOIN p ON x.c >= p.v AND x.c < p.nxt"""


# vectors: e is a dense vector, o the one of the next id half its length away, m a sparse one

_VECTORS_SQL = """(SELECT vec_id AS k, CASE WHEN vec_id % 13 = 0 THEN NULL ELSE list_transform(embedding[1:32], lambda x: CAST(CASE WHEN abs(x) < 0.05 THEN 0 ELSE x END AS DOUBLE)) END AS e,
  list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE)) AS o, label % 2 = 0 AS t FROM embeddings)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    double = F.transform("embedding", lambda x: x.cast("double"))
    small = F.transform("embedding", lambda x: F.when(F.abs(x) < F.lit(0.05), F.lit(0).cast("float")).otherwise(x).cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), F.when(F.col("vec_id") % 13 != 0, F.slice(small, 1, 32)).alias("e"), F.slice(double, 33, 32).alias("o"), (F.col("label") % 2 == 0).alias("t"))


def _vector(name: str, made: Callable[..., Column], sql: str, arguments: str, rounded: bool = True, listed: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = made(*(F.col(x) for x in arguments))
        out = F.array_join(F.transform(out, lambda x: F.format_string("%.4f", F.round(x, 4) + 0.0)), ",") if listed else F.round(out, 5) if rounded else out
        return vectors(spark, sf_dir).select("k", out.alias("result"))

    sql = f"array_to_string(list_transform({sql}, lambda x: printf('%.4f', round(x, 4) + 0.0)), ',')" if listed else f"round({sql}, 5)" if rounded else sql
    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT k, {sql} AS result FROM {_VECTORS_SQL}"


_zip = lambda f: f"list_transform(list_zip(e, o), lambda z: {f})"
_each = lambda f: f"list_transform(e, lambda x: {f})"
_number_of = lambda sql: f"CASE WHEN e IS NOT NULL THEN {sql} END"

_vector("f34_length", s.length, "CAST(len(e) AS INTEGER)", "e", False)
_vector("f35_element", lambda e: s.element(e, 3), "e[4]", "e")
_vector("f37_extremums", lambda e: v.extremums(e)["argmin"] * 100 + v.extremums(e)["argmax"], "CAST((list_position(e, list_min(e)) - 1) * 100 + list_position(e, list_max(e)) - 1 AS INTEGER)", "e", False)
_vector("f39_vector_vote", lambda t, o: s.vector_vote(t, o), "list_transform(o, lambda x: x * CASE WHEN t THEN 1.0 ELSE -1.0 END)", "to", listed=True)
_vector("v01_dot", v.dot, _number_of(f"list_sum({_zip('z[1] * z[2]')})"), "eo")
_vector("v01_sparse_dot", lambda e, o: v.sparse_dot(v.to_sparse(e), o), _number_of(f"list_sum({_zip('z[1] * z[2]')})"), "eo")
_vector("v02_l0_norm", v.l0_norm, "CAST(len(list_filter(e, lambda x: x <> 0)) AS INTEGER)", "e", False)
_vector("v03_l1_norm", v.l1_norm, f"list_sum({_each('abs(x)')})", "e")
_vector("v04_sum_of_squares", v.sum_of_squares, f"list_sum({_each('x * x')})", "e")
_vector("v04_l2_norm", v.l2_norm, f"sqrt(list_sum({_each('x * x')}))", "e")
_vector("v05_distance", v.distance, _number_of(f"sqrt(list_sum({_zip('(z[1] - z[2]) * (z[1] - z[2])')}))"), "eo")
_vector("v06_add", v.add, _number_of(_zip("z[1] + z[2]")), "eo", listed=True)
_vector("v06_subtract", v.subtract, _number_of(_zip("z[1] - z[2]")), "eo", listed=True)
_vector("v06_scale", lambda e: v.scale(e, 2.5), _each("x * 2.5"), "e", listed=True)
_vector("v06_divide", lambda e: v.divide(e, 4), _each("x / 4"), "e", listed=True)
_vector("v06_add_weighted", lambda e, o: v.add_weighted(e, o, 0.5), _number_of(_zip("z[1] + 0.5 * z[2]")), "eo", listed=True)
_vector("v07_argmax", v.argmax, "CAST(list_position(e, list_max(e)) - 1 AS INTEGER)", "e", False)
_vector("v07_argmin", v.argmin, "CAST(list_position(e, list_min(e)) - 1 AS INTEGER)", "e", False)
_vector("v08_entropy", lambda o: v.entropy(F.transform(o, lambda x: F.abs(x))), "-list_sum(list_transform(o, lambda x: CASE WHEN x <> 0 THEN abs(x) / list_sum(list_transform(o, lambda y: abs(y))) * log2(abs(x) / list_sum(list_transform(o, lambda y: abs(y)))) ELSE 0 END))", "o")
_vector("v09_log_sum_exp", v.log_sum_exp, f"ln(list_sum({_each('exp(x)')}))", "e")
_vector("v10_sparse_increment", lambda e: v.get(v.increment(v.to_sparse(e), 2, 1.5), 2), _number_of("e[3] + 1.5"), "e")
_vector("v10_sparse_prune", lambda e: F.size(v.prune(v.to_sparse(e), 0.5)), "CAST(len(list_filter(e, lambda x: abs(x) > 0.5)) AS INTEGER)", "e", False)
_vector("v11_sparse_to_dense", lambda e: v.to_dense(v.to_sparse(e), 32), "e", "e", listed=True)
_vector("v12_composite", lambda e, o: v.concat(e, o), _number_of("list_concat(e, o)"), "eo", listed=True)
_vector("v13_sparse_append", lambda e: v.to_dense(v.append(v.to_sparse(e), 32, 2.0), 33), _number_of("list_append(e, 2.0)"), "e", listed=True)


def f36_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = v.stats(F.col("e"))
    return vectors(spark, sf_dir).select("k", *(F.round(x[c], 5).alias(c) for c in ("mean", "stddev", "min", "max", "sum", "l1", "l2")), x["l0"].alias("l0"))


QUERIES["f36_stats"] = f36_stats
ORACLE_SQL["f36_stats"] = f"""SELECT k, round(list_avg(e), 5) AS mean, CASE WHEN e IS NOT NULL THEN round(sqrt(greatest(list_sum({_each('x * x')}) / len(e) - list_avg(e) * list_avg(e), 0)), 5) END AS stddev, round(list_min(e), 5) AS min, round(list_max(e), 5) AS max,
  round(list_sum(e), 5) AS sum, round(list_sum({_each('abs(x)')}), 5) AS l1, round(sqrt(list_sum({_each('x * x')})), 5) AS l2, CAST(len(list_filter(e, lambda x: x <> 0)) AS INTEGER) AS l0 FROM {_VECTORS_SQL}"""
