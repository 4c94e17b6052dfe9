"""Further queries: one for each inventory row that the other modules cover only within another query."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import scalar, stats
from larkspur.operators import frame, pareto, sampling, split, trees
from larkspur.plans import expr, programs
from larkspur.plans.analytics import orders
from larkspur.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def facts(spark: SparkSession, **values) -> DataFrame:
    """One row of values."""
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))


# tables


@query("SELECT o_orderkey, o_totalprice FROM orders")
def t10_clone(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")


@query("SELECT CAST(0 AS BIGINT) AS rows, 'x1 double,x2 double,y boolean' AS columns")
def t14_schema_from_domain(spark, sf_dir):
    e = frame.empty(spark, {"x1": "double", "x2": "double"}, ("y", "boolean"))
    return e.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(",".join(f"{n} {t}" for n, t in e.dtypes)))


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 7")
def t21_top_n(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("row_id"), "s_acctbal")
    return frame.top(s, 7, c("s_acctbal").desc()).select(c("row_id").alias("s_suppkey"), "s_acctbal")


@query("SELECT 'l_quantity,l_extendedprice,l_discount,l_tax' AS inputs, 'l_linestatus' AS target")
def t27_roles(spark, sf_dir):
    inputs, target = frame.roles(table(spark, sf_dir, "lineitem"))
    return facts(spark, inputs=",".join(inputs), target=target)


@query("SELECT c_nationkey AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_union_bag(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(c("c_nationkey").alias("n")).unionByName(table(spark, sf_dir, "supplier").select(c("s_nationkey").alias("n")))


@query("SELECT DISTINCT p_size, p_brand FROM part")
def set_distinct(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_size", "p_brand").dropDuplicates()


# functions


@query("SELECT l_orderkey * 10 + l_linenumber AS k, round(l_quantity * l_discount + l_tax, 6) AS y FROM lineitem")
def f40_vectorised_function(spark, sf_dir):
    """A function of pandas Series: what is left for what no expression can say."""
    f = scalar.on_columns(_affine)
    return table(spark, sf_dir, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("k"), F.round(f("l_quantity", "l_discount", "l_tax"), 6).alias("y"))


def _affine(a: pd.Series, b: pd.Series, d: pd.Series) -> pd.Series:
    return a * b + d


@query("SELECT l_orderkey * 10 + l_linenumber AS k, CAST(3 AS INTEGER) AS count, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS variance FROM lineitem")
def a05_aggregator_of_target(spark, sf_dir):
    """The aggregator that a double target takes, and given moments."""
    x = table(spark, sf_dir, "lineitem")
    s = stats.for_target("double")(c("l_quantity"), c("l_discount"), c("l_tax"))
    k = stats.constant_moments()
    return x.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("k"), s["count"].alias("count"), k["mean"].alias("mean"), k["variance"].alias("variance"))


@query("SELECT c_mktsegment, round(avg(c_acctbal), 6) AS mean, count(*) AS n, round(var_pop(c_acctbal), 4) AS variance, round(CASE WHEN var_pop(c_acctbal) > 2.3e-16 THEN sqrt(var_pop(c_acctbal)) ELSE 0 END, 6) AS stddev FROM customer GROUP BY 1")
def a07_variance_and_deviation(spark, sf_dir):
    x = c("c_acctbal")
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.round(F.avg(x), 6).alias("mean"), F.count(x).alias("n"), F.round(stats.variance(x), 4).alias("variance"), F.round(stats.stddev(x), 6).alias("stddev"))


# expressions and programs


@query("SELECT 7 AS size, 4 AS depth, 3 AS inner, 4 AS leaves, '((x * x) + sin((x - y)))' AS text, '((y * x) + sin((x - y)))' AS substituted, 2 AS depth_of_five")
def e07_tree_utilities(spark, sf_dir):
    x, y = expr.Variable("x"), expr.Variable("y")
    e = expr.Apply("+", (expr.Apply("*", (x, x)), expr.Apply("sin", (expr.Apply("-", (x, y)),))))
    inner = len(e.inner())
    return facts(spark, size=e.size() - 1, depth=e.depth(), inner=inner - 1, leaves=len(e.leaves()), text=str(e), substituted=str(e.substitute(2, y)), depth_of_five=e.depth_of(5))


@query("SELECT i AS row_id, round(x * x * x * x + x * x * x + x * x + x, 6) AS y FROM (SELECT i, -1 + i / 10.0 AS x FROM range(20) t(i))")
def g03_postfix_program(spark, sf_dir):
    """The quartic as a postfix program, run as a column."""
    e = programs.from_postfix(["x", "x", "*", "x", "*", "x", "*", "x", "x", "*", "x", "*", "+", "x", "x", "*", "+", "x", "+"])
    return frame.interval(spark, 0, 20).select("row_id", (-1 + c("row_id") / 10).alias("x")).select("row_id", F.round(e.column(), 6).alias("y"))


@query("SELECT i AS row_id, (bit_count(i) % 2) = 1 AS odd FROM range(64) t(i)")
def f06_parity(spark, sf_dir):
    """Parity of six bits from strict boolean functions alone."""
    bits = [expr.Variable(f"b{k}") for k in range(6)]
    xor = lambda a, b: expr.Apply("not", (expr.Apply("equal", (a, b)),))
    e = bits[0]
    for b in bits[1:]:
        e = xor(e, b)
    rows = frame.interval(spark, 0, 64).select("row_id", *((F.shiftright("row_id", k).bitwiseAND(F.lit(1)) == 1).alias(f"b{k}") for k in range(6)))
    return rows.select("row_id", e.column().alias("odd"))


@query("SELECT i AS row_id, ((i >> (2 + 2 * ((i >> 1) & 1) // 2 * 0 + (((i & 1) << 1) | ((i >> 1) & 1)))) & 1) = 1 AS y FROM range(64) t(i)")
def f07_multiplexer(spark, sf_dir):
    """Two address bits, the more significant first, choose one of four."""
    a0, a1, *d = (expr.Variable(f"b{k}") for k in range(6))
    pick = lambda q, x, y: expr.Apply("if", (q, x, y))
    e = pick(a0, pick(a1, d[3], d[2]), pick(a1, d[1], d[0]))
    rows = frame.interval(spark, 0, 64).select("row_id", *((F.shiftright("row_id", k).bitwiseAND(F.lit(1)) == 1).alias(f"b{k}") for k in range(6)))
    return rows.select("row_id", e.column().alias("y"))


# splits and trees


@query("""WITH x AS (SELECT l_tax > 0.04 AS b, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), s AS (SELECT b, count(*)::DOUBLE AS n, stddev_pop(y) AS sd, sqrt(greatest(var_pop(y) * count(*) - power(covar_pop(x, y) * count(*), 2) / (var_pop(x) * count(*)), 0) / (count(*) - 1)) AS r FROM x GROUP BY b),
w AS (SELECT count(*)::DOUBLE AS n, stddev_pop(y) AS sd, sqrt((var_pop(y) * count(*) - power(covar_pop(x, y) * count(*), 2) / (var_pop(x) * count(*))) / (count(*) - 1)) AS r FROM x)
SELECT round(w.sd - (SELECT sum(n * sd) FROM s) / w.n, 5) AS sdr, round(w.r - (SELECT sum(n * r) FROM s) / w.n, 5) AS mauve FROM w""")
def i12_split_qualities(spark, sf_dir):
    """Deviation reduction and its form about lines, of one split."""
    x = table(spark, sf_dir, "lineitem").select((c("l_tax") > 0.04).alias("b"), c("l_quantity").alias("x"), (c("l_extendedprice") / 1000).alias("y"))
    return x.agg(F.round(split.deviation_reduction(c("b"), c("y")), 5).alias("sdr"), F.round(split.residual_reduction(c("b"), c("x"), c("y")), 5).alias("mauve"))


@query("SELECT l_quantity AS x, lag(l_quantity) OVER (ORDER BY l_quantity) AS prior, sum(count(*)) OVER (ORDER BY l_quantity)::DOUBLE AS up_n, round(sum(sum(l_tax)) OVER (ORDER BY l_quantity), 4) AS up_s FROM lineitem GROUP BY 1")
def i09_sorted_statistics(spark, sf_dir):
    """What the tree of an attribute's values holds: sums up to each value."""
    g = table(spark, sf_dir, "lineitem").groupBy(c("l_quantity").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("l_tax").alias("s"))
    return split.running_sums(g, "x", ["n", "s"]).select("x", "prior", "up_n", F.round("up_s", 4).alias("up_s"))


@query("""WITH x AS (SELECT l_returnflag = 'R' AS b, l_extendedprice / 1000 AS y FROM lineitem) SELECT round((var_pop(y) - (SELECT sum(n * v) / sum(n) FROM (SELECT count(*) AS n, var_pop(y) AS v FROM x GROUP BY b))) / var_pop(y), 8) AS score FROM x""")
def d04_boolean_split(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select((c("l_returnflag") == "R").alias("b"), (c("l_extendedprice") / 1000).alias("y"))
    return split.score_condition(x, c("b"), split.VarianceReduction(("y",))).select(F.round("score", 8).alias("score"))


@query("""WITH g AS (SELECT l_quantity AS x, count(*)::DOUBLE AS n, sum(l_extendedprice / 1000) AS s, sum(l_extendedprice / 1000 * l_extendedprice / 1000) AS q FROM lineitem GROUP BY 1),
p AS (SELECT x, lead(x) OVER w AS nx, sum(n) OVER w AS n1, sum(s) OVER w AS s1, sum(q) OVER w AS q1 FROM g WINDOW w AS (ORDER BY x)), t AS (SELECT sum(n) AS n, sum(s) AS s, sum(q) AS q FROM g),
b AS (SELECT (x + nx) / 2 AS threshold FROM p, t WHERE nx IS NOT NULL ORDER BY 1 - (q1 - s1 * s1 / n1 + (q - q1) - (s - s1) * (s - s1) / (n - n1)) / (q - s * s / n) DESC LIMIT 1)
SELECT l_quantity >= threshold AS upper, round(avg(l_extendedprice / 1000), 5) AS prediction, CAST(1 AS INTEGER) AS tests, CAST(3 AS INTEGER) AS depth FROM lineitem, b GROUP BY 1""")
def d06_tree_of_depth_one(spark, sf_dir):
    """A tree of one test predicts the means of the two sides of the best threshold."""
    x = table(spark, sf_dir, "lineitem").select("l_quantity", (c("l_extendedprice") / 1000).alias("y"))
    g = trees.grow(x, ["l_quantity"], split.VarianceReduction(("y",)), max_depth=1)[0]
    out = x.select(g.tree.children[0].column().alias("upper"), F.round(g.tree.column(), 5).alias("prediction")).distinct()
    return out.select("upper", "prediction", F.lit(g.tests()).alias("tests"), F.lit(g.tree.depth()).alias("depth"))


@query("SELECT l_orderkey * 10 + l_linenumber AS k, CAST(i AS INTEGER) AS input, CASE i WHEN 0 THEN l_quantity WHEN 1 THEN l_discount ELSE l_tax END AS value FROM lineitem, range(3) t(i)")
def d11_candidate_inputs(spark, sf_dir):
    """All numeric inputs in one long table."""
    names = frame.roles(table(spark, sf_dir, "lineitem").drop("l_extendedprice"))[0]
    x = table(spark, sf_dir, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("k"), F.posexplode(F.array(*names)).alias("input", "value"))
    return x.select("k", "input", "value")


# metrics


# Pareto sets


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b, (a.s_acctbal >= b.s_acctbal AND a.s_suppkey <= b.s_suppkey AND (a.s_acctbal > b.s_acctbal OR a.s_suppkey < b.s_suppkey)) AS dominates, (a.s_acctbal > b.s_acctbal AND a.s_suppkey < b.s_suppkey) AS strictly FROM supplier a JOIN supplier b USING (s_nationkey)")
def p01_dominance(spark, sf_dir):
    """Which of two suppliers of a nation dominates the other, by balance and key."""
    n = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    a, b = (n.select("s_nationkey", *(c(x).alias(f"{p}_{x}") for x in ("s_suppkey", "s_acctbal"))) for p in "ab")
    o = [("s_acctbal", 1), ("s_suppkey", -1)]
    return a.join(b, "s_nationkey").select(c("a_s_suppkey").alias("a"), c("b_s_suppkey").alias("b"), pareto.dominates(o, "a_", "b_").alias("dominates"), pareto.dominates(o, "a_", "b_", True).alias("strictly"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_retailprice, p_partkey) - 1 AS place FROM part")
def p09_lexicographic(spark, sf_dir):
    """The place of every part in the lexicographic order of size and price."""
    x = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    keys = [k.alias(f"k{i}") for i, k in enumerate(pareto.lexicographic_keys([("p_size", 1), ("p_retailprice", -1), ("p_partkey", -1)]))]
    return frame.with_row_id(x, *keys, name="place").select("p_partkey", "place")


# samplers, search, bandits


@query("SELECT l_linenumber AS k, CAST(least(greatest(l_linenumber * 1.5, 2), 8) AS DOUBLE) AS projected FROM lineitem GROUP BY 1")
def r05_projection(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(c("l_linenumber").alias("k")).distinct().select("k", sampling.projected(c("k") * 1.5, 2.0, 8.0).alias("projected"))


_KL = "(SELECT event_type AS arm, count(*)::DOUBLE AS n, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS p, (SELECT count(*) FROM events)::DOUBLE AS t FROM events GROUP BY 1)"


def _grid(names: str, low: float, span: float) -> str:
    """SQL of inputs by rule: the i-th cycles through a prime number of values."""
    primes = [101, 103, 107, 109, 113, 127, 131]
    return "(SELECT i AS row_id, " + ", ".join(f"{low} + {span} * ((i * {37 + 16 * k}) % {primes[k]}) / {primes[k] - 1} AS x{k + 1}" for k in range(len(names.split()))) + " FROM range(2000) t(i))"


def _grid_rows(spark: SparkSession, n: int, low: float, span: float) -> tuple[DataFrame, list]:
    primes = [101, 103, 107, 109, 113, 127, 131]
    df = frame.interval(spark, 0, 2000).select("row_id", *((low + span * ((c("row_id") * (37 + 16 * k)) % primes[k]) / (primes[k] - 1)).alias(f"x{k + 1}") for k in range(n)))
    return df, [c(f"x{k + 1}") for k in range(n)]


_FIVE, _SEVEN = "x x x x x", "x x x x x x x"


@query(f"""SELECT row_id, round(CASE WHEN x1 >= 0.5 THEN 1 + 2 * x2 + 3 * x3 - exp(-2 * (x4 + x5)) ELSE 1 - 1.2 * x2 - 3.1 * x3 + exp(-3 * (x4 - x5)) END, 6) AS lexp,
round(CASE WHEN x1 >= 0.5 THEN 1 + 1.5 * x2 + x3 + sin(2 * (x4 + x5)) * exp(-2 * (x2 + x4)) ELSE -1 - 2 * x2 - x3 + sin(3 * (x4 + x5)) * exp(-3 * (x3 - x4)) END, 6) AS losc,
round(10 * sin(pi() * x1 * x2) + 20 * (x3 - 0.5) * (x3 - 0.5) + 10 * x4 + 5 * x5, 6) AS friedman FROM {_grid(_FIVE, 0.0, 1.0)}""")
def t13_regression_problems(spark, sf_dir):
    """Three closed-form problems over a grid of five inputs."""
    from larkspur.functions import problems

    df, x = _grid_rows(spark, 5, 0.0, 1.0)
    return df.select("row_id", *(F.round(problems.PROBLEMS[n].target(x), 6).alias(n) for n in ("lexp", "losc", "friedman")))


@query(f"SELECT row_id, round(CASE WHEN x1 < 0 THEN 3 + 3 * x2 + 2 * x3 + 3 * x4 ELSE -3 + 3 * x5 + 2 * x6 + x7 END, 6) AS y FROM {_grid(_SEVEN, -1.0, 2.0)}")
def t13_cart_problem(spark, sf_dir):
    from larkspur.functions import problems

    df, x = _grid_rows(spark, 7, -1.0, 2.0)
    return df.select("row_id", F.round(problems.cart(x), 6).alias("y"))


@query("SELECT i AS row_id, bit_count(i) % 2 = 1 AS parity FROM range(256) t(i)")
def t13_parity_problem(spark, sf_dir):
    from larkspur.functions import problems

    return problems.parity(spark, 8).select("row_id", c("y").alias("parity"))


@query("SELECT i AS row_id, ((i >> (3 + ((i & 1) * 4 + ((i >> 1) & 1) * 2 + ((i >> 2) & 1)))) & 1) = 1 AS y FROM range(2048) t(i)")
def t13_multiplexer_problem(spark, sf_dir):
    from larkspur.functions import problems

    return problems.multiplexer(spark, 3).select("row_id", "y")
