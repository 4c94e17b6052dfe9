"""Queries of random choices, searches and models, whose outputs SQL makes again from the same digests."""

from __future__ import annotations

import io
import random
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import metrics as m
from larkspur.operators import bandit, frame, pareto, sampling, search, split, trees
from larkspur.plans import expr, learning, programs
from larkspur.plans import sqltext as q
from larkspur.plans.analytics import _ORDERS, orders
from larkspur.plans.store import shared_folder
from larkspur.session import table
from larkspur.sources import files
from larkspur.streaming import learners

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


def _six(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(x, digits).alias(x) if t == "double" else c(x) for x, t in df.dtypes))


# tables


@query(f"SELECT row_number() OVER (ORDER BY price DESC NULLS LAST, row_id) - 1 AS place, o_orderkey, price FROM {_ORDERS}")
def t06_order_desc_nulls(spark, sf_dir):
    """The place of every order in the order that the flag `increasing` gives: downwards, nulls last."""
    o = orders(spark, sf_dir).select("row_id", "o_orderkey", "price")
    down = [F.coalesce(-c("price"), F.lit(float("inf"))).alias("k"), c("row_id").alias("i")]
    return frame.with_row_id(o, *down, name="place").select("place", "o_orderkey", "price")


@query(f"SELECT row_number() OVER (ORDER BY {q.key(3, 'row_id')}, row_id) - 1 AS place, o_orderkey FROM {_ORDERS}")
def t07_shuffle(spark, sf_dir):
    return frame.shuffled_places(orders(spark, sf_dir).select("row_id", "o_orderkey"), 3).select("place", "o_orderkey")


@query(f"SELECT row_id, o_orderkey, row_number() OVER (ORDER BY {q.key(5, 'row_id')}, row_id) - 1 >= floor((SELECT count(*) FROM orders) * (1 - 0.3)) AS test FROM {_ORDERS}")
def t11_train_test(spark, sf_dir):
    o = orders(spark, sf_dir).select("row_id", "o_orderkey")
    return frame.train_test(o, 0.3, o.count(), 5)


@query(f"SELECT row_id, o_orderkey FROM (SELECT * FROM {_ORDERS} ORDER BY {q.key(4, 'row_id')}, row_id LIMIT 300)")
def t16_subset(spark, sf_dir):
    """Exactly k rows, drawn without replacement: k is the operator's argument."""
    return frame.subset(orders(spark, sf_dir).select("row_id", "o_orderkey"), 300, 4)


@query(f"""WITH n AS (SELECT count(*) AS n FROM orders), d AS (SELECT CAST(i // n AS INTEGER) AS bag, CAST(floor({q.uniform(6, 'i')} * n) AS BIGINT) AS row_id FROM n, range((SELECT 3 * n FROM n)) t(i))
SELECT row_id, o_orderkey, bag, count(*) AS multiplicity FROM d JOIN {_ORDERS} USING (row_id) GROUP BY ALL""")
def t17_bootstrap(spark, sf_dir):
    o = orders(spark, sf_dir).select("row_id", "o_orderkey")
    return frame.bootstrap(o, o.count(), 6, 3)


@query(f"SELECT row_id, o_orderkey FROM {_ORDERS} ORDER BY {q.key(11, 'row_id')}, row_id LIMIT 1")
def t18_random_row(spark, sf_dir):
    return frame.random_row(orders(spark, sf_dir).select("row_id", "o_orderkey"), 11)


@query(f"SELECT round(min(l_quantity) + {q.uniform(9, chr(39) + 'l_quantity' + chr(39))} * (max(l_quantity) - min(l_quantity)), 9) AS threshold FROM lineitem")
def d05_random_threshold(spark, sf_dir):
    return _six(split.random_threshold(table(spark, sf_dir, "lineitem"), "l_quantity", 9), 9)


# samplers

_KEYS = "(SELECT l_orderkey * 10 + l_linenumber AS k FROM lineitem)"


def _keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("k"))


@query(f"""SELECT k, round({q.uniform(6, 'k', low=-1, high=4)}, 6) AS u, round({q.gaussian(1, 'k', '2.0e0', '3.0e0')}, 6) AS g, round({q.laplace(2, 'k', 1.0, 2.0)}, 6) AS l,
CAST(CASE WHEN {q.uniform(5, 'k')} * 8 < 1 THEN 0 WHEN {q.uniform(5, 'k')} * 8 < 3 THEN 1 ELSE 2 END AS INTEGER) AS c FROM {_KEYS}""")
def r02_variates(spark, sf_dir):
    """A uniform, a normal, a Laplace and a categorical number for each item."""
    k = c("k")
    return _six(_keys(spark, sf_dir).select("k", sampling.uniform(6, k, -1, 4).alias("u"), sampling.gaussian(1, k, 2.0, 3.0).alias("g"), sampling.laplace(2, k, 1.0, 2.0).alias("l"), sampling.categorical(5, k, [1, 2, 5]).alias("c")))


@query(f"""WITH x AS (SELECT c_custkey AS k, {q.gamma(3, 'c_custkey', 2.5, 2.0, 4)} AS a, {q.gamma(4, 'c_custkey', 2.0, 1.0)} AS x, {q.gamma(4 + 524287, 'c_custkey', 3.0, 1.0)} AS y FROM customer)
SELECT k, round(a, 6) AS a, round(x / (x + y), 6) AS b FROM x""")
def r04_gamma_and_beta(spark, sf_dir):
    """Gamma and Beta numbers for each customer."""
    k = c("c_custkey")
    return _six(table(spark, sf_dir, "customer").select(k.alias("k"), sampling.gamma(3, k, 2.5, 2.0, 4).alias("a"), sampling.beta(4, k, 2.0, 3.0).alias("b")))


@query(f"""WITH s AS (SELECT k, i + 1 AS x, row_number() OVER (PARTITION BY k ORDER BY {q.key(4, 'k', 'i')}, i) AS place FROM (SELECT c_custkey AS k FROM customer), range(9) t(i)),
g AS (SELECT c_custkey AS k, CASE WHEN {q.uniform(3, 'c_custkey')} < 0.25 THEN 1.0 ELSE 0.0 END AS mixed, {q.gaussian(5, 'c_custkey')} AS a, {q.gaussian(6, 'c_custkey')} AS b FROM customer)
SELECT g.k, CAST(any_value(mixed) AS DOUBLE) AS mixed, string_agg(x, ',' ORDER BY x) AS some, round(any_value(a / (abs(a) + abs(b))), 6) AS u0, round(any_value(b / (abs(a) + abs(b))), 6) AS u1 FROM g JOIN s USING (k) WHERE place <= 4 GROUP BY g.k""")
def r07_mixtures_and_subsets(spark, sf_dir):
    """A mixture, a subset of an array, and a vector divided by its norm, for each customer."""
    k = c("c_custkey")
    unit = sampling.normalised_by_l1([sampling.gaussian(5, k), sampling.gaussian(6, k)])
    some = F.concat_ws(",", F.transform(sampling.subset_of(4, k, F.sequence(F.lit(1), F.lit(9)), 4), lambda x: x.cast("string")))
    return _six(table(spark, sf_dir, "customer").select(k.alias("k"), sampling.mixture(3, k, 0.25, F.lit(0.0), F.lit(1.0)).alias("mixed"), some.alias("some"), unit[0].alias("u0"), unit[1].alias("u1")))


@query(f"SELECT c_custkey AS k, round({q.uniform(7, 'c_custkey')}, 6) AS v0, round({q.uniform(24, 'c_custkey')}, 6) AS v1, round({q.uniform(41, 'c_custkey')}, 6) AS v2 FROM customer")
def r12_vector_of_samples(spark, sf_dir):
    v = sampling.vector_of(7, c("c_custkey"), 3)
    return _six(table(spark, sf_dir, "customer").select(c("c_custkey").alias("k"), *(v[i].alias(f"v{i}") for i in range(3))))


@query(f"SELECT o_orderkey, CAST(['wait', 'ship', 'hold'][1 + CAST(floor({q.uniform(8, 'o_orderkey')} * 3) AS BIGINT)] AS VARCHAR) AS action FROM orders")
def r14_random_action(spark, sf_dir):
    actions = F.array(*(F.lit(a) for a in ("wait", "ship", "hold")))
    return table(spark, sf_dir, "orders").select("o_orderkey", sampling.random_action(8, c("o_orderkey"), actions).alias("action"))


_BOX = [(0.0, 1.0), (-1.0, 1.0), (5.0, 9.0)]


@query("SELECT i AS row_id, " + ", ".join(f"round({q.number(lo)} + (row_number() OVER (ORDER BY {q.key(3 + d, 'i')}, i) - 1 + {q.uniform(3 + 31 * d + 1, 'i')}) / 500 * {q.number(hi - lo)}, 6) AS x{d}" for d, (lo, hi) in enumerate(_BOX)) + " FROM range(500) t(i)")
def r10_latin_hypercube(spark, sf_dir):
    """The points of a design: of 500 intervals each coordinate uses each once."""
    return _six(sampling.latin_hypercube(spark, 500, [lo for lo, _ in _BOX], [hi for _, hi in _BOX], 3))


_STEPS = "(SELECT n_regionkey AS step, n_nationkey AS k, n_nationkey / 25 AS f0, length(n_name) / 10 AS f1, n_nationkey = min(n_nationkey) OVER (PARTITION BY n_regionkey) AS chosen FROM nation)"


@query(f"""WITH s AS {_STEPS}, z AS (SELECT step, avg(f0) AS a0, avg(f1) AS a1, ln(count(*)) AS h FROM s GROUP BY step),
w AS (SELECT 0.05e0 * sum(f0 - a0) AS w0, 0.05e0 * sum(f1 - a1) AS w1, -sum(h) AS before FROM s JOIN z USING (step) WHERE chosen),
e AS (SELECT step, ln(sum(exp(w0 * f0 + w1 * f1))) AS lse, any_value(w0) AS w0, any_value(w1) AS w1, any_value(before) AS before FROM s, w GROUP BY step)
SELECT round(any_value(before), 6) AS before, round(any_value(e.w0), 6) AS w0, round(any_value(e.w1), 6) AS w1, round(sum(e.w0 * f0 + e.w1 * f1 - lse), 6) AS after FROM s JOIN e USING (step) WHERE chosen""")
def r13_log_linear_policy(spark, sf_dir):
    """The log-likelihood of a policy that chooses the first nation of each region, and after one step up its gradient."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", (c("n_nationkey") / 25).alias("f0"), (F.length("n_name") / 10).alias("f1")).toPandas()  # 25 rows
    steps = [(g.sort_values("n_nationkey")[["f0", "f1"]].to_numpy(float), 0) for _, g in n.groupby("n_regionkey")]
    p = sampling.LogLinear(2, 0.05)
    before = p.log_likelihood(steps)[0]
    after = p.reinforce(steps).log_likelihood(steps)[0]
    return _six(spark.createDataFrame([(before, *map(float, p.weights), after)], "before double, w0 double, w1 double, after double"))


# trees of one test, bagged and boosted


def _best_split(rows: str, x: str, y: str, w: str, by: str = "") -> str:
    """SQL of the best threshold of x by variance reduction, and the means on both sides; rows has x, y, w (and `by`)."""
    part = f"PARTITION BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"""SELECT {head}threshold, low, high FROM (SELECT {head}(v.x + v.prior) / 2 AS threshold, s1 / w1 AS low, (s0 - s1) / (w0 - w1) AS high, row_number() OVER ({part} ORDER BY (w1 * (q1 / w1 - power(s1 / w1, 2)) + (w0 - w1) * ((q0 - q1) / (w0 - w1) - power((s0 - s1) / (w0 - w1), 2))), p.x) AS place
FROM (SELECT {head}x, sum(w) OVER b AS w1, sum(s) OVER b AS s1, sum(qq) OVER b AS q1, sum(w) OVER a AS w0, sum(s) OVER a AS s0, sum(qq) OVER a AS q0 FROM (SELECT {head}{x} AS x, sum({w}) AS w, sum({w} * {y}) AS s, sum({w} * {y} * {y}) AS qq FROM {rows} WHERE {w} > 0 GROUP BY ALL)
WINDOW b AS ({part} ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS ({part})) p JOIN (SELECT x, lag(x) OVER (ORDER BY x) AS prior FROM (SELECT DISTINCT {x} AS x FROM {rows})) v USING (x) WHERE w1 IS NOT NULL) WHERE place = 1"""


@query(f"""WITH x AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS s, p_retailprice AS y FROM part), b AS (SELECT p_partkey, s, y, t, CAST({q.poisson(q.uniform(1, 'p_partkey', 't'))} AS DOUBLE) AS w FROM x, range(3) r(t)),
t AS ({_best_split('b', 's', 'y', 'w', 't')})
SELECT p_partkey, round(avg(CASE WHEN s >= threshold THEN high ELSE low END), 5) AS prediction FROM x, t GROUP BY p_partkey""")
def d08_ensemble(spark, sf_dir):
    """The mean of three stumps, each on its own bootstrap of the parts."""
    x = table(spark, sf_dir, "part").select(c("p_size").cast("double").alias("s"), c("p_retailprice").alias("y"), c("p_partkey").alias("row_id"))
    members = [g.tree for g in trees.grow(x, ["s"], split.VarianceReduction(("y",)), 3, max_depth=1, bags=True)]
    return x.select(c("row_id").alias("p_partkey"), F.round(expr.Aggregate(tuple(members)).column(), 5).alias("prediction"))


@query(f"""WITH x AS (SELECT l_quantity AS a, l_extendedprice / 1000 AS y, 1.0e0 AS w FROM lineitem), m AS (SELECT avg(y) AS m FROM x), x0 AS (SELECT a, y - m AS y, w FROM x, m), t0 AS ({_best_split('x0', 'a', 'y', 'w')}),
x1 AS (SELECT a, y - 0.8e0 * CASE WHEN a >= threshold THEN high ELSE low END AS y, w FROM x0, t0), t1 AS ({_best_split('x1', 'a', 'y', 'w')})
SELECT DISTINCT a AS l_quantity, round(m + 0.8e0 * CASE WHEN a >= t0.threshold THEN t0.high ELSE t0.low END + 0.8e0 * CASE WHEN a >= t1.threshold THEN t1.high ELSE t1.low END, 5) AS prediction FROM x, m, t0, t1""")
def d12_boosting(spark, sf_dir):
    """The price by quantity after two rounds of squared-loss boosting with stumps (retired learners)."""
    x = table(spark, sf_dir, "lineitem").select(c("l_quantity").alias("a"), (c("l_extendedprice") / 1000).alias("y"))
    model = trees.l2_boosting(x, ["a"], "y", 2, 0.8, max_depth=1)
    return x.select(c("a").alias("l_quantity"), F.round(model.column(), 5).alias("prediction")).distinct()


@query()
def d06_tree(spark, sf_dir):
    """The predictions of a regression tree of the price; tests hold trees against a plain recursive version."""
    x = _items(spark, sf_dir)
    g = trees.grow(x, ["q", "d", "t"], split.VarianceReduction(("y",)), max_depth=4, min_examples=50)[0]
    return x.select("k", F.round(g.tree.column(), 6).alias("prediction"))


@query()
def e08_importance(spark, sf_dir):
    """The inputs' importance in a classification tree of the return flag; a plain version is in the tests."""
    x = table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax", "l_returnflag")
    g = trees.grow(x, ["l_quantity", "l_tax"], split.InformationGain("l_returnflag", ("A", "N", "R")), max_depth=3)[0]
    return spark.createDataFrame([(k, round(v, 6)) for k, v in sorted(g.importance().items())], "input string, importance double")


@query()
def d09_forest(spark, sf_dir):
    """The votes of bagged trees over random inputs for rows that they have not seen; a plain version is in the tests."""
    size = table(spark, sf_dir, "embeddings").select(F.max(F.size("embedding"))).first()[0] or 0
    e = table(spark, sf_dir, "embeddings").select(c("vec_id").alias("row_id"), c("label").cast("string").alias("label"), *(c("embedding")[i].cast("double").alias(f"e{i}") for i in range(size)))
    labels = tuple(r.label for r in e.select("label").distinct().orderBy("label").limit(1000).collect())  # classes of a classifier are few
    model = trees.forest(e.where("row_id % 3 <> 0"), [f"e{i}" for i in range(size)], split.InformationGain("label", labels), trees=3, max_depth=2, seed=2, max_bins=32)
    votes = F.array(*(sum((v.column()[i] for v in model.children[1:]), model.children[0].column()[i]) for i in range(len(labels))))
    return e.where("row_id % 3 = 0").select("row_id", "label", F.transform(votes, lambda v: F.round(v, 6)).alias("votes"))


def _items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("k"), c("l_quantity").alias("q"), (c("l_discount") * 100).alias("d"), F.when(c("l_linenumber") % 5 != 0, c("l_tax") * 100).alias("t"), (c("l_extendedprice") / 1000).alias("y"))


# metrics


@query("SELECT l_orderkey * 10 + l_linenumber AS k, round((l_tax - 0.08) / (0 - 0.08), 6) AS scaled, 0.0::DOUBLE < 0.08 AS minimised, round(4 * power(l_tax, 3), 5) AS gradient, round((SELECT avg(l_tax) FROM lineitem), 6) AS expected FROM lineitem")
def m08_objectives(spark, sf_dir):
    """A metric's range, the mean over instances, and a gradient by central differences."""
    r = m.Range(0.08, 0.0)
    x = table(spark, sf_dir, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("k"), "l_tax")
    slope = search.central_difference(lambda v: F.pow(v, F.lit(4.0)), c("l_tax"))
    mean = x.agg(F.round(F.avg("l_tax"), 6).alias("expected"))
    return x.join(F.broadcast(mean)).select("k", F.round(r.scaled(c("l_tax")), 6).alias("scaled"), F.lit(r.minimised).alias("minimised"), F.round(slope, 5).alias("gradient"), "expected")


# search


def _bowl(x):
    return sum(((v - 0.3 * (i + 1)) * (v - 0.3 * (i + 1)) for i, v in enumerate(x[1:], 1)), (x[0] - 0.3) * (x[0] - 0.3))


_BOWL = f"(x0 - {q.number(0.3)}) * (x0 - {q.number(0.3)}) + (x1 - {q.number(0.6)}) * (x1 - {q.number(0.6)})"


def _uniform_points(n: int, seed: int) -> str:
    return f"(SELECT i, {q.uniform(seed, 'i', low=-1, high=1)} AS x0, {q.uniform(seed + 13, 'i', low=-1, high=1)} AS x1 FROM range({n}) t(i))"


@query(f"SELECT round({_BOWL}, 9) AS fitness, round(x0, 9) AS x0, round(x1, 9) AS x1 FROM {_uniform_points(20_000, 0)} ORDER BY {_BOWL}, i LIMIT 1")
def o01_random_search(spark, sf_dir):
    """The best of 20,000 points."""
    best = search.random_search(spark, search.Problem([-1.0, -1.0], [1.0, 1.0], _bowl), 20_000)
    return _six(spark.createDataFrame([(best.fitness, best.x0, best.x1)], "fitness double, x0 double, x1 double"), 9)


@query(" UNION ALL ".join(f"SELECT CAST({r} AS BIGINT) AS run, CAST({400 * (r + 1)} AS BIGINT) AS evaluations, (SELECT round(min(x0 * x0), 9) FROM (SELECT {q.uniform(r, 'i', low=-1, high=1)} AS x0 FROM range(400) t(i))) AS fitness, (SELECT round(least({', '.join(f'(SELECT min(x0 * x0) FROM (SELECT {q.uniform(s, chr(105), low=-1, high=1)} AS x0 FROM range(400) t(i)))' for s in range(r + 1))}), 9)) AS best" for r in range(5)))
def o02_repeat_and_callbacks(spark, sf_dir):
    """The best of each of five searches, and of all so far as the callback tells it."""
    p, said = search.Problem([-1.0], [1.0], lambda x: x[0] * x[0]), search.Callbacks(every=400)
    best = search.repeated(5, lambda i: search.random_search(spark, p, 400, i, said).fitness)
    rows = [(i, n, f, b) for i, (f, (n, b)) in enumerate(zip(best, said.curve))]
    return _six(spark.createDataFrame(rows, "run long, evaluations long, fitness double, best double"), 9)


def _cross_entropy_sql(population: int, selected: int, rounds: int) -> str:
    """Each round's points, their best, and the mean and deviation of those selected."""
    ctes = ["s0 AS (SELECT 0.0e0 AS m0, 2e0 / 6 AS d0, 0.0e0 AS m1, 2e0 / 6 AS d1)"]
    for r in range(rounds):
        x = [f"least(greatest({q.gaussian(101 * d + 7919 * r, 'i', f'm{d}', f'd{d}')}, -1), 1)" for d in range(2)]
        ctes.append(f"p{r} AS MATERIALIZED (SELECT i, x0, x1, {_BOWL} AS f FROM (SELECT i, {x[0]} AS x0, {x[1]} AS x1 FROM s{r}, range({population}) t(i)))")
        ctes.append(f"s{r + 1} AS MATERIALIZED (SELECT avg(x0) AS m0, stddev_pop(x0) AS d0, avg(x1) AS m1, stddev_pop(x1) AS d1 FROM (SELECT x0, x1 FROM p{r} ORDER BY f, i LIMIT {selected}))")
    every = " UNION ALL ".join(f"SELECT {r} AS r, * FROM p{r}" for r in range(rounds))
    return f"WITH {', '.join(ctes)} SELECT round(f, 7) AS fitness, round(x0, 6) AS x0, round(x1, 6) AS x1 FROM ({every}) ORDER BY f, r, i LIMIT 1"


@query(_cross_entropy_sql(200, 20, 5))
def o03_cross_entropy(spark, sf_dir):
    """The best point of five rounds of 200."""
    best = search.cross_entropy(spark, search.Problem([-1.0, -1.0], [1.0, 1.0], _bowl), 200, 20, 5)
    return spark.createDataFrame([(round(best.fitness, 7), round(best.x0, 6), round(best.x1, 6))], "fitness double, x0 double, x1 double")


@query("SELECT CAST(sum(k) AS DOUBLE) AS reward, string_agg(k, ',' ORDER BY r) AS chosen FROM (SELECT n_regionkey AS r, max(n_nationkey) AS k FROM nation GROUP BY 1)")
def o04_nested_rollout(spark, sf_dir):
    """Nested rollouts find the choice of a nation from each region of the greatest sum of keys."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey").toPandas()  # 25 rows
    choices = [sorted(g) for _, g in n.groupby("n_regionkey")["n_nationkey"]]
    best, path = search.nested_rollout((), lambda s: choices[len(s)] if len(s) < len(choices) else [], lambda s, a: (*s, a), lambda s: float(sum(s)), 2, 40, seed=3)
    return spark.createDataFrame([(float(best), ",".join(map(str, path)))], "reward double, chosen string")


@query("""WITH RECURSIVE r AS (SELECT 0 AS t, 0 AS a, 0 AS b, 0.0e0 AS sa, 0.0e0 AS sb UNION ALL SELECT t + 1, a + pick, b + 1 - pick, sa + pick * 0.1e0, sb + (1 - pick) * 0.9e0 FROM (
SELECT *, CASE WHEN a = 0 THEN 1 WHEN b = 0 THEN 0 WHEN sa / a + 2 * sqrt(ln(t + 1) / a) >= sb / b + 2 * sqrt(ln(t + 1) / b) THEN 1 ELSE 0 END AS pick FROM r WHERE t < 50))
SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM r WHERE t = 50""")
def o05_bandit_of_solvers(spark, sf_dir):
    """How often each of two solvers is run in 50 steps."""
    a, b = search.bandit_of_solvers([lambda i: 0.1, lambda i: 0.9], 50)
    return spark.createDataFrame([(a, b)], "a long, b long")


@query("""WITH x AS (SELECT p_partkey, p_retailprice / 1000 AS m, p_size / 50 AS sd FROM part), z AS (SELECT *, (1.2e0 - m) / greatest(sd, 1e-8) AS z FROM x)
SELECT p_partkey, round(-m, 5) AS greedy, round(sd - m, 5) AS optimistic, round(CASE WHEN sd < 1e-8 THEN 0 ELSE """ + q.gaussian_cdf("z") + """ END, 5) AS pi,
round(CASE WHEN sd < 1e-8 THEN 0 ELSE (1.2e0 - m) * """ + q.gaussian_cdf("z") + """ + sd * exp(-z * z / 2) / sqrt(2 * pi()) END, 5) AS ei FROM z""")
def o07_selection_criteria(spark, sf_dir):
    """Greedy, optimistic, probability of improvement and expected improvement of parts, whose price is taken for a mean and size for a deviation."""
    x = table(spark, sf_dir, "part").select("p_partkey", (c("p_retailprice") / 1000).alias("mean"), (c("p_size") / 50).alias("sd"))
    parts = {"greedy": search.greedy(c("mean")), "optimistic": search.optimistic(c("mean"), c("sd")), "pi": search.probability_of_improvement(c("mean"), c("sd"), 1.2), "ei": search.expected_improvement(c("mean"), c("sd"), 1.2)}
    return x.select("p_partkey", *(F.round(v, 5).alias(k) for k, v in parts.items()))


_LINE = "SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem"


@query(f"SELECT round(regr_intercept(y, x), 3) AS bias, round(regr_slope(y, x), 4) AS slope FROM ({_LINE})")
def o08_lbfgs(spark, sf_dir):
    """Limited-memory BFGS finds the line of least squares of price on quantity, from sums over the items."""
    x = table(spark, sf_dir, "lineitem").select(c("l_quantity").alias("x"), (c("l_extendedprice") / 1000).alias("y"))
    r = x.agg(F.count(F.lit(1)).alias("n"), *(F.avg(e).alias(k) for k, e in (("x", c("x")), ("y", c("y")), ("xx", c("x") * c("x")), ("xy", c("x") * c("y"))))).first()

    def loss(w):  # half the mean square, less a constant
        a, b = w
        grad = np.array([a + b * r.x - r.y, a * r.x + b * r.xx - r.xy])
        return float(a * a / 2 + a * b * r.x + b * b * r.xx / 2 - a * r.y - b * r.xy), grad

    w, _ = search.lbfgs(loss, np.zeros(2), 500, tolerance=1e-10)
    return spark.createDataFrame([(round(float(w[0]), 3), round(float(w[1]), 4))], "bias double, slope double")


@query("SELECT round(avg(l_quantity) / 10, 3) AS x0, round(avg(l_tax) * 10, 3) AS x1, round(avg(l_discount) * 10, 3) AS x2 FROM lineitem")
def o09_cma_es(spark, sf_dir):
    """Covariance adaptation finds the point nearest to the items: their means."""
    r = table(spark, sf_dir, "lineitem").agg((F.avg("l_quantity") / 10).alias("a"), (F.avg("l_tax") * 10).alias("b"), (F.avg("l_discount") * 10).alias("c")).first()
    target = np.array([r.a, r.b, r.c])
    x, _ = search.cma_es(lambda w: float(((w - target) ** 2).sum()), [1.0, 1.0, 1.0], 0.5, 400)
    return spark.createDataFrame([tuple(round(float(v), 3) for v in x)], "x0 double, x1 double, x2 double")


def _two_bowls(w):
    return np.array([w[0] ** 2 + w[1] ** 2, (w[0] - 1) ** 2 + w[1] ** 2])


def _front_facts(spark, solver: Callable[[], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Of a front of the distances to two points: its ends, and the least of f1 + f2, which is between them."""
    _, f = solver()
    root = np.sqrt(f)
    return spark.createDataFrame([(round(float(root[:, 0].min()), 1), round(float(root[:, 1].min()), 1), round(float((root.sum(axis=1)).min()), 1), round(float(np.median(root.sum(axis=1))), 1))], "end0 double, end1 double, least double, median double")


_FACTS = "SELECT 0.0::DOUBLE AS end0, 0.0::DOUBLE AS end1, 1.0::DOUBLE AS least, 1.0::DOUBLE AS median"  # the true front is the line between the two points


@query(_FACTS)
def o09_sorted_fronts(spark, sf_dir):
    return _front_facts(spark, lambda: search.nsga2(_two_bowls, [-2, -2], [2, 2], 40, 60))


@query(_FACTS)
def o10_particle_swarm(spark, sf_dir):
    return _front_facts(spark, lambda: search.smpso(_two_bowls, [-2, -2], [2, 2], 40, 60))


@query(_FACTS)
def o10_turbulent_swarm(spark, sf_dir):
    return _front_facts(spark, lambda: search.omopso(_two_bowls, [-2, -2], [2, 2], 40, 80))


@query(_FACTS)
def o10_scatter_search(spark, sf_dir):
    return _front_facts(spark, lambda: search.abyss(_two_bowls, [-2, -2], [2, 2], 20, 20))


@query(_FACTS)
def o10_annealed_archive(spark, sf_dir):
    return _front_facts(spark, lambda: search.amosa(_two_bowls, [-2, -2], [2, 2], 40))


@query("SELECT vec_id, " + ", ".join(f"round(CAST(embedding[{i}] AS DOUBLE), 5) AS x{i}" for i in range(1, 65)) + " FROM embeddings")
def o13_encoder(spark, sf_dir):
    """All 64 components as columns."""
    x = search.vector_to_columns(table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e")), "e", 64)
    return _six(x, 5)


_D, _K = 1 + 1e-4, float(np.exp(-8))


@query(f"""WITH x AS (SELECT p_partkey, p_size / 25 AS x FROM part), k AS (SELECT *, exp(-x * x / 0.5e0) AS a, exp(-(x - 2) * (x - 2) / 0.5e0) AS b FROM x)
SELECT p_partkey, round(2 + (a * {q.number(-(_D + _K) / (_D * _D - _K * _K))} + b * {q.number((_D + _K) / (_D * _D - _K * _K))}), 6) AS mean, round(greatest(1 - (a * a * {q.number(_D)} - 2 * a * b * {q.number(_K)} + b * b * {q.number(_D)}) / {q.number(_D * _D - _K * _K)}, 0), 6) AS variance FROM k""")
def e13_gaussian_process(spark, sf_dir):
    """A process fitted to two points, whose kernel SQL inverts by hand: mean and variance at each part's size."""
    model = search.GaussianProcess(0.01).fit(np.array([[0.0], [2.0]]), np.array([1.0, 3.0]))
    rows = table(spark, sf_dir, "part").select("p_partkey", (c("p_size") / 25).alias("x0"))
    return model.columns(rows, ["x0"]).select("p_partkey", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


_GAME = "(SELECT i % 200 AS k, CAST(i // 200 AS INTEGER) AS step, CAST((i * 37) % 11 AS DOUBLE) AS s, CAST((i * 7) % 2 AS DOUBLE) AS a FROM range(600) t(i))"


@query(f"SELECT k, step, round(CASE WHEN (s > 5) = (a > 0.5) THEN 1.0 ELSE 0.0 END + (2 - step), 6) AS value FROM {_GAME}")
def g06_fitted_q(spark, sf_dir):
    """The value of each action taken in a game whose next best action always pays 1."""
    x = frame.interval(spark, 0, 600).select((c("row_id") % 200).alias("k"), F.floor(c("row_id") / 200).cast("int").alias("step"), ((c("row_id") * 37) % 11).cast("double").alias("s"), ((c("row_id") * 7) % 2).cast("double").alias("a"))
    x = x.withColumn("reward", F.when((c("s") > 5) == (c("a") > 0.5), 1.0).otherwise(0.0))
    models = search.fitted_q(x, ["s"], "a", "reward", "step", "k", 2, max_depth=4)
    value = F.when(c("step") == 0, models[0].column()).when(c("step") == 1, models[1].column()).otherwise(models[2].column())
    return x.select("k", "step", F.round(value, 6).alias("value"))


# programs


def _programs() -> list[tuple[str, expr.Expr]]:
    rng, names, functions = random.Random(1), ["x", "y"], ["+", "-", "*", "sin", "cos"]
    out = [("full", programs.full(names, functions, 4, rng)), ("grown", programs.grown(names, functions, 5, rng)), *(("ramped", programs.ramped(names, functions, 2, 5, rng)) for _ in range(4))]
    for _, e in list(out):
        out += [("shrink", programs.shrink(e, rng)), ("swap", programs.swap(e, names, functions, rng)), ("insert", programs.insert(e, names, functions, rng)), ("koza", programs.koza(e, names, functions, rng)), *(("crossover", x) for x in programs.crossover(e, out[0][1], rng))]
    return out


_PROGRAMS = _programs()


@query("WITH r AS (SELECT i AS row_id, i / 10 AS x, CAST(i % 7 AS DOUBLE) AS y FROM range(50) t(i)) " + " UNION ALL ".join(f"SELECT {i} AS program, '{kind}' AS kind, row_id, round({e}, 5) AS value FROM r" for i, (kind, e) in enumerate(_PROGRAMS)))
def g01_random_programs(spark, sf_dir):
    """Sampled and varied programs, through both linear forms and as columns, against their text run by SQL."""
    rows = frame.interval(spark, 0, 50).select("row_id", (c("row_id") / 10).alias("x"), (c("row_id") % 7).cast("double").alias("y"))
    through = [(kind, programs.from_prefix(programs.to_prefix(programs.from_postfix(programs.to_postfix(e))))) for kind, e in _PROGRAMS]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("program"), F.lit(kind).alias("kind"), e.column().cast("double").alias("value")) for i, (kind, e) in enumerate(through))))
    return rows.select("row_id", each.alias("e")).select("e.program", "e.kind", "row_id", F.round("e.value", 5).alias("value"))


# bandits

_KL = "(SELECT event_type AS arm, count(*)::DOUBLE AS n, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS p, (SELECT count(*) FROM events)::DOUBLE AS t FROM events GROUP BY 1)"


@query(f"""WITH RECURSIVE a AS (SELECT arm, n, least(greatest(p, 1e-9), 1 - 1e-9) AS p, ln(t) / n AS bound FROM {_KL}), b AS (SELECT arm, p, bound, p AS lo, 1 - 1e-12 AS hi, 0 AS k FROM a UNION ALL
SELECT arm, p, bound, CASE WHEN p * ln(p / q) + (1 - p) * ln((1 - p) / (1 - q)) <= bound THEN q ELSE lo END, CASE WHEN p * ln(p / q) + (1 - p) * ln((1 - p) / (1 - q)) <= bound THEN hi ELSE q END, k + 1 FROM (SELECT *, (lo + hi) / 2 AS q FROM b WHERE k < 24))
SELECT arm, round((lo + hi) / 2, 5) AS index FROM b WHERE k = 24""")
def b05_kl_ucb(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(c("event_type").alias("arm"), (c("value") > 50).cast("double").alias("r"))
    return bandit.with_total(bandit.arms(e, "arm", "r")).select("arm", F.round(bandit.kl_ucb(), 5).alias("index"))


# sparse rows and traces


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS index, round(CAST(embedding[i] AS DOUBLE), 5) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE embedding[i] > 0")
def k02_sparse_rows(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.when(v > 0, v.cast("double"))).alias("v"))
    return files.sparse_rows(x, "vec_id", "v").select("vec_id", "index", F.round("value", 5).alias("value"))


_EVENTS = ("click", "error", "purchase", "signup", "view")


@query("SELECT user_id, " + ", ".join(f"max(CASE WHEN event_type = '{t}' THEN value END) AS {t}" for t in _EVENTS) + " FROM events GROUP BY 1")
def k03_trace_pivot(spark, sf_dir):
    """A column for each type of event."""
    return files.trace_table(table(spark, sf_dir, "events"), "user_id", "event_type", "value", list(_EVENTS))


# sources


def _path(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT CASE WHEN l_discount > 0 THEN l_discount ELSE 0 END AS discount, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity ELSE 0 END AS quantity, l_orderkey AS k, CASE WHEN l_returnflag = 'R' THEN 'R' ELSE '0' END AS flag FROM lineitem")
def s04_sparse_arff(spark, sf_dir):
    """Items written as sparse rows of ARFF and read again: what a row leaves out is 0."""
    x = table(spark, sf_dir, "lineitem")
    cell = lambda i, v: F.concat(F.lit(f"{i} "), v.cast("string"))
    cells = F.concat_ws(", ", F.when(c("l_discount") > 0, cell(0, c("l_discount"))), F.when(c("l_linenumber") % 3 != 0, cell(1, c("l_quantity"))), cell(2, c("l_orderkey")), F.when(c("l_returnflag") == "R", cell(3, c("l_returnflag"))))
    path = _path(spark, "sparse") + ".arff"
    x.select(F.concat(F.lit("{"), cells, F.lit("}")).alias("value")).write.text(path)
    head = "@relation items\n@attribute discount real\n@attribute quantity real\n@attribute k integer\n@attribute flag {0, R, A, N}\n@data"
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("append").text(path)
    return files.read_arff(spark, path).select("discount", "quantity", "k", "flag")


def _nations_text(spark, sf_dir) -> str:
    """The nations' names by key, one line each: a fixed table, one file."""
    path = _path(spark, "nations") + ".txt"
    table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select("n_name").write.text(path)
    return path


@query("SELECT CAST(n_nationkey AS INTEGER) AS at, n_name AS line FROM nation UNION ALL SELECT CAST(count(*) AS INTEGER), '' FROM nation")
def s06_text_lines(spark, sf_dir):
    """The numbered lines that readers of text formats start from."""
    return files.numbered_lines(spark, _nations_text(spark, sf_dir))


@query("SELECT string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS value FROM nation")
def s07_raw_text(spark, sf_dir):
    return files.read(spark, _nations_text(spark, sf_dir))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s08_xml(spark, sf_dir):
    """Nations saved as XML and read again."""
    path = _path(spark, "nations") + ".xml"
    files.write(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return files.read(spark, path, "row").select(c("n_nationkey").cast("int").alias("n_nationkey"), "n_name", c("n_regionkey").cast("int").alias("n_regionkey"))


@query("SELECT CAST(e AS BIGINT) AS evaluations, CASE e WHEN 400 THEN 'first' ELSE 'later' END AS kind, (SELECT round(min(x0 * x0), 9) FROM (SELECT " + q.uniform(0, "i", low=-1, high=1) + " AS x0 FROM range(400) t(i))) AS first FROM (VALUES (400), (800)) v(e)")
def s09_saved_trace(spark, sf_dir):
    """The curve of a search's callback, saved with its types as JSON and read again."""
    p, said = search.Problem([-1.0], [1.0], lambda x: x[0] * x[0]), search.Callbacks(every=400)
    for i in range(2):
        search.random_search(spark, p, 400, i, said)
    path = _path(spark, "trace")
    first = said.curve[0][1]
    files.save_trace(spark.createDataFrame([(n, "first" if i == 0 else "later", round(first, 9)) for i, (n, _) in enumerate(said.curve)], "evaluations long, kind string, first double"), path)
    return files.load_trace(spark, path)


@query("SELECT 'r=' || n_regionkey AS folder, count(*) AS files, true AS full FROM (SELECT DISTINCT n_regionkey FROM nation) GROUP BY 1")
def s10_directory_listing(spark, sf_dir):
    """The files below a folder that has one for each region."""
    path = _path(spark, "listing")
    table(spark, sf_dir, "nation").select("n_name", c("n_regionkey").alias("r")).repartition(1).write.partitionBy("r").json(path)
    found = files.list_files(spark, path, "*.json").select(F.regexp_extract("path", r"/(r=\d+)/[^/]*$", 1).alias("folder"), "length")
    return found.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.min(c("length") > 0).alias("full"))


@query("SELECT CAST(n_regionkey AS DOUBLE) AS label, CAST(n_nationkey AS DOUBLE) AS f2, n_name FROM nation")
def s11_reader_by_extension(spark, sf_dir):
    """The readers that the extensions .libsvm, .json and .parquet choose."""
    n, path = table(spark, sf_dir, "nation"), _path(spark, "choice")
    n.select(F.concat_ws(" ", c("n_regionkey").cast("string"), F.concat(F.lit("2:"), c("n_nationkey").cast("string")))).write.text(path + ".libsvm")
    files.write(n.select(c("n_nationkey").cast("double").alias("f2"), "n_name"), path + ".json")
    return files.read(spark, path + ".libsvm").select("label", c("features")[2].alias("f2")).join(files.read(spark, path + ".json"), "f2").select("label", "f2", "n_name")


@query(r"SELECT doc_id, NOT regexp_matches(substr(text, 1, 256), '[\x00-\x08\x0B\x0C\x0E-\x1F]') AS text FROM documents")
def s12_text_sniff(spark, sf_dir):
    """Whether documents look like text; the sniff looks at 256 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", files.text_like(c("text")).alias("text"))


@query("SELECT n_regionkey::BIGINT AS node, count(*)::DOUBLE AS nations, max(n_nationkey)::DOUBLE AS last FROM nation GROUP BY 1")
def k04_autosaved_trace(spark, sf_dir):
    """Results of a run over the regions, written every three, as a table of nodes."""
    trace = files.TraceAutosave(spark, _path(spark, "autosave"), 3)
    for r in table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.max("n_nationkey").alias("last")).orderBy("n_regionkey").collect():  # 5 rows
        trace.push("nations", r.n, r.n_regionkey)
        trace.push("last", r["last"], r.n_regionkey)
    return trace.table()


@query("SELECT 'regions' || chr(10) || string_agg('  ' || r_name || ' = ' || r_regionkey, chr(10) ORDER BY r_regionkey) || chr(10) || '  ' || count(*) || '/5 regions' || chr(10) || '=> done' || chr(10) AS said FROM region")
def k05_console(spark, sf_dir):
    out = io.StringIO()
    console = files.Console(out)
    console.enter("regions")
    rows = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()  # 5 rows
    for r in rows:
        console.result(r.r_name, r.r_regionkey)
    console.progress(len(rows), 5, "regions")
    console.leave("done")
    return spark.createDataFrame([(out.getvalue(),)], "said string")


# fronts of three objectives

_THREE = [("s_acctbal", 1), ("s_nationkey", 1), ("m", 1)]
_FRONT3 = "(SELECT DISTINCT (x + 1000) AS x, (y + 1) AS y, (z + 1) AS z FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.x >= a.x AND b.y >= a.y AND b.z >= a.z AND (b.x > a.x OR b.y > a.y OR b.z > a.z)))"
_SUPPLIERS = "p AS (SELECT s_acctbal AS x, s_nationkey AS y, s_suppkey % 17 AS z FROM supplier)"


def _three(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_acctbal", "s_nationkey", (c("s_suppkey") % 17).alias("m"))


@query(f"""WITH {_SUPPLIERS}, f AS MATERIALIZED (SELECT * FROM {_FRONT3} WHERE x > 0 AND y > 0 AND z > 0), xs AS (SELECT x, x - coalesce(lag(x) OVER (ORDER BY x), 0) AS w FROM (SELECT DISTINCT x FROM f)), ys AS (SELECT y, y - coalesce(lag(y) OVER (ORDER BY y), 0) AS w FROM (SELECT DISTINCT y FROM f)),
zs AS (SELECT z, z - coalesce(lag(z) OVER (ORDER BY z), 0) AS w FROM (SELECT DISTINCT z FROM f)) SELECT round(coalesce(sum(xs.w * ys.w * zs.w), 0), 2) AS hypervolume FROM xs, ys, zs WHERE EXISTS (SELECT 1 FROM f WHERE f.x >= xs.x AND f.y >= ys.y AND f.z >= zs.z)""")
def p06_hypervolume_3d(spark, sf_dir):
    return pareto.hypervolume(_three(spark, sf_dir), _THREE, (-1000.0, -1.0, -1.0)).select(F.round("hypervolume", 2).alias("hypervolume"))


@query(f"""WITH {_SUPPLIERS}, f AS MATERIALIZED (SELECT *, row_number() OVER () AS i FROM {_FRONT3}), d AS (SELECT a.i, min(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2))) AS d FROM f a JOIN f b ON a.i <> b.i GROUP BY a.i)
SELECT round(coalesce(sum(abs(d - (SELECT avg(d) FROM d))) / nullif(sum(d), 0), 0), 6) AS spread FROM d""")
def p05_spread_3d(spark, sf_dir):
    return pareto.spread(pareto.front(_three(spark, sf_dir), _THREE), _THREE).select(F.round("spread", 6).alias("spread"))


# stream learners; plain versions are in the tests


@query()
def i15_total_mauve_tree(spark, sf_dir):
    """Learning curves of a tree split by the residuals about least squares on all inputs."""
    return learning._curve(spark, sf_dir, lambda: learners.HoeffdingTree(2, learners.TotalMauve(), chunk=500))
