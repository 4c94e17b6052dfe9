"""Table operators, splits, trees, Pareto sets, bandits and expressions against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import metrics, stats
from larkspur.operators import bandit, frame, pareto, sampling, search, split, trees
from larkspur.plans import expr, programs


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(i, rng.choice([None, *range(12)]), rng.random(), rng.choice("ABC")) for i in range(300)]
    df = spark.createDataFrame(data, "row_id long, k int, y double, c string").cache()
    return data, df


def test_row_ids_follow_an_order(spark):
    df = spark.createDataFrame([(i * 7 % 1000, "x") for i in range(1000)], "k long, v string").repartition(7)
    got = frame.with_row_id(df, "k").collect()
    assert sorted((r.row_id, r.k) for r in got) == [(i, i) for i in range(1000)]


def test_inverted_order_flag(rows):
    data, df = rows
    down = [r.row_id for r in frame.sort(df, "k", True).collect()]
    assert down == [r[0] for r in sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    up = [r.row_id for r in frame.sort(df, "k", False).collect()]
    assert up == [r[0] for r in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))]


def test_slices_and_splits_keep_all_rows(rows):
    data, df = rows
    assert frame.between(df, 10, 20).count() == 10 and frame.outside(df, 10, 20).count() == 290
    s = frame.train_test(df, 0.3, 300, 1)
    assert s.where("test").count() == 90
    assert frame.every_fold(df, 5).where("test").count() == 300
    assert frame.bootstrap(df, 300, 2).agg(F.sum("multiplicity")).first()[0] == 300
    assert [r.row_id for r in frame.subset(df, 20, 3).collect()] == sorted(r.row_id for r in frame.subset(df, 20, 3).collect())


def test_resize_pads_with_nulls(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "row_id long, v string")
    assert [(r.row_id, r.v) for r in frame.resize(df, 4, 2).orderBy("row_id").collect()] == [(0, "a"), (1, "b"), (2, None), (3, None)]
    assert frame.resize(df, 1, 2).count() == 1


def test_best_threshold_is_brute_force(rows):
    data, df = rows
    got = split.best_threshold(df, "k", split.VarianceReduction(("y",))).first()

    def score(t):
        groups = {}
        for _, k, y, _ in data:
            groups.setdefault(None if k is None else k >= t, []).append(y)
        ys = [y for _, _, y, _ in data]
        return (np.var(ys) - sum(len(g) * np.var(g) for g in groups.values()) / len(ys)) / np.var(ys)

    options = [(score(t), t) for t in np.arange(0.5, 11)]
    best = max(s for s, _ in options)
    assert got.score == pytest.approx(best) and got.threshold in [t for s, t in options if s > best - 1e-9]


def test_information_gain_of_a_perfect_split(spark):
    df = spark.createDataFrame([(float(i), "a" if i < 5 else "b") for i in range(10)], "x double, c string")
    got = split.best_threshold(df, "x", split.InformationGain("c", ("a", "b"))).first()
    assert got.threshold == 4.5 and got.score == pytest.approx(1.0)


def test_threshold_of_a_constant_column(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "x double, y double")
    assert split.best_threshold(df, "x", split.VarianceReduction(("y",))).count() == 0


def test_tree_learns_a_step_and_bounds_its_depth(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), 5.0 if i >= 40 else 1.0) for i in range(100)], "a double, b double, y double")
    g = trees.grow(df, ["a", "b"], split.VarianceReduction(("y",)), max_depth=3)[0]
    assert df.select(F.max(F.abs(g.tree.column() - F.col("y")))).first()[0] == 0.0
    assert g.tests() == 1 and g.importance() == {"a": pytest.approx(1.0)}


def test_tree_of_constant_target_is_a_leaf(spark):
    df = spark.createDataFrame([(float(i), 2.0) for i in range(10)], "a double, y double")
    assert trees.grow(df, ["a"], split.VarianceReduction(("y",)))[0].tests() == 0


def test_fronts_against_plain_dominance(spark):
    rng = random.Random(1)
    pts = [(i, rng.randint(0, 20), rng.randint(0, 20), rng.randint(0, 5)) for i in range(150)]
    df = spark.createDataFrame(pts, "k int, a int, b int, c int")

    def front(dims):
        return {p[0] for p in pts if not any(all(q[d] >= p[d] for d in dims) and any(q[d] > p[d] for d in dims) for q in pts)}

    assert {r.k for r in pareto.front(df, [("a", 1), ("b", 1)]).collect()} == front([1, 2])
    assert {r.k for r in pareto.front(df, [("a", 1), ("b", 1), ("c", 1)]).collect()} == front([1, 2, 3])
    ranked = pareto.ranks(df, [("a", 1), ("b", 1)]).collect()
    assert len(ranked) == 150 and {r.k for r in ranked if r["rank"] == 0} == front([1, 2])


@pytest.mark.parametrize("dims", [2, 3])
def test_ranks_are_those_of_chains(spark, dims, monkeypatch):
    monkeypatch.setattr(pareto, "RANGE_POINTS", 40)
    rng = random.Random(9)
    pts = [(i, rng.randint(0, 12), rng.choice([0.5, 1.0, 2.0, 7.0]), rng.randint(0, 3)) for i in range(150)] + [(900, None, 1.0, 1), (901, 1, float("nan"), 1)]
    objectives = [("a", 1), ("b", -1), ("c", 1)][:dims]
    value = {p[0]: [s * x for x, (_, s) in zip(p[1:], objectives)] for p in pts[:150]}
    beats = {k: [j for j, w in value.items() if w != v and all(x >= y for x, y in zip(w, v))] for k, v in value.items()}
    want = {}
    for k in sorted(value, key=lambda k: len(beats[k])):  # who beats k is beaten by fewer
        want[k] = 1 + max((want[j] for j in beats[k]), default=-1)
    got = {r.k: r["rank"] for r in pareto.ranks(spark.createDataFrame(pts, "k int, a int, b double, c int"), objectives).collect()}
    assert got == {**want, 900: None, 901: None}


def test_ranks_of_a_long_chain(spark):
    chain = spark.range(2500).select("id", (F.col("id") * 2).alias("y"))
    assert {r.id: r["rank"] for r in pareto.ranks(chain, [("id", 1), ("y", 1)]).collect()} == {i: 2499 - i for i in range(2500)}


def test_hypervolume_of_two_boxes(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 1.0), (0.5, 0.5)], "a double, b double")
    assert pareto.hypervolume(df, [("a", 1), ("b", 1)], (0.0, 0.0)).first()[0] == pytest.approx(4.0)


def test_archive_keeps_ends(spark):
    df = spark.createDataFrame([(float(i), float(10 - i)) for i in range(11)], "a double, b double")
    kept = sorted(r.a for r in pareto.archive(df, [("a", 1), ("b", 1)], 4).collect())
    assert len(kept) == 4 and kept[0] == 0.0 and kept[-1] == 10.0


def test_bandit_prefers_the_unplayed(spark):
    df = spark.createDataFrame([("a", 5, 0.9, 0.1, 8.0), ("b", 3, 0.2, 0.1, 8.0), ("c", 0, None, 0.0, 8.0)], "arm string, n long, mean double, variance double, t double")
    assert bandit.choose(df, bandit.ucb1(), "arm").first().arm == "c"
    assert bandit.choose(df.where("n > 0"), bandit.greedy(), "arm").first().arm == "a"
    assert bandit.BitKey().push(5, 3).push(1, 2).bytes() == bytes([0b01101])


def test_kl_ucb_is_above_the_mean(spark):
    df = spark.createDataFrame([("a", 50, 0.4, 100.0)], "arm string, n long, mean double, t double")
    q = df.select(bandit.kl_ucb().alias("q")).first().q
    kl = 0.4 * np.log(0.4 / q) + 0.6 * np.log(0.6 / (1 - q))
    assert q > 0.4 and kl == pytest.approx(np.log(100) / 50, rel=1e-3)


def test_confusion_edges(spark):
    df = spark.createDataFrame([(None, True), (True, None)], "p boolean, c boolean")
    z = stats.confusion(F.col("p"), F.col("c"))
    r = df.agg(stats.f1(z).alias("f1"), stats.accuracy(z).alias("a"), stats.matthews(z).alias("m")).first()
    assert (r.f1, r.a, r.m) == (1.0, 0.0, 0.0)


def test_two_nulls_agree(spark):
    df = spark.createDataFrame([(None, None), (True, None), (True, True)], "t boolean, p boolean")
    assert df.agg(metrics.binary_accuracy(F.col("t"), F.col("p"))).first()[0] == pytest.approx(2 / 3)


def test_least_squares_merge_and_subtract(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7), 2.0 + 3 * i - (i * i % 7)) for i in range(30)], "a double, b double, y double")
    whole = stats.least_squares(df, ["a", "b"], "y")
    first, rest = stats.least_squares(df.where("a < 10"), ["a", "b"], "y"), stats.least_squares(df.where("a >= 10"), ["a", "b"], "y")
    assert np.allclose(whole.weights(), [2, 3, -1]) and np.allclose((first + rest).weights(), whole.weights())
    assert np.allclose((whole - first).weights(), rest.weights()) and whole.residual_sd() == pytest.approx(0, abs=1e-4)


def test_expressions(spark):
    x, y = expr.Variable("x"), expr.Variable("y")
    e = expr.Apply("+", (expr.Apply("*", (x, y)), x))
    assert (e.size(), e.depth(), str(e)) == (5, 3, "((x * y) + x)")
    assert str(e.substitute(1, y)) == "(y + x)" and e.depth_of(2) == 2
    assert programs.from_postfix(programs.to_postfix(e)) == e and programs.from_prefix(programs.to_prefix(e)) == e
    df = spark.createDataFrame([(2.0, 3.0)], "x double, y double")
    assert df.select(e.column()).first()[0] == 8.0
    with pytest.raises(TypeError):
        expr.Apply("+", (x,))


def test_program_variation_stays_within_bounds():
    rng = random.Random(3)
    names, functions = ["x", "y"], ["+", "-", "*", "sin", "min"]
    e = programs.full(names, functions, 4, rng)
    assert e.depth() == 4
    for _ in range(50):
        for new in (programs.shrink(e, rng), programs.swap(e, names, functions, rng), programs.insert(e, names, functions, rng), programs.koza(e, names, functions, rng), *programs.crossover(e, e, rng)):
            assert new.depth() <= programs.MAX_DEPTH


def test_gradient_of_the_policy_and_lbfgs():
    rng = np.random.default_rng(0)
    steps = [(rng.normal(size=(4, 3)), int(rng.integers(4))) for _ in range(20)]
    policy = sampling.LogLinear(3, regulariser=0.1)

    def loss(w):
        policy.weights = w
        v, g = policy.log_likelihood(steps)
        return -v, -g

    assert search.gradient_error(loss, rng.normal(size=3)) < 1e-4
    w, _ = search.lbfgs(loss, np.zeros(3))
    assert np.abs(loss(w)[1]).max() < 1e-4


def test_nested_rollouts_find_the_longest_sum():
    actions = lambda s: [0, 1, 2] if len(s) < 5 else []
    value, path = search.nested_rollout((), actions, lambda s, a: (*s, a), sum, 2, 15, seed=1)
    assert value >= 9 and sum(path) == value
    assert search.look_ahead((), actions, lambda s, a: (*s, a), sum)[0] == 10


def test_gaussian_cdf(spark):
    got = spark.range(1).select(*(sampling.gaussian_cdf(F.lit(z)).alias(n) for n, z in (("a", 0.0), ("b", 1.96), ("c", -1.0)))).first()
    assert got.a == pytest.approx(0.5, abs=1e-6) and got.b == pytest.approx(0.9750021, abs=1e-6) and got.c == pytest.approx(0.1586553, abs=1e-6)
