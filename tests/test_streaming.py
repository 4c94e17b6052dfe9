"""Incremental learners: a stream gives what a replay of its rows gives."""

import re

import numpy as np
import pyarrow as pa
import pytest

from larkspur.streaming import learners


def data(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-4, 4, (n, 2))
    return x, np.sqrt((x**2).sum(axis=1))


def rrse(learner, n=3000):
    x, y = data(n)
    for a, b in zip(x, y):
        learner.push(a, b)
    tx, ty = data(400, 9)
    e = np.array([learner.predict(a) for a in tx]) - ty
    return float(np.sqrt((e**2).sum() / ((ty - ty.mean()) ** 2).sum()))


def test_model_trees_beat_one_line():
    line = rrse(learners.OnlineLeastSquares(2))
    for quality in (learners.StandardDeviationReduction(), learners.ExtendedMauve(), learners.Mauve()):
        tree = learners.HoeffdingTree(2, quality)
        assert rrse(tree) < 0.6 * line and tree.leaves() > 2
    assert rrse(learners.HoeffdingTree(2, learners.Never())) == pytest.approx(line)


def test_least_squares_and_perceptron_fit_a_plane():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = 1 + x @ [2.0, -1.0, 0.5]
    ols, per, simple = learners.OnlineLeastSquares(3), learners.Perceptron(3), learners.SimpleRegressions(3)
    for a, b in zip(x, y):
        ols.push(a, b)
        per.push(a, b)
        simple.push(a, b)
    assert np.allclose(ols.weights, [1, 2, -1, 0.5])
    assert abs(per.predict(np.ones(3)) - 2.5) < 0.5
    assert np.allclose(simple.weights, [1, 2, -1, 0.5], atol=0.15)


def test_extra_trees_remember():
    x, y = data(300)
    t = learners.Ensemble([learners.ExtraTree(2, 2, s) for s in range(5)])
    for a, b in zip(x, y):
        t.push(a, b)
    assert np.mean([(t.predict(a) - b) ** 2 for a, b in zip(x, y)]) < 0.05


def test_expression_of_a_tree_predicts_as_it_does(spark):
    tree = learners.HoeffdingTree(2)
    rrse(tree)
    x, _ = data(50, 3)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    got = [r.m for r in df.select(tree.expression(["a", "b"]).column()["mean"].alias("m")).collect()]
    assert np.allclose(got, [tree.predict(r) for r in x])


def test_stream_equals_replay(spark, tmp_path):
    x, y = data(400)
    rows = [(i % 2, i, float(a[0]), float(a[1]), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    schema = "k int, seq long, a double, b double, y double"
    df = spark.createDataFrame(rows, schema)
    make = lambda: learners.OnlineLeastSquares(2)
    batch = {(r.k, r.rows): r.rmse for r in learners.replay(df, make, ["a", "b"], "y", "seq", "k", 50).collect()}
    for part in range(2):
        df.where(f"seq >= {part * 200} and seq < {part * 200 + 200}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = learners.stream(source, make, ["a", "b"], "y", "seq", "k", 50).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.k, r.rows): r.rmse for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got.keys() == batch.keys() and all(abs(got[k] - batch[k]) < 1e-9 for k in got)


def test_bound():
    assert learners.hoeffding_bound(0, 0.1) == 1.0 and learners.hoeffding_bound(200, 0.01) == pytest.approx(0.1073, abs=1e-3)


def by_rows(learner, x, y):
    out = []
    for a, b in zip(x, y):
        out.append(learner.predict(a))
        learner.push(a, float(b))
    return np.array(out)


def grid(n, seed=4):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n), rng.integers(0, 4, n)]).astype(float)
    return x, np.where(x[:, 0] > 4, 2 * x[:, 1], 5 - x[:, 1]) + rng.normal(0, 0.1, n)


def test_extra_trees_keep_equal_rows_as_one_and_learn_blocks_as_rows():
    for x, y in (grid(4000), data(500)):
        one, blocks = (learners.Ensemble([learners.ExtraTree(2, 5, s) for s in range(3)]) for _ in range(2))
        want = by_rows(one, x, y)
        got = np.concatenate([blocks.learn(x[i : i + 700], y[i : i + 700]) for i in range(0, len(y), 700)])
        assert np.allclose(got, want, rtol=0, atol=1e-9)
    tree, (x, y) = learners.ExtraTree(2, 5, 1), grid(4000)
    tree.learn(x, y)
    held = lambda n: held(n.left) + held(n.right) if hasattr(n, "left") else len(n.cells)
    assert held(tree.root) == len(np.unique(x, axis=0)) == 36


def test_a_replay_takes_ties_in_one_order_and_keys_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(learners, "BLOCK_ROWS", 64)
    x, y = grid(900)
    rows = [(None if i % 3 == 2 else i % 3, i // 6, float(a[0]), float(a[1]), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k int, seq long, a double, b double, y double")
    make = lambda: learners.ExtraTree(2, 3, 1)
    runs = [{(r.k, r.rows): r.rmse for r in learners.replay(d.repartition(n), make, ["a", "b"], "y", "seq", "k", 70).collect()} for d, n in ((df, 1), (df.orderBy("y"), 5))]
    assert runs[0] == runs[1] and len(runs[0]) == 12
    for k in (0, 1, None):
        mine = sorted(r[1:] for r in rows if r[0] == k)
        e = (by_rows(make(), np.array([r[1:3] for r in mine]), [r[3] for r in mine]) - [r[3] for r in mine]) ** 2
        assert [runs[0][k, n] for n in (70, 140, 210, 280)] == pytest.approx([e[n - 70 : n].mean() ** 0.5 for n in (70, 140, 210, 280)])


@pytest.mark.parametrize("quality", [learners.StandardDeviationReduction(), learners.Mauve(), learners.ExtendedMauve(), learners.TotalMauve(), learners.QuandtAndrews()])
def test_hoeffding_trees_keep_equal_rows_as_one_and_learn_blocks_as_rows(quality):
    for x, y in (grid(3000), data(700)):
        for model in (learners.OnlineLeastSquares, learners.Perceptron):
            one, blocks = (learners.HoeffdingTree(2, quality, model) for _ in range(2))
            want = by_rows(one, x, y)
            got = np.concatenate([blocks.learn(x[i : i + 450], y[i : i + 450]) for i in range(0, len(y), 450)])
            assert np.allclose(got, want, rtol=0, atol=1e-6) and blocks.leaves() == one.leaves()
    tree, (x, y) = learners.HoeffdingTree(2, learners.Never()), grid(4000)
    tree.learn(x, y)
    at, sums, n, squares = tree.root.rows.sums()
    assert len(at) == 36 and n.sum() == len(tree.root.rows) == 4000 and sums.sum() == pytest.approx(y.sum()) and squares.sum() == pytest.approx((y**2).sum())
    for j in range(2):  # counted rows are worth what they are worth one by one
        order, few = np.argsort(x[:, j], kind="stable"), np.argsort(at[:, j], kind="stable")
        ends = np.append(np.diff(at[few, j]) > 0, False)
        got = quality.qualities(at[few], sums[few], j, n[few], squares[few])[ends]
        want = quality.qualities(x[order], y[order], j)[np.append(np.diff(x[order, j]) > 0, False)]
        assert np.allclose(got, want, atol=1e-8) if not isinstance(quality, learners.QuandtAndrews) else np.allclose(got, want, rtol=1e-6)


def test_least_squares_learn_blocks_as_rows():
    x, y = data(1500)
    x[:30, 1] = 3.0  # no single best fit before the 31st row
    one, blocks = learners.OnlineLeastSquares(2), learners.OnlineLeastSquares(2)
    want = by_rows(one, x, y)
    assert np.allclose(np.concatenate([blocks.learn(x[:700], y[:700]), blocks.learn(x[700:], y[700:])]), want, atol=1e-8) and np.allclose(blocks.weights, one.weights)


def test_perceptrons_learn_blocks_as_rows():
    x, y = grid(900)
    x[:, 1] = np.where(np.arange(900) < 40, 2.0, x[:, 1])
    one, blocks = learners.Perceptron(2, seed=5), learners.Perceptron(2, seed=5)
    want = by_rows(one, x, y)
    assert np.allclose(np.concatenate([blocks.learn(x[:7], y[:7]), blocks.learn(x[7:500], y[7:500]), blocks.learn(x[500:], y[500:])]), want, rtol=0, atol=1e-9)
    assert np.allclose(blocks.w, one.w) and np.allclose(blocks.predict(x[0]), one.predict(x[0]))


def test_a_replayed_mauve_tree_holds_cells_and_not_rows(spark, tmp_path):
    x, y = grid(6000)
    df = spark.createDataFrame([(1, i, float(a[0]), float(a[1]), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k int, seq long, a double, b double, y double")
    held = str(tmp_path / "held")

    class Weighed(learners.HoeffdingTree):
        def learn(self, x, y):
            out = super().learn(x, y)
            cells = lambda n: cells(n.left) + cells(n.right) if hasattr(n, "left") else len(n.rows.sums()[0])
            with open(held, "a") as f:
                f.write(f"{cells(self.root)} {self.leaves()}\n")
            return out

    make = lambda: Weighed(2, learners.ExtendedMauve(), learners.Perceptron)
    got = {r.rows: r.rmse for r in learners.replay(df, make, ["a", "b"], "y", "seq", "k", 1000).collect()}
    e = (by_rows(learners.HoeffdingTree(2, learners.ExtendedMauve(), learners.Perceptron), x, y) - y) ** 2
    assert got == pytest.approx({n: e[n - 1000 : n].mean() ** 0.5 for n in range(1000, 6001, 1000)})
    cells, leaves = map(int, open(held).read().split()[-2:])
    assert cells == 36 and leaves > 1  # however many rows there are


def test_a_replay_sorts_rows_in_ranges_and_blocks_where_keys_are_learned(spark, monkeypatch):
    monkeypatch.setattr(learners, "PACKED_ROWS", 50)
    x, y = grid(5000)
    rows = [(None if i % 3 == 2 else f"k{i % 3}", None if i % 500 == 7 else 5000 - i // 4, float(a[0]), float(a[1]), None if i % 90 == 5 else float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k string, seq long, a double, b double, y double").repartition(5)
    blocks = learners._blocks(learners._numbers(df, ["a", "b"], "y", "seq", "k"), "seq", "k", "string", 6).collect()
    first = lambda v: (v is not None, v)  # noqa: E731  nulls come first
    assert max(b._n for b in blocks) == 50 and len({b._part for b in blocks}) > 3
    for k in ("k0", "k1", None):
        got = np.concatenate([np.frombuffer(pa.decompress(bytes(b._rows), b._n * 24, "zstd")).reshape(3, -1).T for b in sorted(blocks, key=lambda b: (b._part, b._block)) if b.k == k])
        want = sorted((r[1:] for r in rows if r[0] == k), key=lambda r: tuple(map(first, r)))
        assert np.array_equal(got, np.array([r[1:] for r in want], float), equal_nan=True)
    plan = learners.replay(df, lambda: learners.OnlineLeastSquares(2), ["a", "b"], "y", "seq", "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("hashpartitioning(k") < plan.index("MapInArrow", plan.index("hashpartitioning(k")) < plan.index("rangepartitioning(k")  # the sort by rows lies below the blocks


def test_a_replay_of_more_rows_sorts_more_ranges(spark, monkeypatch):
    monkeypatch.setattr(learners, "LEAST_TASKS", 2)
    x, y = grid(3000)
    df = spark.createDataFrame([(i % 2, i, float(a[0]), float(a[1]), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k int, seq long, a double, b double, y double")
    curves = []
    for most, ranges in ((3000, 4), (299, 11)):  # 4 shuffle partitions, or 3,000 rows by 299
        monkeypatch.setattr(learners, "RANGE_ROWS", most, raising=False)
        curve = learners.replay(df, lambda: learners.OnlineLeastSquares(2), ["a", "b"], "y", "seq", "k")
        assert re.search(r"rangepartitioning\(k.*?, (\d+)\)", curve._jdf.queryExecution().executedPlan().toString())[1] == str(ranges)
        curves.append({(r.k, r.rows): (r.rmse, r.rrse) for r in curve.collect()})
    assert curves[0] == curves[1] and len(curves[0]) == 30


def test_least_squares_of_equal_inputs_fit_no_row(monkeypatch):
    x, y = np.tile([[3.0, 7.000000000000001]], (400, 1)), data(400)[1]
    one, blocks = learners.OnlineLeastSquares(2), learners.OnlineLeastSquares(2)
    want = by_rows(one, x, y)
    with monkeypatch.context() as m:
        m.setattr(np.linalg, "lstsq", None)
        got = np.concatenate([blocks.learn(x[:150], y[:150]), blocks.learn(x[150:], y[150:])])
    assert np.allclose(got, want, rtol=0, atol=1e-9) and np.allclose(blocks.weights, one.weights)
    x, y = data(300)
    assert np.allclose(blocks.learn(x, y), by_rows(one, x, y), atol=1e-8)  # and others after them


@pytest.mark.parametrize("kind", ["distinct", "grid", "given in part", "nearly given", "blocks"])
def test_total_mauve_tries_every_split(kind):
    x, y = grid(400) if kind in ("grid", "blocks") else data(150)
    y = y + np.random.default_rng(2).normal(0, 1, len(y))
    if kind in ("given in part", "nearly given"):
        x[:, 1] = np.where(x[:, 0] < 0, x[:, 0], x[:, 1]) if kind == "given in part" else x[:, 0] + 1e-7 * x[:, 1]
    cells = learners.Cells(x, y, *learners._counted(y, None, None)) if kind == "distinct" else learners.Cells.empty(2)
    if kind != "distinct":
        cells.push_all(x, y)
    at, sums, n, squares = cells.sums()
    scaled = np.column_stack([np.ones(len(y)), x[:, 0], x[:, 1] - x[:, 0] if kind != "nearly given" else (x[:, 1] - x[:, 0]) * 1e7])

    def deviation(side):
        z, b = scaled[side], y[side]
        return np.sqrt(((b - z @ np.linalg.lstsq(z, b, rcond=None)[0]) ** 2).sum() / (len(b) - 1)) if len(b) >= 4 else np.inf

    for j in range(2):
        order = np.argsort(at[:, j], kind="stable")
        got = learners.TotalMauve(*([7] if kind == "blocks" else [])).qualities(at[order], sums[order], j, n[order], squares[order])
        ends = np.flatnonzero(np.diff(at[order, j]) > 0)
        assert len(ends) == len(np.unique(x[:, j])) - 1
        for i in ends:
            sides = [x[:, j] <= at[order][i, j], x[:, j] > at[order][i, j]]
            few = min(s.sum() for s in sides)
            want = 0.0 if few < 3 else deviation(np.ones(len(y), bool)) - sum(s.sum() * deviation(s) for s in sides) / len(y)
            assert got[i] == pytest.approx(want, abs=1e-7)


def test_a_total_mauve_tree_finds_the_break_of_equal_rows():
    x, y = grid(20_000)
    tree = learners.HoeffdingTree(2, learners.TotalMauve(), chunk=500)
    tree.learn(x, y)
    assert tree.leaves() > 1 and (tree.root.input, tree.root.threshold) == (0, 4.0)


def test_least_squares_with_an_equal_input_fit_no_row(monkeypatch):
    x, y = data(800)
    x[:, 1] = 7.000000000000001
    one, blocks = learners.OnlineLeastSquares(2), learners.OnlineLeastSquares(2)
    want, got = by_rows(one, x, y), [blocks.learn(x[:20], y[:20])]
    with monkeypatch.context() as m:
        m.setattr(np.linalg, "lstsq", None)
        got += [blocks.learn(x[20:150], y[20:150]), blocks.learn(x[150:], y[150:])]
    assert np.allclose(np.concatenate(got), want, rtol=0, atol=1e-8) and np.allclose(blocks.weights, one.weights)
    x, y = data(300)
    assert np.allclose(blocks.learn(x, y), by_rows(one, x, y), atol=1e-8)  # and others after them
