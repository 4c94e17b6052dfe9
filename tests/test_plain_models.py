"""Trees, ensembles, stream learners and searches against plain versions of them."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import frame, pareto, search, split, trees
from larkspur.streaming import learners


def u(seed, *of):
    """The number that frame.draw makes."""
    return int(hashlib.md5(":".join(map(str, [seed, *of])).encode()).hexdigest()[:13], 16) / 2**52


def key(seed, *of):
    return hashlib.md5(":".join(map(str, [seed, *of])).encode()).hexdigest()


def test_draws_are_digests(spark):
    df = spark.range(50).select(F.col("id").alias("row_id"), frame.draw(3, F.col("id")).alias("u"), frame.draw(4, F.col("id"), F.lit(2)).alias("v"))
    assert all(r.u == u(3, r.row_id) and r.v == u(4, r.row_id, 2) for r in df.collect())
    drawn = [u(9, i) for i in range(4000)]
    assert abs(np.mean(drawn) - 0.5) < 0.02 and abs(np.std(drawn) - 12**-0.5) < 0.01


# trees: rows are dicts with inputs, target y and weight w


def entropy(ws):
    total = sum(ws)
    return -sum(w / total * math.log2(w / total) for w in ws if w > 0) if total else 0.0


def plain_score(kind, labels, sides):
    total = sum(r["w"] for s in sides for r in s)
    if kind == "variance":

        def var(rows):
            w = sum(r["w"] for r in rows)
            return sum(r["w"] * r["y"] ** 2 for r in rows) / w - (sum(r["w"] * r["y"] for r in rows) / w) ** 2 if w else 0.0

        whole = var([r for s in sides for r in s])
        return (whole - sum(sum(r["w"] for r in s) / total * var(s) for s in sides)) / whole if whole > 0 else 0.0
    count = lambda rows: [sum(r["w"] for r in rows if r["y"] == c) for c in labels]
    h = entropy(count([r for s in sides for r in s]))
    gain = h - sum(sum(r["w"] for r in s) / total * entropy(count(s)) for s in sides)
    both = h + entropy([sum(r["w"] for r in s) for s in sides])
    return 2 * gain / both if both else 0.0


def plain_leaf(kind, labels, rows):
    w = sum(r["w"] for r in rows)
    if kind == "variance":
        return sum(r["w"] * r["y"] for r in rows) / w
    return tuple(sum(r["w"] for r in rows if r["y"] == c) / w for c in labels)


def plain_tree(kind, labels, rows, inputs, cuts, depth, log, tried=lambda path: None, least=2, path=(), present=None):
    """A function of a row; cuts: the thresholds of each input."""
    leaf = plain_leaf(kind, labels, rows)
    pure = len({r["y"] for r in rows}) == 1
    best = None
    if len(rows) >= least and depth > 0 and not pure:
        for f, name in enumerate(inputs):
            if tried(path) is not None and f not in tried(path):
                continue
            for b, t in enumerate(cuts[name]):
                sides = [[r for r in rows if r[name] is not None and r[name] < t], [r for r in rows if r[name] is not None and r[name] >= t], [r for r in rows if r[name] is None]]
                if not sides[0] or not any(b2 == b for b2 in [sum(r[name] >= c for c in cuts[name]) - 1 for r in sides[1]]):
                    continue  # only thresholds right below a value that is there
                s = plain_score(kind, labels, sides)
                if best is None or s > best[0] + 1e-12:
                    best = (s, name, t, sides)
    if best is None or best[0] <= 1e-12:
        return lambda row: leaf
    s, name, t, sides = best
    log.append((name, s, len(rows)))
    kids = [plain_tree(kind, labels, side, inputs, cuts, depth - 1, log, tried, least, (*path, k)) if side else (lambda row: leaf) for k, side in enumerate(sides)]
    return lambda row: kids[2 if row[name] is None else int(row[name] >= t)](row)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(12)
    rows = []
    for i in range(160):
        a, b, c = rng.randrange(9), rng.choice([None, *range(6)]), rng.randrange(4)
        y = (3.0 if a > 4 else 1.0) + (0.7 * b if b is not None else 2.0) * (c > 1) + rng.random() / 5
        rows.append({"row_id": i, "a": a, "b": b, "c": c, "y": y, "t": "xyz"[min(2, int(y / 1.7))], "w": 1.0})
    df = spark.createDataFrame([(r["row_id"], float(r["a"]), None if r["b"] is None else float(r["b"]), float(r["c"]), r["y"], r["t"]) for r in rows], "row_id long, a double, b double, c double, y double, t string").cache()
    return rows, df


INPUTS = ["a", "b", "c"]


def midpoints(rows, names=INPUTS):
    values = {n: sorted({r[n] for r in rows if r[n] is not None}) for n in names}
    return {n: [(x + y) / 2 for x, y in zip(v, v[1:])] for n, v in values.items()}


def flat(v):
    return v if isinstance(v, (list, tuple)) else [v]


@pytest.mark.parametrize("kind", ["variance", "gain"])
@pytest.mark.parametrize("exact", [False, True])
def test_d06_tree_is_the_plain_one(spark, table, kind, exact):
    rows, df = table
    labels = ("x", "y", "z")
    criterion = split.VarianceReduction(("y",)) if kind == "variance" else split.InformationGain("t", labels)
    plain_rows = rows if kind == "variance" else [{**r, "y": r["t"]} for r in rows]
    log = []
    plain = plain_tree(kind, labels, plain_rows, INPUTS, midpoints(rows), 3, log)
    g = trees.grow_exact(df, INPUTS, criterion, max_depth=2 if exact else 3) if exact else trees.grow(df, INPUTS, criterion, max_depth=3)[0]
    if exact:
        log = []
        plain = plain_tree(kind, labels, plain_rows, INPUTS, midpoints(rows), 2, log)
    got = {r.row_id: r.p for r in df.select("row_id", g.tree.column().alias("p")).collect()}
    worst = max(abs(x - y) for r in plain_rows for x, y in zip(flat(got[r["row_id"]]), flat(plain(r))))
    assert worst < 1e-9 and g.tests() == len(log)
    total = sum(s * n for _, s, n in log)
    want = {}
    for name, s, n in log:  # e08: an input's share of the scores by rows
        want[name] = want.get(name, 0.0) + s * n
    scale = sum(g.importance().values()) / total
    assert {k: pytest.approx(v * scale) for k, v in want.items()} == g.importance()


def test_d09_forest_is_the_plain_one(spark, table):
    rows, df = table
    labels, seed, n = ("x", "y", "z"), 5, 3
    model = trees.forest(df, INPUTS, split.InformationGain("t", labels), trees=n, max_depth=1, seed=seed)

    def poisson(x):
        p, total = math.exp(-1), 0.0
        for k in range(7):
            total += p
            if x < total:
                return k
            p /= k + 1
        return 7

    got = {r.row_id: [r[f"p{t}"] for t in range(n)] for r in df.select("row_id", *(m.column().alias(f"p{t}") for t, m in enumerate(model.children))).collect()}
    for t in range(n):
        bag = [{**r, "y": r["t"], "w": float(k)} for r in rows if (k := poisson(u(seed + 1, r["row_id"], t)))]
        chosen = sorted(range(3), key=lambda f: key(seed, t, f))[:2]  # noqa: B023
        plain = plain_tree("gain", labels, bag, INPUTS, midpoints(rows), 1, [], lambda path: chosen)  # noqa: B023
        assert max(abs(a - b) for r in rows for a, b in zip(got[r["row_id"]][t], plain(r))) < 1e-9


def test_adaboost_is_the_plain_one(spark, table):
    rows, df = table
    plain_rows = [{**r, "y": "true" if r["a"] > 3 and r["c"] > 0 else "false"} for r in rows]
    members, sign = trees.adaboost(df.withColumn("z", (F.col("a") > 3) & (F.col("c") > 0)), ["a", "c"], "z", 3)
    votes = []
    for _ in range(3):
        tree = plain_tree("gain", ("false", "true"), plain_rows, ["a", "c"], midpoints(rows, ["a", "c"]), 1, [])
        says = [tree(r)[1] > tree(r)[0] for r in plain_rows]
        wrong = [s != (r["y"] == "true") for s, r in zip(says, plain_rows)]
        total = sum(r["w"] for r in plain_rows)
        error = min(max(sum(r["w"] for r, x in zip(plain_rows, wrong) if x) / total, 1e-9), 1 - 1e-9)
        vote = 0.5 * math.log((1 - error) / error)
        votes.append((vote, says))
        plain_rows = [{**r, "w": r["w"] * math.exp(vote if x else -vote) / total} for r, x in zip(plain_rows, wrong)]
    assert [v for v, _ in members] == pytest.approx([v for v, _ in votes])
    want = [sum(v if s[i] else -v for v, s in votes) > 0 for i in range(len(rows))]
    assert [r.p for r in df.select("row_id", sign.alias("p")).orderBy("row_id").collect()] == want


# stream learners


def stream_rows(n=700, seed=2):
    rng = np.random.default_rng(seed)
    x = np.round(rng.uniform(-2, 2, (n, 2)), 2)
    return x, np.where(x[:, 0] > 0.3, 2 * x[:, 1], -x[:, 1] + 1) + rng.normal(0, 0.05, n)


def test_i03_perceptron_is_the_plain_one():
    x, y = stream_rows(200)
    p = learners.Perceptron(2, 20, 0.1, 0.005, seed=3)
    w = np.random.default_rng(3).uniform(-1, 1, 3).tolist()
    for n, (a, b) in enumerate(zip(x, y), 1):
        mean = [sum(v[j] for v in x[:n]) / n for j in range(2)]
        sd = [max(0.0, sum(v[j] ** 2 for v in x[:n]) / n - mean[j] ** 2) ** 0.5 for j in range(2)]
        p.push(a, b)
        if n >= 20:
            z = [1.0, *((a[j] - mean[j]) / (3 * sd[j]) for j in range(2))]
            step = 0.1 / (1 + n * 0.005) * (b - sum(i * j for i, j in zip(w, z)))
            w = [i + step * j for i, j in zip(w, z)]
    assert np.allclose(p.w, w)


def test_i05_least_squares_is_a_fit_of_the_rows_so_far():
    x, y = stream_rows(60)
    o = learners.OnlineLeastSquares(2)
    for n, (a, b) in enumerate(zip(x, y), 1):
        o.push(a, b)
        if n >= 4:
            assert np.allclose(o.weights, np.linalg.lstsq(np.column_stack([np.ones(n), x[:n]]), y[:n], rcond=None)[0], atol=1e-6)


def plain_sd(v):
    return float(np.std(v)) if len(v) else 0.0


def plain_residual(x, y):
    if len(y) < 2:
        return math.inf
    sxx = sum((x - x.mean()) ** 2)
    slope = sum((x - x.mean()) * (y - y.mean())) / sxx if sxx > 1e-12 else 0.0
    return math.sqrt(max(0.0, sum((y - y.mean() - slope * (x - x.mean())) ** 2)) / (len(y) - 1))


def plain_quality(kind, x, y, j, t):
    left = x[:, j] <= t
    sides = [(x[left], y[left]), (x[~left], y[~left])]
    if kind == "sdr":
        return plain_sd(y) - sum(len(b) / len(y) * plain_sd(b) for _, b in sides)
    inputs = [j] if kind == "mauve" else range(x.shape[1])
    return max(plain_residual(x[:, k], y) - sum(len(b) / len(y) * plain_residual(a[:, k], b) for a, b in sides) for k in inputs)


@pytest.mark.parametrize("kind", ["sdr", "mauve", "extended"])
def test_i12_to_i14_qualities_are_the_plain_ones(kind):
    x, y = stream_rows(40, 5)
    quality = {"sdr": learners.StandardDeviationReduction, "mauve": learners.Mauve, "extended": learners.ExtendedMauve}[kind]()
    for j in range(2):
        order = np.argsort(x[:, j], kind="stable")
        q = quality.qualities(x[order], y[order], j)
        for i in range(2, 37):
            if x[order][i, j] < x[order][i + 1, j]:
                assert q[i] == pytest.approx(plain_quality(kind, x, y, j, x[order][i, j]), abs=1e-9)


def test_i15_total_mauve_is_about_least_squares():
    x, y = stream_rows(50, 6)
    order = np.argsort(x[:, 0], kind="stable")
    xs, ys = x[order], y[order]

    def sd(a, b):
        z = np.column_stack([np.ones(len(b)), a])
        e = b - z @ np.linalg.pinv(z) @ b
        return math.sqrt((e**2).sum() / (len(b) - 1))

    q = learners.TotalMauve(1000).qualities(xs, ys, 0)
    for i in range(5, 44):
        if xs[i, 0] < xs[i + 1, 0]:
            assert q[i] == pytest.approx(sd(xs, ys) - ((i + 1) * sd(xs[: i + 1], ys[: i + 1]) + (49 - i) * sd(xs[i + 1 :], ys[i + 1 :])) / 50, abs=1e-8)


def test_i17_breaks_are_f_statistics():
    x, y = stream_rows(60, 9)
    order = np.argsort(x[:, 0], kind="stable")
    xs, ys = x[order], np.where(x[order][:, 0] > 0, 3.0, 0.0) + y / 50

    def rss(a, b):
        z = np.column_stack([np.ones(len(b)), a])
        return float(((b - z @ np.linalg.lstsq(z, b, rcond=None)[0]) ** 2).sum())

    q = learners.QuandtAndrews(2.0).qualities(xs, ys, 0)
    for i in range(3, 56):
        left, right = rss(xs[: i + 1, 0], ys[: i + 1]), rss(xs[i + 1 :, 0], ys[i + 1 :])
        f = (rss(xs[:, 0], ys) - left - right) * (60 - 4) / ((left + right) * 2)
        assert q[i] == pytest.approx(f, rel=1e-6) if f > 2.001 else q[i] == -np.inf or f > 1.999
    assert abs(xs[int(np.argmax(q)), 0]) < 0.2
    tree = learners.HoeffdingTree(2, learners.QuandtAndrews(), chunk=20)
    for a, b in zip(x, np.where(x[:, 0] > 0, 3.0, 0.0)):
        tree.push(a, float(b))
    assert tree.leaves() > 1


class PlainTree:
    """Leaves as lists of rows, looked through from scratch."""

    def __init__(self, chunk, delta, tie):
        self.chunk, self.delta, self.tie = chunk, delta, tie
        self.leaves = [{"test": lambda v: True, "rows": [], "seen": 0, "best": None, "ratios": []}]

    def leaf(self, x):
        return next(k for k in self.leaves if k["test"](x))

    def predict(self, x):
        rows = self.leaf(x)["rows"]
        if len(rows) < 3:
            return sum(b for _, b in rows) / max(1, len(rows))
        z = np.column_stack([np.ones(len(rows)), [a for a, _ in rows]])
        w = np.linalg.lstsq(z, np.array([b for _, b in rows]), rcond=None)[0]
        return float(w[0] + w[1:] @ x)

    def push(self, x, y):
        k = self.leaf(x)
        k["rows"].append((x, y))
        k["seen"] += 1
        if k["seen"] % self.chunk == 0:
            xs, ys = np.array([a for a, _ in k["rows"]]), np.array([b for _, b in k["rows"]])
            found = []
            for j in range(2):
                values = sorted(set(xs[:, j]))[:-1]
                q = [(plain_quality("sdr", xs, ys, j, t), -i, t) for i, t in enumerate(values)]
                if q:
                    s, _, t = max(q, key=lambda e: (round(e[0], 12), e[1]))
                    found.append((s, j, t))
            found = sorted(found, key=lambda e: -e[0])[:2]
            if k["best"] is None or [f[1:] for f in found] != [f[1:] for f in k["best"]]:
                k["ratios"] = []
            k["best"] = found
        if k["best"] and len(k["best"]) == 2 and k["best"][0][0] > 0:
            k["ratios"].append(max(0.0, k["best"][1][0]) / k["best"][0][0])
            bound = math.sqrt(math.log(1 / self.delta) / (2 * k["seen"]))
            if sum(k["ratios"]) / len(k["ratios"]) < 1 - bound or bound < self.tie:
                _, j, t = k["best"][0]
                self.leaves.remove(k)
                for side in (True, False):
                    test = lambda v, o=k["test"], j=j, t=t, s=side: o(v) and (v[j] <= t) == s
                    rows = [r for r in k["rows"] if (r[0][j] <= t) == side]
                    self.leaves.append({"test": test, "rows": rows, "seen": len(rows), "best": None, "ratios": []})


def test_i08_hoeffding_tree_is_the_plain_one():
    x, y = stream_rows()
    tree, plain = learners.HoeffdingTree(2, chunk=50), PlainTree(50, 0.01, 0.05)
    for a, b in zip(x, y):
        tree.push(a, float(b))
        plain.push(a, float(b))
    assert tree.leaves() == len(plain.leaves) > 2
    assert np.allclose([tree.predict(a) for a in x[::7]], [plain.predict(a) for a in x[::7]], atol=1e-6)
    bounded = learners.HoeffdingTree(2, learners.Never(), memory=100)
    for a, b in zip(x, y):
        bounded.push(a, float(b))
    assert np.array_equal(bounded.root.rows.x, x[-100:]) and bounded.leaves() == 1 and bounded.root.seen == len(y)


def test_i06_extra_tree_is_the_plain_one():
    x, y = stream_rows(150, 8)
    tree, rng, leaves = learners.ExtraTree(2, 5, 4), np.random.default_rng(4), [(lambda v: True, [])]
    for a, b in zip(x, y):
        tree.push(a, float(b))
        test, rows = next(k for k in leaves if k[0](a))
        rows.append((a, float(b)))
        if len(rows) >= 5:
            j = int(rng.integers(2))
            values = [v[j] for v, _ in rows]
            if max(values) > min(values):
                t = float(rng.uniform(min(values), max(values)))
                if any(v > t for v in values) and any(v <= t for v in values):
                    leaves.remove((test, rows))
                    for side in (False, True):
                        leaves.append((lambda v, o=test, j=j, t=t, s=side: o(v) and (v[j] > t) == s, [r for r in rows if (r[0][j] > t) == side]))
    for a in x[::5]:
        rows = next(k for k in leaves if k[0](a))[1]
        assert tree.predict(a) == pytest.approx(sum(b for _, b in rows) / len(rows))


# searches


def test_o06_surrogates_are_the_plain_ones(spark):
    rng = np.random.default_rng(1)
    x, y = rng.uniform(0, 2, (12, 2)), rng.normal(size=12)
    model = search.GaussianProcess(0.5).fit(x, y)
    at = rng.uniform(0, 2, (5, 2))
    width = max(np.ptp(x, axis=0)) / 4
    k = lambda a, b: math.exp(-sum((a - b) ** 2) / (2 * width**2))
    gram = np.array([[k(a, b) + (0.5e-2 if i == j else 0) for j, b in enumerate(x)] for i, a in enumerate(x)])
    mean, variance = model.predict(at)
    for a, m, v in zip(at, mean, variance):
        row = np.array([k(a, b) for b in x])
        assert m == pytest.approx(y.mean() + row @ np.linalg.solve(gram, y - y.mean()), abs=1e-6) and v == pytest.approx(max(0, 1 - row @ np.linalg.solve(gram, row)), abs=1e-6)
    best = search.surrogate_search(spark, search.Problem([-1.0, -1.0], [1.0, 1.0], lambda v: (v[0] - 0.3) * (v[0] - 0.3) + (v[1] - 0.6) * (v[1] - 0.6)), 8, 3, 200)
    assert best.fitness < 0.3 and best.fitness == pytest.approx((best.x0 - 0.3) ** 2 + (best.x1 - 0.6) ** 2)


def test_o11_mutations_stay_in_the_box_and_follow_their_formulas():
    low, high = np.zeros(3), np.ones(3)
    rng, twin = np.random.default_rng(5), np.random.default_rng(5)
    got = search.polynomial_mutation(np.full(3, 0.9), low, high, 1.0, 5.0, rng)
    r, _ = twin.random(3), twin.random(3)
    want = [0.9 + ((2 * v) ** (1 / 6) - 1 if v < 0.5 else 1 - (2 * (1 - v)) ** (1 / 6)) for v in r]
    assert np.allclose(got, np.clip(want, 0, 1))
    a, b = search.sbx_crossover(low + 0.2, high - 0.3, low - 9, high + 9, 2.0, rng)
    assert np.allclose(a + b, 0.2 + 0.7)  # children are spread about the parents' middle
    x, f = search.local_search_mutation(np.full(3, 0.9), lambda v: np.array([(v**2).sum()]), low, high, 200, rng)
    assert f[0] < 0.2 and f[0] == pytest.approx((x**2).sum())
    for m in (search.uniform_mutation(x, low, high, 1.0, rng), search.non_uniform_mutation(x, low, high, 1.0, 0.5, 2.0, rng)):
        assert ((m >= 0) & (m <= 1)).all()


def test_o10_fronts_lie_on_the_true_one():
    two = lambda w: np.array([w[0] ** 2 + w[1] ** 2, (w[0] - 1) ** 2 + w[1] ** 2])
    for solve in (search.nsga2, search.smpso, search.omopso, lambda *a: search.abyss(*a, 16, 10), lambda *a: search.amosa(*a, 20, steps=30)):
        x, f = solve(two, [-2, -2], [2, 2])
        assert len(f) > 8 and np.allclose(f, [two(v) for v in x]) and np.median(np.sqrt(f).sum(axis=1)) < 1.02
        assert not any((a <= b).all() and (a < b).any() for a in f for b in f)


def test_g05_searches_find_the_longest_sum():
    actions = lambda s: [0, 1, 2] if len(s) < 5 else []
    apply = lambda s, a: (*s, a)
    assert search.beam_rollout((), actions, apply, sum, 2, 10, seed=1)[0] == 10
    assert search.tree_search((), actions, apply, sum, 600)[0] >= 9
    value, path = search.step_search((), actions, apply, lambda s: search.tree_search(s, actions, apply, sum, 60))
    assert value >= 9 and sum(path) == value and len(path) == 5


def test_crowding_of_a_whole_table(spark):
    rng = random.Random(6)
    pts = [(i, rng.randint(0, 400), rng.random()) for i in range(700)]
    got = {r.k: r.crowding for r in pareto.crowding(spark.createDataFrame(pts, "k int, a int, b double").repartition(5), [("a", 1), ("b", -1)]).collect()}
    for j in (2,):
        order = sorted(pts, key=lambda p: p[j])
        gaps = {p[0]: (q[j] - o[j]) / (order[-1][j] - order[0][j]) for o, p, q in zip(order, order[1:], order[2:])}
    a = sorted(p[1] for p in pts)
    for k, x, _ in pts:
        if k not in gaps or got[k] == pareto.FAR:
            assert got[k] == pareto.FAR and (k not in gaps or x in (a[0], a[-1]))
            continue
        least = min((q - o) for o, p, q in zip(a, a[1:], a[2:]) if p == x) / (a[-1] - a[0])
        most = max((q - o) for o, p, q in zip(a, a[1:], a[2:]) if p == x) / (a[-1] - a[0])
        assert least - 1e-9 <= got[k] - gaps[k] <= most + 1e-9  # rows that tie may stand in any order


def test_volumes_and_spreads_of_any_number_of_objectives(spark):
    rng = random.Random(3)
    for d in (1, 2, 3, 4):
        pts = [tuple(rng.randint(0, 5) for _ in range(d)) for _ in range(14)]
        names = [f"o{i}" for i in range(d)]
        df = spark.createDataFrame(pts, ", ".join(f"{n} int" for n in names))
        signs = [1 if i % 2 == 0 else -1 for i in range(d)]
        reference = [1 if s > 0 else 5 for s in signs]
        gains = [[(x - r) * s for x, r, s in zip(p, reference, signs)] for p in pts]
        cells = sum(any(all(g > c for g, c in zip(gain, cell)) for gain in gains) for cell in np.ndindex(*[5] * d))
        assert pareto.hypervolume(df, list(zip(names, signs)), reference).first()[0] == pytest.approx(cells)
    front = [(0.0, 0.0, 3.0), (0.0, 3.0, 0.0), (3.0, 0.0, 0.0), (0.0, 1.0, 2.0)]
    near = [min(math.dist(a, b) for b in front if b != a) for a in front]
    got = pareto.spread(spark.createDataFrame(front, "a double, b double, c double"), [("a", 1), ("b", 1), ("c", 1)]).first()[0]
    assert got == pytest.approx(sum(abs(x - sum(near) / 4) for x in near) / sum(near))


def test_p09_spea2_over_strips_is_that_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pareto, "STRIP_POINTS", 40)
    rng = random.Random(8)
    few = [(i, rng.randint(0, 12), float(rng.randint(0, 9))) for i in range(150)]
    far = [(i, rng.randint(-900, 900), rng.random() * 10 ** rng.randint(0, 3)) for i in range(300)]
    holes = [(0, None, 1.0), (1, 3, None), (2, 3, 1.0), (3, 5, 2.0), (4, 5, 2.0)]
    for pts in (few, far, holes, [(0, 1, 1.0)], [(i, 7, float(i % 50)) for i in range(90)]):
        df = spark.createDataFrame(pts, "k int, a int, b double")
        got = {r.k: (r.strength, r.raw, r.fitness) for r in pareto.spea2(df, [("a", 1), ("b", -1)], "k").collect()}
        full = [p for p in pts if None not in p]
        beats = lambda p, q: p[1] >= q[1] and p[2] <= q[2] and p[1:] != q[1:]
        strength = {p[0]: sum(beats(p, q) for q in full) for p in full}
        assert len(got) == len(pts)
        for p in pts:
            raw = sum(strength[q[0]] for q in full if beats(q, p)) if p in full else 0
            near = min((math.dist(p[1:], q[1:]) for q in full if q[0] != p[0]), default=None) if p in full else None
            assert got[p[0]] == (strength.get(p[0], 0), raw, pytest.approx(raw + (0.5 if near is None else 1 / (2 + near))))


def test_p09_spea2_makes_no_pairs(spark):
    df = spark.range(3000).selectExpr("id as k", "(id * 7919) % 1000 as a", "cast((id * 104729) % 997 as double) as b")
    plan = pareto.spea2(df, [("a", 1), ("b", 1)], "k")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
