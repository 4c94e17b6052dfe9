"""Decision trees and ensembles, grown level by level (inventory D6-D12, D30-D31).

Each level is one aggregation over (tree, node, input, bin) whatever the number of
nodes and trees; bins are the distinct values of an input, or its quantiles when it has
more than MAX_BINS (grow_exact tries all values, with a prefix sum for each node). The table of sums is bounded by nodes x inputs x bins, and of it
only the chosen splits come to the driver. A tree is an expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.frame import ROW, draw, drawn_key
from larkspur.operators.split import Criterion, InformationGain, best_threshold
from larkspur.plans.expr import Aggregate, Apply, Constant, Expr, Stump, Test, Variable, importance

MAX_BINS = 256


@dataclass
class Grown:
    """A tree and the log of its splits: input, score, rows."""

    tree: Expr
    log: list[tuple[str, float, int]] = field(default_factory=list)
    rows: int = 0

    def importance(self) -> dict[str, float]:
        return importance(self.log, self.rows)

    def tests(self) -> int:
        return sum(isinstance(x, Test) for x in self.tree.walk())


@dataclass
class _Node:
    tree: int
    path: tuple[tuple[str, float, str], ...]
    depth: int
    split: tuple[str, float] | None = None
    value: object = None
    children: dict[str, _Node] = field(default_factory=dict)

    def expression(self) -> Expr:
        if self.split is None:
            return Constant(self.value)
        name, threshold = self.split
        return Test(Stump((Variable(name),), threshold), *(self.children[b].expression() for b in "ftm"))


def candidate_thresholds(df: DataFrame, inputs: Sequence[str], most: int = MAX_BINS) -> dict[str, list[float]]:
    """For each input the midpoints between its values, or between its quantiles if it has more than `most` values."""
    distinct = df.agg(*(F.approx_count_distinct(c).alias(c) for c in inputs)).first()
    out = {}
    few = [c for c in inputs if distinct[c] <= most]
    if few:
        sets = df.agg(*(F.collect_set(F.col(c).cast("double")).alias(c) for c in few)).first()  # about `most` values each
        out |= {c: sorted(sets[c]) for c in few}
    many = [c for c in inputs if c not in out]
    if many:  # one pass for all
        found = df.select(*(F.col(c).cast("double").alias(c) for c in many)).approxQuantile(many, [i / most for i in range(most + 1)], 0.25 / most)
        out |= {c: sorted(set(v)) for c, v in zip(many, found)}
    return {c: [(a + b) / 2 for a, b in zip(v, v[1:])] for c, v in out.items()}


def _bin(x: Column, cuts: list[float]) -> Column:
    """How many thresholds x reaches; -1 for null."""
    if not cuts:
        return F.when(x.isNull(), F.lit(-1)).otherwise(F.lit(0))
    place = F.array_size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= x)) if len(cuts) <= 8 else _search(x, cuts, 0, len(cuts))
    return F.when(x.isNull(), F.lit(-1)).otherwise(place)


def _search(x: Column, cuts: list[float], lo: int, hi: int) -> Column:
    """A binary search as nested conditions."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(x >= cuts[mid], _search(x, cuts, mid + 1, hi)).otherwise(_search(x, cuts, lo, mid))


def _at(paths: Sequence[tuple[int, _Node]], roots: list[_Node]) -> list[Column]:
    """For each tree the number of the open node that a row is in, null where it is in a leaf."""
    number = {id(n): i for i, n in paths}

    def where(n: _Node) -> Column:
        if n.split is None:
            return F.lit(number.get(id(n))).cast("int")
        x = F.col(n.split[0])
        return F.when(x.isNull(), where(n.children["m"])).when(x >= n.split[1], where(n.children["t"])).otherwise(where(n.children["f"]))

    return [where(r) for r in roots]


def grow(df: DataFrame, inputs: Sequence[str], criterion: Criterion, trees: int = 1, min_examples: int = 2, max_depth: int = 0, bags: bool = False, random_inputs: int = 0, seed: int = 0, max_bins: int = MAX_BINS) -> list[Grown]:
    """Trees on df. bags: each on a bootstrap of the rows (by Poisson weights of the row id); random_inputs: that many inputs are tried at each node.

    A node is a leaf if it has fewer than min_examples rows, is at max_depth (0: none), has a constant target, or no split scores above 0.
    """
    cuts = candidate_thresholds(df, inputs, max_bins)
    sums = criterion.sums()
    names = list(sums)
    target = [criterion.label] if isinstance(criterion, InformationGain) else list(criterion.targets)
    weight = F.lit(1.0) if criterion.weight is None else F.col(criterion.weight).cast("double")
    binned = df.select(*([ROW] if bags else []), *target, *inputs, weight.alias("_w"), *(_bin(F.col(c).cast("double"), cuts[c]).alias(f"_b{i}") for i, c in enumerate(inputs)))
    binned = binned.persist()
    criterion_w = type(criterion)(**{**criterion.__dict__, "weight": "_w"})
    sums = criterion_w.sums()
    roots = [_Node(t, (), 0) for t in range(trees)]
    open_, logs, rows = list(roots), [[] for _ in range(trees)], [0] * trees
    while open_:
        numbered = list(enumerate(open_))
        per_tree = [F.struct(F.lit(t).alias("tree"), w.alias("node"), (_poisson(draw(seed + 1, F.col(ROW), F.lit(t))) if bags else F.lit(1.0)).alias("m")) for t, w in enumerate(_at(numbered, roots))]
        rowed = binned.withColumn("_tree", F.explode(F.array(*per_tree))).where(F.col("_tree.node").isNotNull() & (F.col("_tree.m") > 0)).withColumn("_w", F.col("_w") * F.col("_tree.m"))
        long = rowed.withColumn("_f", F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"_b{i}").alias("b")) for i in range(len(inputs))))))
        table = long.groupBy(F.col("_tree.node").alias("node"), F.col("_f.f").alias("f"), F.col("_f.b").alias("b")).agg(F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in sums.items()))
        best = _best_splits(table, names, criterion_w, random_inputs, seed).collect()  # one row for each open node
        done = {r.node: r for r in best}
        following = []
        for i, node in numbered:
            r = done.get(i)
            if node.depth == 0:
                rows[node.tree] = r.n if r else 0
            node.value = _leaf(criterion, r)
            if r is None or r.n < min_examples or max_depth and node.depth >= max_depth or r.pure or r.score is None or r.score <= 1e-12:
                continue
            name = inputs[r.f]
            node.split = (name, cuts[name][r.b - 1])
            logs[node.tree].append((name, r.score, r.n))
            for b in "ftm":
                node.children[b] = _Node(node.tree, (*node.path, (*node.split, b)), node.depth + 1, value=node.value)
            following += [node.children[b] for b in "ftm" if b != "m" or r.missing]
        open_ = following
    binned.unpersist()
    return [Grown(r.expression(), log, n) for r, log, n in zip(roots, logs, rows)]


def grow_exact(df: DataFrame, inputs: Sequence[str], criterion: Criterion, min_examples: int = 2, max_depth: int = 0) -> Grown:
    """A tree like that of grow(), for which every midpoint of neighbouring values is tried, however many there are.

    Each node takes a search for each input (split.best_threshold) over its own rows.
    """
    from larkspur.plans.store import kept

    sums = criterion.sums()
    target = [criterion.label] if isinstance(criterion, InformationGain) else list(criterion.targets)
    columns = [*target, *inputs, *([criterion.weight] if criterion.weight else [])]
    root, log, total = _Node(0, (), 0), [], 0
    work = [(root, kept(df.select(*dict.fromkeys(columns)), "rows"))]
    while work:
        node, rows = work.pop()
        r = rows.agg(F.count(F.lit(1)).alias("n"), *(c.alias(n) for n, c in sums.items())).first()
        total = total or r.n
        node.value = _leaf(criterion, r) if r.n else node.value
        pure = rows.sparkSession.range(1).select((criterion.entropy if isinstance(criterion, InformationGain) else criterion.variance)({n: F.lit(float(r[n])) for n in sums}).alias("p")).first().p
        if r.n < min_examples or max_depth and node.depth >= max_depth or pure <= 1e-12:
            continue
        found = [(b.score, -i, b.threshold) for i, x in enumerate(inputs) if (b := best_threshold(rows.withColumn(x, F.col(x).cast("double")), x, criterion).first()) is not None]
        if not found or max(found)[0] <= 1e-12:
            continue
        score, at, threshold = max(found)
        name = inputs[-at]
        node.split = (name, threshold)
        log.append((name, score, r.n))
        x = F.col(name).cast("double")
        for b, side in (("f", x < threshold), ("t", x >= threshold), ("m", x.isNull())):
            node.children[b] = _Node(0, (*node.path, (*node.split, b)), node.depth + 1, value=node.value)
            work.append((node.children[b], kept(rows.where(side), "rows")))
    return Grown(root.expression(), log, total)


def _best_splits(table: DataFrame, names: list[str], criterion: Criterion, random_inputs: int, seed: int) -> DataFrame:
    """Of each node: its rows, sums, and the input, bin and score of its best split."""
    order = Window.partitionBy("node", "f").orderBy(F.col("b"))
    whole = Window.partitionBy("node", "f")
    run = table.select(
        "node", "f", "b", F.sum("rows").over(whole).alias("n"),
        *(F.coalesce(F.sum(F.when(F.col("b") >= 0, F.col(n))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias(f"f_{n}") for n in names),
        *(F.sum(n).over(whole).alias(f"a_{n}") for n in names),
        *(F.coalesce(F.max(F.when(F.col("b") < 0, F.col(n))).over(whole), F.lit(0.0)).alias(f"m_{n}") for n in names),
        F.coalesce(F.max(F.when(F.col("b") < 0, F.lit(True))).over(whole), F.lit(False)).alias("missing"),
        (F.lag("b").over(order)).alias("lower"),
    )
    low = {n: F.col(f"f_{n}") for n in names}
    miss = {n: F.col(f"m_{n}") for n in names}
    high = {n: F.col(f"a_{n}") - low[n] - miss[n] for n in names}
    scored = run.withColumn("score", F.when((F.col("b") > 0) & (F.coalesce(F.col("lower"), F.lit(-1)) >= 0), criterion.score([low, high, miss])))
    if random_inputs:
        chosen = table.select("node", "f").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy(drawn_key(seed, "node", "f")))).where(F.col("_r") <= random_inputs).select("node", "f")
        scored = scored.join(F.broadcast(chosen.withColumn("tried", F.lit(True))), ["node", "f"], "left").withColumn("score", F.when(F.col("tried"), F.col("score")))
    pick = F.max(F.struct(F.coalesce("score", F.lit(-1.0)).alias("s"), (-F.col("f")).alias("f"), (-F.col("b")).alias("b"), "missing"))
    whole_sums = {n: F.col(f"a_{n}") for n in names}
    pure = criterion.entropy(whole_sums) if isinstance(criterion, InformationGain) else criterion.variance(whole_sums)
    out = scored.withColumn("pure", pure <= 1e-12).groupBy("node").agg(pick.alias("p"), F.first("n").alias("n"), F.first("pure").alias("pure"), *(F.first(f"a_{n}").alias(n) for n in names))
    return out.select("node", "n", "pure", *names, F.col("p.s").alias("score"), (-F.col("p.f")).alias("f"), (-F.col("p.b")).alias("b"), F.col("p.missing").alias("missing"))


def _poisson(u: Column) -> Column:
    """A Poisson(1) number from a uniform one: how often a row is drawn into a bootstrap."""
    out, p, total = F.lit(7.0), 2.718281828459045**-1, 0.0
    steps = []
    for k in range(7):
        total += p
        steps.append((k, total))
        p /= k + 1
    for k, limit in reversed(steps):
        out = F.when(u < limit, F.lit(float(k))).otherwise(out)
    return out


def _leaf(criterion: Criterion, r) -> object:
    """The vote of a node: class shares, or the mean (of each target)."""
    if r is None:
        return None
    if isinstance(criterion, InformationGain):
        w = [r[f"w{i}"] for i in range(len(criterion.labels))]
        return tuple(x / sum(w) if sum(w) else 0.0 for x in w)
    means = tuple(r[f"s{i}"] / r["w"] if r["w"] else 0.0 for i in range(len(criterion.targets)))
    return means[0] if len(means) == 1 else means


def forest(df: DataFrame, inputs: Sequence[str], criterion: Criterion, trees: int, **options) -> Expr:
    """An ensemble of bagged trees over random inputs, the square root of their number at each node."""
    members = grow(df, inputs, criterion, trees, bags=True, random_inputs=int(len(inputs) ** 0.5 + 0.5), **options)
    return Aggregate(tuple(m.tree for m in members))


def l2_boosting(df: DataFrame, inputs: Sequence[str], target: str, rounds: int, rate: float = 0.5, **options) -> Expr:
    """Trees that each fit what those before leave of the target; the sum of their votes, with the mean first."""
    from larkspur.operators.split import VarianceReduction
    from larkspur.plans.store import kept

    mean = df.agg(F.avg(target)).first()[0] or 0.0
    model: Expr = Constant(float(mean))
    left = df.select(*inputs, (F.col(target) - mean).alias("_left"))
    for _ in range(rounds):
        tree = _scaled(grow(left, inputs, VarianceReduction(("_left",)), **options)[0].tree, rate)
        model = Apply("+", (model, tree))
        left = kept(left.withColumn("_left", F.col("_left") - F.coalesce(tree.column(), F.lit(0.0))), "residuals")
    return model


def _scaled(tree: Expr, by: float) -> Expr:
    """A tree with its votes multiplied."""
    if isinstance(tree, Constant):
        return Constant((tree.value or 0.0) * by)
    return Test(tree.condition, *(_scaled(x, by) for x in (tree.failure, tree.success, tree.missing)))


def adaboost(df: DataFrame, inputs: Sequence[str], target: str, rounds: int, depth: int = 1) -> tuple[list[tuple[float, Expr]], Column]:
    """Small trees of a boolean target on weights that follow the errors; their votes, and the sign of their sum as a Column."""
    from larkspur.plans.store import kept

    left = df.where(F.col(target).isNotNull()).select(*inputs, F.col(target).cast("string").alias("_t"), F.lit(1.0).alias("_weight"))
    criterion = InformationGain("_t", ("false", "true"), "_weight")
    members: list[tuple[float, Expr]] = []
    for _ in range(rounds):
        tree = grow(left, inputs, criterion, max_depth=depth)[0].tree
        says = tree.column()[1] > tree.column()[0]
        wrong = says != (F.col("_t") == "true")
        r = left.agg(F.sum(F.when(wrong, F.col("_weight")).otherwise(0.0)).alias("e"), F.sum("_weight").alias("w")).first()
        error = min(max((r.e or 0.0) / r.w, 1e-9), 1 - 1e-9)
        if error >= 0.5:
            break
        vote = 0.5 * math.log((1 - error) / error)
        members.append((vote, tree))
        scale = F.when(wrong, F.lit(math.exp(vote))).otherwise(F.lit(math.exp(-vote))) / r.w
        left = kept(left.withColumn("_weight", F.col("_weight") * scale), "weights")
        if error <= 1e-9:
            break
    total = F.lit(0.0)
    for vote, tree in members:
        total = total + F.when(tree.column()[1] > tree.column()[0], F.lit(vote)).otherwise(F.lit(-vote))
    return members, total > 0
