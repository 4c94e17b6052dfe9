"""Split criteria and threshold search (inventory D1-D5).

A criterion is a list of sums per branch and a score of the sums of three branches
(false, true, missing). Threshold search adds the sums up per distinct value, runs them
up in order, and scores the midpoint of each two neighbours: one aggregation, a prefix
sum in two levels, and no task that holds more than a range of distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.frame import draw

Sums = dict[str, Column]
PARTS = 64


def _plogp(w: Column, total: Column) -> Column:
    p = F.try_divide(w, total)
    return F.when(w > 0, -p * F.log2(p)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class InformationGain:
    """Bits of the label that the branch tells; normalised: over the mean of both entropies."""

    label: str
    labels: tuple
    weight: str | None = None
    normalised: bool = True

    def sums(self) -> Sums:
        w = F.lit(1.0) if self.weight is None else F.col(self.weight).cast("double")
        return {f"w{i}": F.coalesce(F.sum(F.when(F.col(self.label) == F.lit(x), w)), F.lit(0.0)) for i, x in enumerate(self.labels)}

    def entropy(self, s: Sums) -> Column:
        total = sum(list(s.values())[1:], list(s.values())[0])
        return sum((_plogp(w, total) for w in s.values()), F.lit(0.0))

    def score(self, branches: Sequence[Sums]) -> Column:
        names = list(branches[0])
        weights = [sum((b[n] for n in names[1:]), b[names[0]]) for b in branches]
        whole = {n: sum((b[n] for b in branches[1:]), branches[0][n]) for n in names}
        total = sum(weights[1:], weights[0])
        h = self.entropy(whole)
        gain = h - sum((F.coalesce(F.try_divide(w, total), F.lit(0.0)) * self.entropy(b) for w, b in zip(weights, branches)), F.lit(0.0))
        if not self.normalised:
            return gain
        split = sum((_plogp(w, total) for w in weights), F.lit(0.0))
        return F.coalesce(F.try_divide(2 * gain, h + split), F.lit(0.0))


@dataclass(frozen=True)
class VarianceReduction:
    """The share of the target's variance that the branches remove; over several targets, of the sum of their variances."""

    targets: tuple[str, ...]
    weight: str | None = None

    def sums(self) -> Sums:
        w = F.lit(1.0) if self.weight is None else F.col(self.weight).cast("double")
        out = {"w": F.coalesce(F.sum(w), F.lit(0.0))}
        for i, t in enumerate(self.targets):
            y = F.col(t).cast("double")
            out |= {f"s{i}": F.coalesce(F.sum(y * w), F.lit(0.0)), f"q{i}": F.coalesce(F.sum(y * y * w), F.lit(0.0))}
        return out

    def variance(self, s: Sums) -> Column:
        each = (F.try_divide(s[f"q{i}"], s["w"]) - F.pow(F.try_divide(s[f"s{i}"], s["w"]), F.lit(2.0)) for i in range(len(self.targets)))
        return F.greatest(F.coalesce(sum(each, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))

    def score(self, branches: Sequence[Sums]) -> Column:
        whole = {n: sum((b[n] for b in branches[1:]), branches[0][n]) for n in branches[0]}
        v = self.variance(whole)
        left = sum((F.coalesce(F.try_divide(b["w"], whole["w"]), F.lit(0.0)) * self.variance(b) for b in branches), F.lit(0.0))
        return F.coalesce(F.try_divide(v - left, v), F.lit(0.0))


Criterion = InformationGain | VarianceReduction


def score_condition(df: DataFrame, condition: Column, criterion: Criterion) -> DataFrame:
    """score: of a boolean column as it is, without a threshold; one aggregation to one row."""
    aggregated = df.groupBy(F.when(condition.isNull(), "m").when(condition, "t").otherwise("f").alias("branch")).agg(*(c.alias(n) for n, c in criterion.sums().items()))
    names = list(criterion.sums())
    wide = aggregated.agg(*(F.coalesce(F.max(F.when(F.col("branch") == b, F.col(n))), F.lit(0.0)).alias(f"{b}_{n}") for b in "ftm" for n in names))
    return wide.select(criterion.score([{n: F.col(f"{b}_{n}") for n in names} for b in "ftm"]).alias("score"))


def running_sums(df: DataFrame, x: str, names: list[str], parts: int = PARTS) -> DataFrame:
    """df, whose x is distinct, with up_<name>: sums over the values up to x, and `prior`, the value before."""
    cuts = sorted(set(df.approxQuantile(x, [i / parts for i in range(1, parts)], 0.5 / parts)))
    part = F.lit(0)
    for c in cuts:
        part = part + (F.col(x) > c).cast("int")
    dealt = df.withColumn("_part", part)
    order = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over `parts` rows
    totals = dealt.groupBy("_part").agg(F.max(x).alias("_last"), *(F.sum(n).alias(f"_t_{n}") for n in names))
    before = totals.select("_part", F.max("_last").over(order).alias("_prior"), *(F.coalesce(F.sum(f"_t_{n}").over(order), F.lit(0.0)).alias(f"_b_{n}") for n in names))
    inside = Window.partitionBy("_part").orderBy(x)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(before), "_part").select(
        *df.columns, F.coalesce(F.lag(x).over(inside), F.col("_prior")).alias("prior"), *((F.sum(n).over(upto) + F.col(f"_b_{n}")).alias(f"up_{n}") for n in names)
    )


def threshold_scores(df: DataFrame, x: str, criterion: Criterion) -> DataFrame:
    """threshold, score of every midpoint of neighbouring values of x."""
    sums = criterion.sums()
    names = list(sums)
    missing = df.where(F.col(x).isNull()).agg(*(c.alias(f"m_{n}") for n, c in sums.items()))
    values = df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("x")).agg(*(c.alias(n) for n, c in sums.items()))
    total = values.agg(*(F.coalesce(F.sum(n), F.lit(0.0)).alias(f"all_{n}") for n in names))
    run = running_sums(values, "x", names).where(F.col("prior").isNotNull()).join(F.broadcast(total.join(F.broadcast(missing))))
    low = {n: F.col(f"up_{n}") - F.col(n) for n in names}
    high = {n: F.col(f"all_{n}") - low[n] for n in names}
    return run.select(((F.col("x") + F.col("prior")) / 2).alias("threshold"), criterion.score([low, high, {n: F.col(f"m_{n}") for n in names}]).alias("score"))


def best_threshold(df: DataFrame, x: str, criterion: Criterion, tolerance: float = 1e-12) -> DataFrame:
    """threshold, score: of the thresholds that tie for the best score the middle one, counted from above."""
    scored = threshold_scores(df, x, criterion)
    best = scored.agg(F.max("score").alias("score"))
    ties = scored.withColumnRenamed("score", "s").join(F.broadcast(best)).where(F.col("s") >= F.col("score") - tolerance)
    down = F.sort_array(F.collect_list("threshold"), asc=False)  # thresholds that tie exactly
    return ties.groupBy("score").agg(down.alias("t")).select(F.get("t", F.floor(F.size("t") / 2).cast("int")).alias("threshold"), "score")


def random_threshold(df: DataFrame, x: str, seed: int) -> DataFrame:
    """threshold: uniform between the least and the greatest value."""
    u = draw(seed, F.lit(x))
    return df.agg((F.min(x) + u * (F.max(x) - F.min(x))).alias("threshold"))


def _sd(n: Column, s: Column, q: Column) -> Column:
    return F.sqrt(F.greatest(F.coalesce(F.try_divide(q, n) - F.pow(F.try_divide(s, n), F.lit(2.0)), F.lit(0.0)), F.lit(0.0)))


def deviation_reduction(condition: Column, y: Column) -> Column:
    """An aggregate: the deviation of y less that of both sides by their shares."""
    known = condition.isNotNull() & y.isNotNull()
    on = lambda test, v: F.coalesce(F.sum(F.when(known & test, v)), F.lit(0.0))
    sides = [tuple(on(t, v) for v in (F.lit(1.0), y, y * y)) for t in (condition, ~condition)]
    whole = tuple(a + b for a, b in zip(*sides))
    return _sd(*whole) - sum((F.coalesce(F.try_divide(s[0], whole[0]), F.lit(0.0)) * _sd(*s) for s in sides), F.lit(0.0))


def residual_reduction(condition: Column, x: Column, y: Column) -> Column:
    """An aggregate: the same of the residuals about lines of y on x."""
    from larkspur.functions.stats import pair_sums, residual_sd

    sides = [pair_sums(F.when(t, x), y) for t in (condition, ~condition)]
    whole = {k: sides[0][k] + sides[1][k] for k in sides[0]}
    return residual_sd(whole) - sum((F.coalesce(F.try_divide(s["n"], whole["n"]) * residual_sd(s), F.lit(0.0)) for s in sides), F.lit(0.0))
