"""Aggregates as Columns (inventory A1-A32): moments, correlation, least squares, confusion, histograms.

All are sums, counts, minima and maxima, so Spark aggregates them partially before
each shuffle and merges them; a weight of -1 takes a row out again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.vectors import EPSILON, stats

_D = "double"


def _sum(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0.0))


# across columns of a row


def row_mean(*columns: Column) -> Column:
    """Mean of k columns of a row; a null counts as 0, and in k."""
    return sum((F.coalesce(c, F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0.0))) / len(columns)


def row_stats(*columns: Column) -> Column:
    """count, sum, sum of squares, min, max of the non-null columns of a row."""
    v = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.struct(F.size(v).alias("count"), F.aggregate(v, F.lit(0.0), lambda s, x: s + x).alias("sum"), F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x).alias("sumsq"), F.array_min(v).alias("min"), F.array_max(v).alias("max"))


def row_vector_mean(*vectors: Column) -> Column:
    """Mean of k vectors of a row, element by element; a null vector counts as zeros."""
    out = F.coalesce(vectors[0], F.array().cast("array<double>"))
    for v in vectors[1:]:
        out = F.zip_with(out, F.coalesce(v, F.array().cast("array<double>")), lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
    return F.transform(out, lambda x: x / len(vectors))


def row_vector_stats(size: int, *vectors: Column) -> Column:
    """For each of `size` elements, row_stats() over k vectors; a null vector gives zeros."""
    at = lambda v, i: F.coalesce(F.get(F.coalesce(v, F.array().cast("array<double>")), i), F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: stats(F.array(*(at(v, i) for v in vectors))))


def for_target(kind: str):
    """The aggregator of predictions for a target's type."""
    chosen = {"double": row_stats, "enumeration": row_vector_mean, "vector": row_vector_stats}
    if kind not in chosen:
        raise ValueError(f"no aggregator for a target of type {kind}")
    return chosen[kind]


# moments


def weighted_sum(x: Column, w: Column) -> Column:
    return _sum(F.when(x.isNotNull(), x * w))


def weighted_count(x: Column, w: Column) -> Column:
    return _sum(F.when(x.isNotNull(), w.cast(_D)))


def weighted_mean(x: Column, w: Column) -> Column:
    """0 if the weights sum to 0."""
    return F.coalesce(F.try_divide(weighted_sum(x, w), weighted_count(x, w)), F.lit(0.0))


def variance(x: Column, w: Column | None = None) -> Column:
    """Of the population, 0 if there are no rows."""
    if w is None:
        return F.coalesce(F.var_pop(x), F.lit(0.0))
    n = weighted_count(x, w)
    return F.coalesce(F.try_divide(_sum(F.when(x.isNotNull(), x * x * w)), n) - F.pow(F.try_divide(weighted_sum(x, w), n), F.lit(2.0)), F.lit(0.0))


def stddev(x: Column, w: Column | None = None) -> Column:
    v = variance(x, w)
    return F.when(v > EPSILON, F.sqrt(v)).otherwise(F.lit(0.0))


def statistics(x: Column) -> Column:
    return F.struct(F.count(x).alias("count"), _sum(x).alias("sum"), F.avg(x).alias("mean"), variance(x).alias("variance"), stddev(x).alias("stddev"), F.min(x).alias("min"), F.max(x).alias("max"), (F.max(x) - F.min(x)).alias("range"))


def constant_moments(mean: float = 0.0, variance: float = 1.0) -> Column:
    """Moments that are given, not measured."""
    return F.struct(F.lit(mean).alias("mean"), F.lit(variance).alias("variance"))


def recent_mean(x: Column, order: list[Column | str], memory: int, by: list[str] = []) -> Column:
    """Mean of the last `memory` rows; of none it is 0. Give `by` keys: without, all rows are one ordered run."""
    if memory <= 0:
        return F.lit(0.0)
    return F.coalesce(F.avg(x).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - memory, 0)), F.lit(0.0))


def recent_variance(x: Column, order: list[Column | str], memory: int, by: list[str] = []) -> Column:
    if memory <= 0:
        return F.lit(0.0)
    return F.coalesce(F.var_pop(x).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - memory, 0)), F.lit(0.0))


# two variables


def pair_sums(x: Column, y: Column) -> dict[str, Column]:
    """n, sums and sums of products over rows where both are known."""
    both = x.isNotNull() & y.isNotNull()
    on = lambda c: _sum(F.when(both, c))
    return {"n": F.count_if(both).cast(_D), "xy": on(x * y), "x": on(x), "xx": on(x * x), "y": on(y), "yy": on(y * y)}


def correlation(s: dict[str, Column]) -> Column:
    """Pearson's coefficient with n - 1 in place of n in both roots, as the inventory has it."""
    root = lambda a, b: F.sqrt(F.greatest((s["n"] - 1) * a - b * b, F.lit(0.0)))
    return F.try_divide(s["n"] * s["xy"] - s["x"] * s["y"], root(s["xx"], s["x"]) * root(s["yy"], s["y"]))


def textbook_correlation(x: Column, y: Column) -> Column:
    return F.corr(x, y)


def slope(s: dict[str, Column]) -> Column:
    return F.try_divide(s["n"] * s["xy"] - s["x"] * s["y"], s["n"] * s["xx"] - s["x"] * s["x"])


def intercept(s: dict[str, Column]) -> Column:
    return F.try_divide(s["y"] - slope(s) * s["x"], s["n"])


def _sst(s: dict[str, Column]) -> Column:
    return s["yy"] - F.try_divide(s["y"] * s["y"], s["n"])


def _sse(s: dict[str, Column]) -> Column:
    sxx = s["xx"] - F.try_divide(s["x"] * s["x"], s["n"])
    sxy = s["xy"] - F.try_divide(s["x"] * s["y"], s["n"])
    return F.greatest(_sst(s) - F.coalesce(F.try_divide(sxy * sxy, sxx), F.lit(0.0)), F.lit(0.0))


def r_squared(s: dict[str, Column]) -> Column:
    """0 where either variable is constant."""
    flat = (s["n"] * s["xx"] - s["x"] * s["x"] == 0) | (_sst(s) == 0)
    return F.when(flat, F.lit(0.0)).otherwise(F.coalesce(1 - F.try_divide(_sse(s), _sst(s)), F.lit(0.0)))


def residual_sd(s: dict[str, Column]) -> Column:
    """Root of the residual sum of squares over n - 1; null for fewer than two rows."""
    return F.when(s["n"] >= 2, F.sqrt(F.try_divide(_sse(s), s["n"] - 1)))


# many variables


class LeastSquares:
    """Sums of products of inputs (with a bias first) and target; mergeable, so they may come from any aggregation."""

    def __init__(self, xtx: np.ndarray, xty: np.ndarray, yy: float, n: float):
        self.xtx, self.xty, self.yy, self.n = xtx, xty, yy, n

    @staticmethod
    def columns(inputs: list[Column], target: Column, weight: Column | None = None) -> list[Column]:
        """The sums to aggregate, over rows without nulls."""
        known = target.isNotNull()
        for x in inputs:
            known = known & x.isNotNull()
        w = F.lit(1.0) if weight is None else weight
        x = [F.lit(1.0), *inputs]
        on = lambda c: _sum(F.when(known, c * w))
        d = len(x)
        return [*(on(x[i] * x[j]).alias(f"x{i}_{j}") for i in range(d) for j in range(i, d)), *(on(x[i] * target).alias(f"y{i}") for i in range(d)), on(target * target).alias("yy")]

    @staticmethod
    def of(row, inputs: int) -> LeastSquares:
        d = inputs + 1
        xtx = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                xtx[i, j] = xtx[j, i] = row[f"x{i}_{j}"]
        return LeastSquares(xtx, np.array([row[f"y{i}"] for i in range(d)]), row["yy"], xtx[0, 0])

    def __add__(self, other: LeastSquares) -> LeastSquares:
        return LeastSquares(self.xtx + other.xtx, self.xty + other.xty, self.yy + other.yy, self.n + other.n)

    def __sub__(self, other: LeastSquares) -> LeastSquares:
        return LeastSquares(self.xtx - other.xtx, self.xty - other.xty, self.yy - other.yy, self.n - other.n)

    def weights(self) -> np.ndarray:
        """The bias, then a weight for each input."""
        try:
            return np.linalg.solve(self.xtx, self.xty)
        except np.linalg.LinAlgError:
            return np.linalg.pinv(self.xtx) @ self.xty

    def residual_sd(self) -> float:
        """Of the full model, over n - 1; infinite for fewer rows than twice the weights."""
        if self.n < 2 * len(self.xty):
            return float("inf")
        w = self.weights()
        sse = self.yy - 2 * w @ self.xty + w @ self.xtx @ w
        return float(np.sqrt(max(0.0, sse) / (self.n - 1)))

    def r_squared_sum(self) -> float:
        """R squared of each input alone, summed: right for inputs that do not correlate."""
        n, y = self.n, self.xty[0]
        sst = self.yy - y * y / n if n else 0.0
        out = 0.0
        for i in range(1, len(self.xty)):
            sxx = self.xtx[i, i] - self.xtx[0, i] ** 2 / n if n else 0.0
            if sxx > 0 and sst > 0:
                out += (self.xty[i] - self.xtx[0, i] * y / n) ** 2 / sxx / sst
        return out


def least_squares(df: DataFrame, inputs: list[str], target: str) -> LeastSquares:
    """One aggregation; (d + 1)(d + 2) / 2 numbers come to the driver."""
    return LeastSquares.of(df.agg(*LeastSquares.columns([F.col(c) for c in inputs], F.col(target))).first(), len(inputs))


# confusion of two truth values


def confusion(predicted: Column, correct: Column, w: Column | None = None) -> dict[str, Column]:
    """tp, fp, tn, fn over rows where both are known; a weight may be negative."""
    w = F.lit(1) if w is None else w
    on = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0)).cast(_D)
    return {"tp": on(predicted & correct), "fp": on(predicted & ~correct), "tn": on(~predicted & ~correct), "fn": on(~predicted & correct)}


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def accuracy(c: dict[str, Column]) -> Column:
    return _share(c["tp"] + c["tn"], c["tp"] + c["tn"] + c["fp"] + c["fn"])


def precision(c: dict[str, Column]) -> Column:
    return _share(c["tp"], c["tp"] + c["fp"])


def recall(c: dict[str, Column]) -> Column:
    return _share(c["tp"], c["tp"] + c["fn"])


def specificity(c: dict[str, Column]) -> Column:
    return _share(c["tn"], c["tn"] + c["fp"])


def f1(c: dict[str, Column]) -> Column:
    """1 where there is nothing to find and nothing was found."""
    return F.coalesce(F.try_divide(c["tp"], c["tp"] + (c["fn"] + c["fp"]) / 2), F.lit(1.0))


def matthews(c: dict[str, Column]) -> Column:
    """Matthews correlation; its numerator where the denominator is 0."""
    top = c["tp"] * c["tn"] - c["fp"] * c["fn"]
    below = (c["tp"] + c["fp"]) * (c["tp"] + c["fn"]) * (c["tn"] + c["fp"]) * (c["tn"] + c["fn"])
    return F.coalesce(F.try_divide(top, F.sqrt(below)), top)


def sensitivity_and_specificity(c: dict[str, Column]) -> Column:
    """Their harmonic mean, 0 where they sum to less than 1e-5."""
    a, b = recall(c), specificity(c)
    return F.when(a + b < 1e-5, F.lit(0.0)).otherwise(2 * a * b / F.greatest(a + b, F.lit(1e-5)))


# distributions


def histogram(df: DataFrame, column: str, low: float, high: float, step: float) -> DataFrame:
    """bin, n: bin -1 is below low, bins number above high; high itself is in the last bin."""
    bins = int(np.ceil((high - low) / step))
    x = F.col(column)
    b = F.when(x < low, F.lit(-1)).when(x > high, F.lit(bins)).otherwise(F.least(F.floor((x - low) / step).cast("int"), F.lit(bins - 1)))
    return df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, label: str, w: Column | None = None) -> DataFrame:
    """label, weight and proportion of each label (a pie chart, or the vote of a leaf); labels are few, so their total is a window over them."""
    by = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.sum(F.lit(1.0) if w is None else w).alias("weight"))
    return by.withColumn("proportion", F.coalesce(F.try_divide(F.col("weight"), F.sum("weight").over(Window.partitionBy(F.lit(0)))), F.lit(0.0)))


def mean_vector(v: Column, size: int, w: Column | None = None) -> Column:
    """The weighted mean of vectors over rows."""
    w = F.lit(1.0) if w is None else w
    return F.array(*(F.try_divide(F.sum(F.get(v, F.lit(i)) * w), F.sum(F.when(v.isNotNull(), w))) for i in range(size)))


def average_curves(df: DataFrame, point: str, value: str) -> DataFrame:
    """The mean over runs at each point."""
    return df.groupBy(point).agg(F.avg(value).alias(value))
