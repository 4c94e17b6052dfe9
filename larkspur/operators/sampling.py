"""Samplers and random variates (inventory R1-R14).

Numbers are digests of a seed and a row's columns, so a sample is the same on every run,
partitioning and engine; they follow the named distributions, not any particular generator.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators.frame import ROW, draw, drawn_key


def uniform(seed: int, of: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return low + draw(seed, of) * (high - low)


def projected(x: Column, low: float, high: float) -> Column:
    """x held within a domain."""
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def categorical(seed: int, of: Column, weights: Sequence[float]) -> Column:
    """A position, with chances in proportion to the weights."""
    u, total, out = draw(seed, of) * float(sum(weights)), float(sum(weights)), F.lit(len(weights) - 1)
    for i in range(len(weights) - 2, -1, -1):
        total -= weights[i + 1]
        out = F.when(u < total, F.lit(i)).otherwise(out)
    return out


def gaussian(seed: int, of: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    """By the polar form of two uniform numbers."""
    r = F.sqrt(-2 * F.ln(F.greatest(draw(seed, of), F.lit(1e-300))))
    return mean + sd * r * F.cos(2 * math.pi * draw(seed + 1_000_003, of))


def laplace(seed: int, of: Column, mean: float = 0.0, scale: float = 1.0) -> Column:
    u = draw(seed, of) - 0.5
    return mean - scale * F.signum(u) * F.ln(F.greatest(1 - 2 * F.abs(u), F.lit(1e-300)))


def exponential(seed: int, of: Column, rate: float = 1.0) -> Column:
    return -F.ln(F.greatest(1 - draw(seed, of), F.lit(1e-300))) / rate


def gamma(seed: int, of: Column, shape: float, scale: float = 1.0, tries: int = 16) -> Column:
    """Marsaglia and Tsang's method: the first accepted of a fixed number of tries, which fail together once in 10**20."""
    boost = shape < 1
    d = (shape + 1 if boost else shape) - 1 / 3
    c = 1 / math.sqrt(9 * d)
    drawn = F.array(*(F.struct(gaussian(seed + 7919 * k, of).alias("x"), draw(seed + 7919 * k + 3, of).alias("u")) for k in range(tries)))

    def cube(e: Column) -> Column:
        return F.pow(1 + c * e["x"], F.lit(3.0))

    def accepted(e: Column) -> Column:
        v = cube(e)
        return (v > 0) & (F.ln(F.greatest(e["u"], F.lit(1e-300))) < 0.5 * e["x"] * e["x"] + d - d * v + d * F.ln(F.greatest(v, F.lit(1e-300))))

    first = F.get(F.filter(drawn, accepted), F.lit(0))
    out = F.coalesce(d * cube(first), F.lit(d))
    if boost:
        out = out * F.pow(draw(seed + 13, of), F.lit(1 / shape))
    return out * scale


def beta(seed: int, of: Column, a: float, b: float) -> Column:
    x, y = gamma(seed, of, a), gamma(seed + 524287, of, b)
    return x / (x + y)


def gaussian_pdf(x: Column, mean: float | Column = 0.0, sd: float | Column = 1.0) -> Column:
    z = (x - mean) / sd
    return F.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi))


def gaussian_cdf(x: Column, mean: float | Column = 0.0, sd: float | Column = 1.0) -> Column:
    """By the error function's rational approximation (Abramowitz and Stegun 7.1.26), right to 1.5e-7."""
    z = (x - mean) / (sd * math.sqrt(2.0)) if not isinstance(sd, Column) else (x - mean) / (sd * F.lit(math.sqrt(2.0)))
    t = 1 / (1 + 0.3275911 * F.abs(z))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return 0.5 * (1 + F.signum(z) * (1 - poly * F.exp(-z * z)))


def mixture(seed: int, of: Column, p: float, a: Column, b: Column) -> Column:
    """b with a chance of p, else a."""
    return F.when(draw(seed, of) < p, b).otherwise(a)


@dataclass
class DiagonalGaussian:
    """A normal distribution of independent coordinates over a box."""

    mean: np.ndarray
    sd: np.ndarray

    @staticmethod
    def over(low: Sequence[float], high: Sequence[float]) -> DiagonalGaussian:
        low, high = np.asarray(low, float), np.asarray(high, float)
        return DiagonalGaussian((low + high) / 2, (high - low) / 6)

    @staticmethod
    def of(df: DataFrame, columns: Sequence[str]) -> DiagonalGaussian:
        """Means and population deviations of the rows, in one aggregation."""
        r = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(columns))).first()
        return DiagonalGaussian(np.array([r[f"m{i}"] or 0.0 for i in range(len(columns))]), np.array([r[f"s{i}"] for i in range(len(columns))]))

    def reinforced(self, value: Sequence[float], rate: float) -> DiagonalGaussian:
        sd = self.sd * (1 - rate)
        return DiagonalGaussian(np.asarray(value, float), np.where(sd < 1e-6, 0.0, sd))

    @property
    def deterministic(self) -> bool:
        return bool((self.sd <= 1e-9).all())

    def columns(self, seed: int, names: Sequence[str], of: Column) -> list[Column]:
        return [gaussian(seed + 101 * i, of, float(m), float(s)).alias(n) for i, (n, m, s) in enumerate(zip(names, self.mean, self.sd))]


def normalised_by_l1(columns: Sequence[Column]) -> list[Column]:
    total = sum((F.abs(c) for c in columns[1:]), F.abs(columns[0]))
    return [F.when(total > 0, c / total).otherwise(c) for c in columns]


def latin_hypercube(spark: SparkSession, n: int, low: Sequence[float], high: Sequence[float], seed: int, edges: bool = False) -> DataFrame:
    """n points x0.. in a box: of n intervals of each coordinate each is used once. edges: the 2d edge points come first."""
    df = spark.range(n).withColumnRenamed("id", ROW)
    for i, (lo, hi) in enumerate(zip(low, high)):
        # a permutation of a design of n points, which is small; the key of one group
        place = F.row_number().over(Window.partitionBy(F.lit(i)).orderBy(drawn_key(seed + i, ROW), ROW)) - 1
        df = df.withColumn(f"x{i}", F.lit(lo) + (place + draw(seed + 31 * i + 1, F.col(ROW))) / n * (hi - lo))
    if edges:
        df = edge_points(spark, low, high).unionByName(df.withColumn(ROW, F.col(ROW) + 2 * len(low)))
    return df


def edge_points(spark: SparkSession, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """For each coordinate its least and greatest value, the others in the middle."""
    d = len(low)
    at = F.col("id")
    cols = [F.when(at == 2 * i, F.lit(float(lo))).when(at == 2 * i + 1, F.lit(float(hi))).otherwise(F.lit((lo + hi) / 2)).alias(f"x{i}") for i, (lo, hi) in enumerate(zip(low, high))]
    return spark.range(2 * d).select(at.alias(ROW), *cols)


def vector_of(seed: int, of: Column, size: int, sampler=uniform) -> Column:
    """An array of samples."""
    return F.array(*(sampler(seed + 17 * i, of) for i in range(size)))


def subset_of(seed: int, of: Column, v: Column, k: int) -> Column:
    """k elements of an array, in their order."""
    keyed = F.transform(v, lambda x, i: F.struct(drawn_key(seed, of, i).alias("h"), i.alias("i"), x.alias("x")))
    chosen = F.slice(F.array_sort(keyed), 1, k)
    return F.transform(F.array_sort(F.transform(chosen, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])


def random_action(seed: int, of: Column, actions: Column) -> Column:
    """One of an array of actions, each with the same chance; null if there is none."""
    n = F.array_size(actions)
    return F.when(n > 0, F.get(actions, F.floor(draw(seed, of) * n).cast("int")))


class LogLinear:
    """A policy over actions with features: softmax of weights, fitted by likelihood or reinforced by a gradient."""

    def __init__(self, features: int, learning_rate: float = 1.0, regulariser: float = 0.0):
        self.weights, self.rate, self.l2 = np.zeros(features), learning_rate, regulariser

    def chances(self, actions: np.ndarray) -> np.ndarray:
        z = actions @ self.weights
        e = np.exp(z - z.max())
        return e / e.sum()

    def sample(self, actions: np.ndarray, rng: np.random.Generator) -> int:
        return int(rng.choice(len(actions), p=self.chances(actions)))

    def log_likelihood(self, steps: Sequence[tuple[np.ndarray, int]]) -> tuple[float, np.ndarray]:
        """Of chosen actions, with its gradient."""
        total, grad = -self.l2 * float(self.weights @ self.weights), -2 * self.l2 * self.weights
        for actions, chosen in steps:
            p = self.chances(actions)
            total += float(np.log(p[chosen]))
            grad = grad + actions[chosen] - p @ actions
        return total, grad

    def reinforce(self, steps: Sequence[tuple[np.ndarray, int]]) -> LogLinear:
        self.weights = self.weights + self.rate * self.log_likelihood(steps)[1]
        return self

    def fit(self, steps: Sequence[tuple[np.ndarray, int]], rounds: int = 100) -> LogLinear:
        from larkspur.operators.search import lbfgs

        def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
            self.weights = w
            value, grad = self.log_likelihood(steps)
            return -value, -grad

        self.weights = lbfgs(loss, self.weights, rounds)[0]
        return self
