"""Bandits over tables of plays, and iteration schedules (inventory B1-B8).

An arm's statistics are one aggregation; an index policy is a Column over them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEVER = float("inf")


def arms(plays: DataFrame, arm: str, reward: str) -> DataFrame:
    """arm, n, mean, sum, variance, min, max of its rewards."""
    r = F.col(reward).cast("double")
    return plays.groupBy(arm).agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.sum(r).alias("sum"), F.coalesce(F.var_pop(r), F.lit(0.0)).alias("variance"), F.min(r).alias("min"), F.max(r).alias("max"))


def with_total(stats: DataFrame) -> DataFrame:
    """Column t: plays of all arms. Arms are few, so one row is sent to all."""
    return stats.join(F.broadcast(stats.agg(F.sum("n").cast("double").alias("t"))))


_n, _t, _mean, _var = F.col, "t", "mean", "variance"


def _unplayed(index: Column) -> Column:
    return F.when(F.col("n") > 0, index).otherwise(F.lit(NEVER))


def pool_index(c: float = 2.0, use_max: bool = False) -> Column:
    """The pool's index: the mean (or greatest) reward plus c over the plays; an arm without plays comes first."""
    return _unplayed(F.col("max" if use_max else "mean") + c / F.col("n"))


def greedy() -> Column:
    return _unplayed(F.col("mean"))


def ucb1(c: float = 2.0) -> Column:
    return _unplayed(F.col("mean") + c * F.sqrt(F.ln("t") / F.col("n")))


def ucb1_tuned(c: float = 1.0) -> Column:
    v = F.col("variance") + F.sqrt(2 * F.ln("t") / F.col("n"))
    return _unplayed(F.col("mean") + c * F.sqrt(F.ln("t") / F.col("n") * F.least(F.lit(0.25), v)))


def ucb1_normal() -> Column:
    """For rewards that are normal; arms of at most one play come first."""
    q = F.col("variance") * F.col("n")
    return F.when(F.col("n") > 1, F.col("mean") + F.sqrt(16 * F.greatest(q, F.lit(0.0)) / (F.col("n") - 1) * F.ln(F.greatest(F.col("t") - 1, F.lit(1.0))) / F.col("n"))).otherwise(F.lit(NEVER))


def ucb2(alpha: float = 0.001, epoch: Column | None = None) -> Column:
    """With epochs of growing length; an arm's epoch is the logarithm of its plays if none is given."""
    r = F.floor(F.ln(F.greatest(F.col("n"), F.lit(1)).cast("double")) / math.log(1 + alpha)) if epoch is None else epoch
    tau = F.ceil(F.pow(F.lit(1 + alpha), r.cast("double"))).cast("double")
    return _unplayed(F.col("mean") + F.sqrt((1 + alpha) * F.greatest(F.ln(math.e * F.col("t") / tau), F.lit(0.0)) / (2 * tau)))


def ucb_v(zeta: float = 1.0, c: float = 1.0) -> Column:
    e = zeta * F.ln("t")
    return _unplayed(F.col("mean") + F.sqrt(2 * F.col("variance") * e / F.col("n")) + 3 * c * e / F.col("n"))


def over_exploit() -> Column:
    return _unplayed(F.col("mean") + 1 / F.col("n"))


def power_index(alpha: float = 1.0, beta: float = 0.5, gamma: float = 0.5) -> Column:
    """mean + alpha * t^beta / n^gamma."""
    return _unplayed(F.col("mean") + alpha * F.pow("t", F.lit(beta)) / F.pow(F.col("n").cast("double"), F.lit(gamma)))


def kl_ucb(c: float = 0.0, steps: int = 24) -> Column:
    """The greatest q whose Bernoulli divergence from the mean is at most (ln t + c ln ln t) / n, by bisection in a fold."""
    p = F.least(F.greatest(F.col("mean"), F.lit(1e-9)), F.lit(1 - 1e-9))
    bound = (F.ln("t") + c * F.ln(F.greatest(F.ln(F.greatest(F.col("t"), F.lit(1.0001))), F.lit(1e-9)))) / F.col("n")

    def halve(s: Column, _: Column) -> Column:
        q = (s["lo"] + s["hi"]) / 2
        inside = p * F.ln(p / q) + (1 - p) * F.ln((1 - p) / (1 - q)) <= bound
        return F.struct(F.when(inside, q).otherwise(s["lo"]).alias("lo"), F.when(inside, s["hi"]).otherwise(q).alias("hi"))

    last = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(p.alias("lo"), F.lit(1 - 1e-12).alias("hi")), halve)
    return _unplayed((last["lo"] + last["hi"]) / 2)


def epsilon_greedy(u: Column, v: Column, c: float = 1.0, d: float = 1.0) -> Column:
    """The mean, or with a chance of c * arms / (d^2 * t) a random number v; u is one number for all arms."""
    chance = F.least(F.lit(1.0), c / (d * d * F.col("t")))
    return _unplayed(F.when(u < chance, v).otherwise(F.col("mean")))


def thompson(z: Column) -> Column:
    """The mean moved by a normal number z of the standard error of a Beta posterior of rewards in 0..1."""
    a, b = F.col("mean") * F.col("n") + 1, (1 - F.col("mean")) * F.col("n") + 1
    m = a / (a + b)
    return m + z * F.sqrt(m * (1 - m) / (a + b + 1))


def choose(stats: DataFrame, index: Column, arm: str) -> DataFrame:
    """The arm of best index; of several, the least by name."""
    return stats.select(F.col(arm), index.alias("index")).orderBy(F.col("index").desc(), F.col(arm)).limit(1)


def constant(value: float) -> float:
    return value


def hyperbolic(value: float, half: float, iteration: int | Column):
    """value * half / (half + iteration)."""
    return value * half / (half + iteration)


class BitKey:
    """Whole numbers packed into a key of bits."""

    def __init__(self):
        self.bits, self.value = 0, 0

    def push(self, x: int, width: int) -> BitKey:
        if not 0 <= x < 1 << width:
            raise ValueError(f"{x} in {width} bits")
        self.value |= x << self.bits
        self.bits += width
        return self

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.bits // 8), "little")


def pack(*parts: tuple[Column, int]) -> Column:
    """Columns of whole numbers and their widths as one long."""
    out, at = F.lit(0).cast("long"), 0
    for x, width in parts:
        out = out.bitwiseOR(F.shiftleft(x.cast("long").bitwiseAND(F.lit((1 << width) - 1)), at))
        at += width
    return out
