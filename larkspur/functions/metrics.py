"""Evaluation metrics as Columns (inventory M1-M9, M11).

A metric divides by the number of all rows, also those without a prediction. A null or
not-a-number prediction counts as 0 in the regression metrics.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.vectors import argmax


def _known(p: Column) -> Column:
    return F.coalesce(F.nanvl(p, F.lit(0.0)), F.lit(0.0))


def mse(target: Column, prediction: Column) -> Column:
    e = target - _known(prediction)
    return F.try_divide(F.sum(e * e), F.count(F.lit(1)).cast("double"))


def rmse(target: Column, prediction: Column) -> Column:
    return F.sqrt(mse(target, prediction))


def normalised_rmse(target: Column, prediction: Column) -> Column:
    return 1 / (1 + rmse(target, prediction))


def rrse(target: Column, prediction: Column, train_mean: Column) -> Column:
    """Root relative squared error against the mean of the training target."""
    e, d = target - _known(prediction), target - train_mean
    return F.sqrt(F.try_divide(F.sum(e * e), F.sum(d * d)))


def multi_mse(targets: Column, predictions: Column) -> Column:
    """Mean of squared errors over rows and outputs."""
    e = F.aggregate(F.zip_with(targets, predictions, lambda y, p: F.pow(y - F.coalesce(p, F.lit(0.0)), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(F.sum(e), F.sum(F.size(targets)).cast("double"))


def binary_accuracy(target: Column, prediction: Column) -> Column:
    """Two nulls agree."""
    return F.try_divide(F.count_if(target.eqNullSafe(prediction)).cast("double"), F.count(F.lit(1)).cast("double"))


def class_accuracy(target: Column, prediction: Column, probabilities: bool = False) -> Column:
    """Of labels, or of the most probable class of a vector."""
    label = argmax(prediction) if probabilities else prediction
    return F.try_divide(F.count_if(F.coalesce(target == label, F.lit(False))).cast("double"), F.count(F.lit(1)).cast("double"))


@dataclass(frozen=True)
class Range:
    """The worst and best value of a metric."""

    worst: float
    best: float

    @property
    def minimised(self) -> bool:
        return self.best < self.worst

    def scaled(self, value: float) -> float:
        """0 for the worst and 1 for the best."""
        return (value - self.worst) / (self.best - self.worst)


def square_loss(target: Column, prediction: Column) -> Column:
    return F.pow(prediction - target, F.lit(2.0))


def hinge_loss(correct: Column, score: Column, margin: float = 1.0) -> Column:
    sign = F.when(correct, 1.0).otherwise(-1.0)
    return F.greatest(margin - sign * score, F.lit(0.0))


def exponential_loss(correct: Column, score: Column) -> Column:
    return F.exp(-F.when(correct, 1.0).otherwise(-1.0) * score)


def log_binomial_loss(correct: Column, score: Column) -> Column:
    return F.log1p(exponential_loss(correct, score))


def one_against_all(target: Column, scores: Column, loss=hinge_loss) -> Column:
    """Sum over the classes of a loss of each class's score."""
    return F.aggregate(F.transform(scores, lambda s, k: loss(k == target, s)), F.lit(0.0), lambda a, b: a + b)


def most_violated(target: Column, scores: Column, margin: float = 1.0) -> Column:
    """Hinge of the target's score over the best of the others."""
    others = F.array_max(F.filter(scores, lambda s, k: k != target))
    return F.greatest(margin - (F.get(scores, target) - others), F.lit(0.0))


def ranking_loss(costs: Column, scores: Column, margin: float = 1.0) -> Column:
    """Mean hinge over pairs of alternatives in which the first costs less."""
    z = F.arrays_zip(costs.alias("c"), scores.alias("s"))
    pair = lambda a: F.transform(F.filter(z, lambda b: a["c"] < b["c"]), lambda b: F.greatest(margin - (a["s"] - b["s"]), F.lit(0.0)))
    losses = F.flatten(F.transform(z, pair))
    return F.coalesce(F.try_divide(F.aggregate(losses, F.lit(0.0), lambda a, b: a + b), F.size(losses).cast("double")), F.lit(0.0))
