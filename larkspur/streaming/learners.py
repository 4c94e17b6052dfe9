"""Incremental learners of a target from a stream of rows (inventory I1-I19).

A learner takes one row at a time in the order of `seq`; that order is its meaning, so
a stream is learned per key, each key's rows in order. replay() runs it over a table and
stream() over a stream, whose state is the learner itself. learn() of a learner takes a
block of rows and gives what predict() and push() in turns would. Learners whose state is
a sum (simple regressions, least squares) are plain aggregates besides.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from operator import mul

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.stats import LeastSquares, pair_sums, slope
from larkspur.plans.expr import Constant, Expr, Linear, NormalisedLinear, StreamLeaf, StreamTree


def _counted(y: np.ndarray, n: np.ndarray | None, q: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """How many rows each entry of y is the sum of, and their sum of squares; of single rows where that is not given."""
    return (np.ones(len(y)), y * y) if n is None else (n, q)


class Moments:
    """Count, means and deviations of vectors, in one pass."""

    def __init__(self, d: int):
        self.n, self.s, self.q = 0, np.zeros(d), np.zeros(d)

    def push(self, x: np.ndarray) -> None:
        self.n += 1
        self.s += x
        self.q += x * x

    def push_all(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means and deviations before the first row and after each."""
        n = np.maximum(1, np.arange(self.n, self.n + len(x) + 1))[:, None]
        s, q = np.cumsum(np.vstack([self.s, x]), axis=0), np.cumsum(np.vstack([self.q, x * x]), axis=0)
        self.n, self.s, self.q = self.n + len(x), s[-1].copy(), q[-1].copy()
        return s / n, self._sd(s / n, q / n)

    @property
    def mean(self) -> np.ndarray:
        return self.s / max(1, self.n)

    @property
    def sd(self) -> np.ndarray:
        return self._sd(self.mean, self.q / max(1, self.n))

    @staticmethod
    def _sd(mean: np.ndarray, square: np.ndarray) -> np.ndarray:
        v = square - mean**2
        return np.where(v > np.finfo(float).eps, np.sqrt(np.maximum(v, 0)), 0.0)


class Perceptron:
    """Online least mean squares over normalised inputs; the rate falls as lr / (1 + n * decay)."""

    def __init__(self, d: int, initial: int = 20, rate: float = 0.1, decay: float = 0.005, seed: int = 0):
        self.d, self.initial, self.rate, self.decay = d, initial, rate, decay
        self.w = np.random.default_rng(seed).uniform(-1, 1, d + 1)
        self.moments = Moments(d)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        sd = self.moments.sd
        return np.concatenate([[1.0], np.divide(x - self.moments.mean, 3 * sd, out=np.zeros(self.d), where=sd > 0)])

    def predict(self, x: np.ndarray) -> float:
        return float(self.w @ self._scaled(x))

    def push(self, x: np.ndarray, y: float) -> None:
        self.moments.push(x)
        if self.moments.n >= self.initial:
            z = self._scaled(x)
            self.w = self.w + self.rate / (1 + self.moments.n * self.decay) * (y - self.w @ z) * z

    def learn(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Predicts and then learns each row; the inputs are scaled for the whole block, the weights go row by row."""
        first = self.moments.n + 1
        mean, sd = self.moments.push_all(x)
        before, after = (np.column_stack([np.ones(len(y)), np.divide(x - m, 3 * v, out=np.zeros(x.shape), where=v > 0)]).tolist() for m, v in ((mean[:-1], sd[:-1]), (mean[1:], sd[1:])))
        rates = (self.rate / (1 + np.arange(first, first + len(y)) * self.decay)).tolist()
        w, out, still = self.w.tolist(), [], self.initial - first  # rows that only move the moments
        for i, (p, z, target, rate) in enumerate(zip(before, after, y.tolist(), rates)):
            out.append(sum(map(mul, w, p)))
            if i >= still:
                step = rate * (target - sum(map(mul, w, z)))
                w = [a + step * b for a, b in zip(w, z)]
        self.w = np.array(w)
        return np.array(out)

    def clone(self) -> Perceptron:
        return pickle.loads(pickle.dumps(self))

    def expression(self, names: Sequence[str]) -> Expr:
        return NormalisedLinear(tuple(names), tuple(self.w), tuple(self.moments.mean), tuple(self.moments.sd))


class OnlineLeastSquares:
    """Exact least squares, refitted when asked; the mean until there are rows enough."""

    def __init__(self, d: int):
        self.d = d
        self.sums = LeastSquares(np.zeros((d + 1, d + 1)), np.zeros(d + 1), 0.0, 0.0)
        self.only: np.ndarray | None = None  # the inputs of the first row
        self.same = np.ones(d, bool)  # which inputs all rows have equal
        self._weights: np.ndarray | None = None

    def _alone(self, x: np.ndarray) -> bool:
        """Whether all inputs with these rows more are equal."""
        if not self.sums.n and len(x):
            self.only = np.array(x[0], float)
        if len(x) and self.same.any():
            self.same &= (x == self.only).all(axis=0)
        return self.only is not None and bool(self.same.all())

    def push(self, x: np.ndarray, y: float) -> None:
        self._alone(np.asarray(x)[None])
        z = np.concatenate([[1.0], x])
        s = self.sums
        s.xtx += np.outer(z, z)
        s.xty += y * z
        s.yy += y * y
        s.n += 1
        self._weights = None

    def push_all(self, x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, q: np.ndarray | None = None) -> None:
        n, q = _counted(y, n, q)
        self._alone(x)
        z = np.column_stack([np.ones(len(y)), x])
        s = self.sums
        s.xtx += z.T @ (z * n[:, None])
        s.xty += z.T @ y
        s.yy += float(q.sum())
        s.n += float(n.sum())
        self._weights = None

    @property
    def weights(self) -> np.ndarray:
        if self._weights is None:
            self._weights = self._fit(self.sums.n, self.sums.xtx, self.sums.xty)
        return self._weights

    def _fit(self, n: float, xtx: np.ndarray, xty: np.ndarray) -> np.ndarray:
        if n >= self.d + 1:
            return np.linalg.lstsq(xtx, xty, rcond=None)[0]
        return np.concatenate([[xty[0] / max(1.0, n)], np.zeros(self.d)])

    def learn(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Predicts and then learns each row. Where no fit of a stretch is near singular, all are solved at once: the least eigenvalue only grows with rows. Of equal inputs all fits give the mean; an input that is equal in all rows adds nothing to a fit."""
        if self._alone(x):
            s = self.sums
            out = np.cumsum(np.append(s.xty[0], y))[:-1] / np.maximum(1, s.n + np.arange(len(y)))
            self.push_all(x, y)
            return out
        out, most = np.empty(len(y)), max(1, min(512, (1 << 20) // (self.d + 1) ** 2))
        s, use = self.sums, np.append(0, 1 + np.flatnonzero(~self.same))
        for i in range(0, len(y), most):
            z, ys = np.column_stack([np.ones(len(y[i : i + most])), x[i : i + most]]), y[i : i + most]
            xtx = np.cumsum(np.concatenate([s.xtx[None], z[:, :, None] * z[:, None, :]]), axis=0)
            xty = np.cumsum(np.concatenate([s.xty[None], ys[:, None] * z]), axis=0)
            few = xtx if len(use) > self.d else xtx[:, use[:, None], use]
            if s.n > self.d and np.isfinite(xtx[-1]).all() and np.linalg.eigvalsh(few[0])[0] > 1e-10 * np.linalg.eigvalsh(few[-1])[-1]:
                weights = np.zeros((len(ys), self.d + 1))
                weights[:, use] = np.linalg.solve(few[:-1], xty[:-1, use, None])[:, :, 0]
            else:
                weights = np.array([self._fit(s.n + k, xtx[k], xty[k]) for k in range(len(ys))])
            out[i : i + most] = (weights * z).sum(axis=1)
            s.xtx, s.xty, s.yy, s.n = xtx[-1].copy(), xty[-1].copy(), s.yy + float(ys @ ys), s.n + len(ys)
        self._weights = None
        return out

    def predict(self, x: np.ndarray) -> float:
        return float(self.weights[0] + self.weights[1:] @ x)

    def clone(self) -> OnlineLeastSquares:
        return pickle.loads(pickle.dumps(self))

    def expression(self, names: Sequence[str]) -> Expr:
        return Linear(tuple(names), tuple(self.weights))


class SimpleRegressions:
    """A slope for each input alone; the bias makes the prediction at the means right."""

    def __init__(self, d: int):
        self.d, self.n = d, 0
        self.x, self.xx, self.xy, self.y = np.zeros(d), np.zeros(d), np.zeros(d), 0.0

    def push(self, x: np.ndarray, y: float) -> None:
        self.n += 1
        self.x += x
        self.xx += x * x
        self.xy += x * y
        self.y += y

    def push_all(self, x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, q: np.ndarray | None = None) -> None:
        n, _ = _counted(y, n, q)
        self.n += int(n.sum())
        self.x += n @ x
        self.xx += n @ (x * x)
        self.xy += x.T @ y
        self.y += float(y.sum())

    @property
    def weights(self) -> np.ndarray:
        below = self.n * self.xx - self.x**2
        s = np.divide(self.n * self.xy - self.x * self.y, below, out=np.zeros(self.d), where=below > 0)
        return np.concatenate([[(self.y - s @ self.x) / max(1, self.n)], s])

    def predict(self, x: np.ndarray) -> float:
        w = self.weights
        return float(w[0] + w[1:] @ x)

    def clone(self) -> SimpleRegressions:
        return pickle.loads(pickle.dumps(self))

    def expression(self, names: Sequence[str]) -> Expr:
        return Linear(tuple(names), tuple(self.weights))


def hoeffding_bound(n: int, delta: float, width: float = 1.0) -> float:
    return 1.0 if not n or not delta else math.sqrt(width * width * math.log(1 / delta) / (2 * n))


# split quality over sorted rows: prefix sums give both sides of every split at once.
# A row may stand for n equal rows of inputs; then y is the sum of their targets, and q that of the squares


def _residual_sd(n, x, xx, xy, y, yy) -> np.ndarray:
    """Deviation of y about its line on x, from sums; over n - 1."""
    with np.errstate(divide="ignore", invalid="ignore"):
        sxx, sxy, syy = xx - x * x / n, xy - x * y / n, yy - y * y / n
        sse = np.where(sxx > 1e-12, syy - np.where(sxx > 1e-12, sxy * sxy / sxx, 0), syy)
        return np.where(n >= 2, np.sqrt(np.maximum(sse, 0) / np.maximum(n - 1, 1)), np.inf)


def _sd(n, y, yy) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.sqrt(np.maximum(yy / n - (y / n) ** 2, 0))


def _both(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up = np.cumsum(values, axis=0)
    return up, up[-1] - up


class StandardDeviationReduction:
    """sd(all) less the sides' sds by their shares."""

    def qualities(self, x: np.ndarray, y: np.ndarray, j: int, n: np.ndarray | None = None, q: np.ndarray | None = None) -> np.ndarray:
        n, q = _counted(y, n, q)
        n1, n2 = _both(n)
        y1, y2 = _both(y)
        q1, q2 = _both(q)
        return _sd(n1[-1], y.sum(), q.sum()) - (n1 * _sd(n1, y1, q1) + n2 * np.nan_to_num(_sd(n2, y2, q2))) / n1[-1]


def _line_sums(v: np.ndarray, y: np.ndarray, n: np.ndarray, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Both sides' sums for lines of y on v."""
    return [_both(s) for s in (n, n * v, n * v * v, v * y, y, q)]


class Mauve:
    """As the above, of the residuals about lines on one input: the one that is split."""

    def on(self, x: np.ndarray, y: np.ndarray, k: int, n: np.ndarray | None = None, q: np.ndarray | None = None) -> np.ndarray:
        sides = _line_sums(x[:, k], y, *_counted(y, n, q))
        left, right = (_residual_sd(*(s[i] for s in sides)) for i in (0, 1))
        n1, n2 = sides[0]
        whole = _residual_sd(*(s[0][-1] for s in sides))
        with np.errstate(invalid="ignore"):
            found = whole - (n1 * left + n2 * right) / n1[-1]
        return np.where(np.isfinite(found), found, -np.inf)

    def qualities(self, x: np.ndarray, y: np.ndarray, j: int, n: np.ndarray | None = None, q: np.ndarray | None = None) -> np.ndarray:
        return self.on(x, y, j, n, q)


class ExtendedMauve(Mauve):
    """The best over lines on any one input."""

    def qualities(self, x: np.ndarray, y: np.ndarray, j: int, n: np.ndarray | None = None, q: np.ndarray | None = None) -> np.ndarray:
        return np.max([self.on(x, y, k, n, q) for k in range(x.shape[1])], axis=0)


def _merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Counts, means and sums of products about the means of two sets of rows together."""
    (n1, m1, s1), (n2, m2, s2) = a, b
    n, off = n1 + n2, m2 - m1
    share = n2 / n
    return n, m1 + share[:, None] * off, s1 + s2 + (n1 * share)[:, None, None] * off[:, :, None] * off[:, None, :]


class TotalMauve:
    """Of the residuals about least squares on all inputs, of every split; 0 where a side has fewer rows than weights (I15), else none where it has fewer than two an input.

    Sums of both sides are about their own means, so nothing cancels; `block` cells of rows are added up at once. A fit whose
    equations are near singular is made of the side's rows.
    """

    def __init__(self, block: int = 4096):
        self.block = block

    def qualities(self, x: np.ndarray, y: np.ndarray, j: int, n: np.ndarray | None = None, q: np.ndarray | None = None) -> np.ndarray:
        n, q = _counted(y, n, q)
        d, out = x.shape[1], np.full(len(y), -np.inf)
        ends = np.flatnonzero(x[:-1, j] < x[1:, j])
        if not len(ends):
            return out
        rows, mean = n.sum(), y / n
        with np.errstate(all="ignore"):
            z = np.column_stack([self._apart(x, n), mean - n @ mean / rows])
            within = np.maximum(q - y * mean, 0)
            left = self._deviations(z, n, within, np.append(ends, len(y) - 1), 2 * d)
            right = self._deviations(z[::-1], n[::-1], within[::-1], len(y) - 2 - ends[::-1], 2 * d)[::-1]
            n1 = np.cumsum(n)[ends]
            found = left[-1] - (n1 * left[:-1] + (rows - n1) * right) / rows
        found[~np.isfinite(found)] = -np.inf
        found[np.minimum(n1, rows - n1) < d + 1] = 0.0
        out[ends] = found
        return out

    @staticmethod
    def _apart(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Inputs about their means, at most 1, that have the same fits: without those that others give, and for those that others nearly give what they have apart."""
        root, out, rounding = np.sqrt(n), np.empty((len(n), 0)), np.finfo(float).eps * max(len(n), 16)
        for v in (x - n @ x / n.sum()).T:
            size = np.abs(v).max()
            v = v / (size or 1.0)
            base = np.column_stack([root, out * root[:, None]])
            apart = v
            if np.isfinite(base).all() and np.isfinite(v).all():
                for _ in range(2):
                    apart = apart - base @ np.linalg.lstsq(base, apart * root, rcond=None)[0] / root
            most = np.abs(apart).max()
            if not most <= rounding:
                out = np.column_stack([out, apart / most if most < 1e-3 else v])
        return out

    def _deviations(self, z: np.ndarray, n: np.ndarray, within: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
        """Deviation of the last column about its fit on the others, over the rows up to each of ends; over n - 1, and none of fewer than `least`."""
        d, out, before = z.shape[1] - 1, np.empty(len(ends)), None
        most = max(1, min(self.block, (1 << 20) // (d + 1) ** 2))
        for at in range(0, int(ends[-1]) + 1, most):
            part = slice(at, min(at + most, int(ends[-1]) + 1))
            first, last = np.searchsorted(ends, (part.start, part.stop))
            stops = ends[first:last] + 1 - at
            starts = np.append(0, stops) if not len(stops) or stops[-1] < part.stop - at else np.append(0, stops[:-1])
            sums = self._up_to(z[part], n[part], within[part], starts)
            if before is not None:
                sums = _merged(before, sums)
            before = tuple(s[-1:] for s in sums)
            if first < last:
                rows, means, products = (s[: last - first] for s in sums)
                error, sure = self._errors(rows, means, products, np.finfo(float).eps * len(n))
                out[first:last] = np.where(rows >= least, np.sqrt(error / np.maximum(rows - 1, 1)), np.inf)
                for i in np.flatnonzero(~sure & (rows >= least)):
                    side = slice(int(ends[first + i]) + 1)
                    out[first + i] = self._sd(np.column_stack([np.ones(side.stop), z[side, :d]]), z[side, d], n[side], within[side])
        return out

    @staticmethod
    def _up_to(z: np.ndarray, n: np.ndarray, within: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Counts, means and sums of products of the rows up to the end of each stretch between starts."""
        rows = np.add.reduceat(n, starts)
        means = np.add.reduceat(n[:, None] * z, starts) / rows[:, None]
        off = z - np.repeat(means, np.diff(np.append(starts, len(n))), axis=0)
        products = np.add.reduceat((n[:, None] * off)[:, :, None] * off[:, None, :], starts)
        products[:, -1, -1] += np.add.reduceat(within, starts)
        sums, step = (rows, means, products), 1
        while step < len(rows):
            sums = tuple(np.concatenate([s[:step], m]) for s, m in zip(sums, _merged(tuple(s[:-step] for s in sums), tuple(s[step:] for s in sums))))
            step *= 2
        return sums

    @staticmethod
    def _errors(rows: np.ndarray, means: np.ndarray, products: np.ndarray, rounding: float) -> tuple[np.ndarray, np.ndarray]:
        """Squared errors of the fits, 0 where they are rounding, and which are sure: by elimination, past inputs that are constant."""
        left, d, sure = products, products.shape[1] - 1, np.ones(len(rows), bool)
        for k in range(d):
            own, pivot = products[:, k, k], left[:, 0, 0]
            none = own <= rows * (rounding * means[:, k]) ** 2
            sure &= none | (pivot > 1e-8 * own)
            share = left[:, 1:, 0] * np.where(none | (pivot <= 0), 0.0, 1 / np.where(none, 1.0, pivot))[:, None]
            left = left[:, 1:, 1:] - share[:, :, None] * left[:, None, 0, 1:]
        error, all_ = left[:, 0, 0], products[:, d, d]
        return np.where(error <= 1e-14 * all_, 0.0, error), sure | ~np.isfinite(error)

    @staticmethod
    def _sd(z: np.ndarray, mean: np.ndarray, n: np.ndarray, within: np.ndarray) -> float:
        root = np.sqrt(n)
        w = np.linalg.lstsq(z * root[:, None], mean * root, rcond=None)[0]
        return float(np.sqrt(((n * (mean - z @ w) ** 2).sum() + within.sum()) / max(1, n.sum() - 1)))


class QuandtAndrews:
    """The greatest F statistic of a break in the line of y on the split input, where it passes a critical value."""

    def __init__(self, critical: float = 4.0, parameters: int = 2):
        self.critical, self.parameters = critical, parameters

    def qualities(self, x: np.ndarray, y: np.ndarray, j: int, n: np.ndarray | None = None, q: np.ndarray | None = None) -> np.ndarray:
        sides, k = _line_sums(x[:, j], y, *_counted(y, n, q)), self.parameters
        rows = sides[0][0][-1]
        left, right = ((np.maximum(s[0] - 1, 0) * np.nan_to_num(_residual_sd(*s), posinf=0) ** 2) for s in ([p[i] for p in sides] for i in (0, 1)))
        whole = (rows - 1) * float(_residual_sd(*(p[0][-1] for p in sides))) ** 2 if rows > 1 else 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            f = (whole - left - right) * (rows - 2 * k) / ((left + right) * k)
        return np.where(np.isfinite(f) & (f > self.critical), f, -np.inf)


class Never:
    """No split is of any worth."""

    def qualities(self, x: np.ndarray, y: np.ndarray, j: int, n: np.ndarray | None = None, q: np.ndarray | None = None) -> np.ndarray:
        return np.full(len(y), -np.inf)


class Rows:
    """Rows of inputs and targets in arrays that double as they fill; with a bound, the latest rows."""

    def __init__(self, d: int, x: np.ndarray | None = None, y: np.ndarray | None = None, most: int | None = None):
        self.most, self.n, self.first = most, 0 if y is None else len(y), 0
        self._x, self._y = np.empty((max(16, self.n), d)), np.empty(max(16, self.n))
        if y is not None:
            self._x[: self.n], self._y[: self.n] = x, y

    def push(self, x: np.ndarray, y: float) -> None:
        if self.n == len(self._y):
            keep = slice(self.first, self.n)
            size = max(16, 2 * (self.n - self.first))
            old_x, old_y = self._x[keep], self._y[keep]
            self._x, self._y = np.empty((size, old_x.shape[1])), np.empty(size)
            self.n, self.first = len(old_y), 0
            self._x[: self.n], self._y[: self.n] = old_x, old_y
        self._x[self.n], self._y[self.n] = x, y
        self.n += 1
        if self.most is not None and self.n - self.first > self.most:
            self.first += 1

    @property
    def x(self) -> np.ndarray:
        return self._x[self.first : self.n]

    @property
    def y(self) -> np.ndarray:
        return self._y[self.first : self.n]

    def __len__(self) -> int:
        return self.n - self.first

    def sums(self) -> tuple[np.ndarray, ...]:
        return self.x, self.y, *_counted(self.y, None, None)

    def where(self, side: np.ndarray) -> Rows:
        return Rows(self._x.shape[1], self.x[side], self.y[side], self.most)


class Cells:
    """Rows of inputs and targets, equal rows of inputs as one: their number and the sums of their targets and of the squares. New rows wait unsorted, no more than there are cells or 1,024."""

    def __init__(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, q: np.ndarray):
        self.cells, self.new, self.waiting, self.rows = (x, y, n, q), [], 0, int(n.sum())

    @classmethod
    def empty(cls, d: int) -> Cells:
        return cls(np.empty((0, d)), *(np.empty(0) for _ in range(3)))

    def push(self, x: np.ndarray, y: float) -> None:
        self.push_all(np.array(x, float)[None], np.array([y], float))

    def push_all(self, x: np.ndarray, y: np.ndarray) -> None:
        self.new.append((x, y))
        self.waiting += len(y)
        self.rows += len(y)
        if self.waiting > max(1024, len(self.cells[1])):
            self.sums()

    def sums(self) -> tuple[np.ndarray, ...]:
        """x, y, n, q: distinct inputs in lexicographic order with the sums of their targets, how many they are, and the sums of squares."""
        if self.new:
            parts = [self.cells, *((x, y, *_counted(y, None, None)) for x, y in self.new)]
            x, *rest = (np.concatenate(p) for p in zip(*parts))
            order = np.lexsort(x.T[::-1])
            x = x[order]
            starts = np.flatnonzero(np.append(True, (x[1:] != x[:-1]).any(axis=1)))
            self.cells = (x[starts], *(np.add.reduceat(r[order], starts) for r in rest))
            self.new, self.waiting = [], 0
        return self.cells

    def where(self, side: np.ndarray) -> Cells:
        return Cells(*(p[side] for p in self.sums()))

    def __len__(self) -> int:
        return self.rows


@dataclass
class _Leaf:
    model: object
    rows: Rows | Cells
    seen: int = 0
    best: tuple = ()
    ratio: float = 0.0
    ratios: int = 0


@dataclass
class _Split:
    input: int
    threshold: float
    left: object
    right: object


def _side_model(model, rows: Rows | Cells):
    """A leaf's model for one side of its split, whose rows these are: of their sums if it is made of sums, else a copy that learns on."""
    if not isinstance(model, (OnlineLeastSquares, SimpleRegressions)):
        return model.clone()
    new = type(model)(model.d)
    new.push_all(*rows.sums())
    return new


def _descend(node, x: np.ndarray) -> tuple[_Leaf, _Split | None, bool]:
    """The leaf of a row, the split above it, and on which side."""
    parent, right = None, False
    while isinstance(node, _Split):
        parent, right = node, x[node.input] > node.threshold
        node = node.right if right else node.left
    return node, parent, right


class HoeffdingTree:
    """A regression tree that splits a leaf once a bound makes its best split certain.

    A leaf keeps its rows, equal ones as one, or with `memory` the latest so many. Each `chunk` rows it finds the best
    split of each input; when the mean ratio of the second best quality to the best is below 1 - bound, or the bound
    below `tie`, it splits, and its children start from its model and their side's rows.
    """

    def __init__(self, d: int, quality=None, model: Callable[[int], object] = OnlineLeastSquares, delta: float = 0.01, tie: float = 0.05, chunk: int = 100, memory: int | None = None):
        self.d, self.quality, self.delta, self.tie, self.chunk, self.memory = d, quality or StandardDeviationReduction(), delta, tie, chunk, memory
        self.root: object = _Leaf(model(d), Cells.empty(d) if memory is None else Rows(d, most=memory))

    def predict(self, x: np.ndarray) -> float:
        return _descend(self.root, x)[0].model.predict(x)

    def learn(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Predicts and then learns each row. Leaves learn nothing from each other, so each takes its rows at once, up to where it looks or splits."""
        out = np.empty(len(y))
        if self.memory is not None:
            for i, (a, b) in enumerate(zip(x, y)):
                out[i] = self.predict(a)
                self.push(a, b)
            return out
        left = [(self.root, None, False, np.arange(len(y)))]
        while left:
            node, parent, right, rows = left.pop()
            if not len(rows):
                continue
            if isinstance(node, _Split):
                over = x[rows, node.input] > node.threshold
                left += [(node.left, node, False, rows[~over]), (node.right, node, True, rows[over])]
                continue
            used, split = self._learn_leaf(node, x[rows], y[rows], out, rows)
            if split:
                left.append((self._split(node, parent, right), parent, right, rows[used:]))
        return out

    def _learn_leaf(self, leaf: _Leaf, x: np.ndarray, y: np.ndarray, out: np.ndarray, rows: np.ndarray) -> tuple[int, bool]:
        """How many of its rows a leaf took, and whether it is to split after these."""
        at = 0
        while at < len(y):
            most = min(len(y) - at, self.chunk - leaf.seen % self.chunk)
            looks = (leaf.seen + most) % self.chunk == 0
            stop = self._split_after(leaf, leaf.seen, most - looks)
            take = slice(at, at + (stop or most))
            out[rows[take]] = _predict_and_learn(leaf.model, x[take], y[take])
            leaf.rows.push_all(x[take], y[take])
            leaf.seen += take.stop - at
            at = take.stop
            if stop:
                return at, True
            if looks:
                self._look(leaf)
                if self._split_after(leaf, leaf.seen - 1, 1):
                    return at, True
        return at, False

    def _split_after(self, leaf: _Leaf, seen: int, rows: int) -> int:
        """After how many of the next rows the bound makes the leaf's best split certain; 0 for none of them."""
        if len(leaf.best) < 2 or leaf.best[0][0] <= 0 or not rows:
            return 0
        ratio = max(0.0, leaf.best[1][0]) / leaf.best[0][0]
        sums, counts = np.cumsum(np.append(leaf.ratio, np.full(rows, ratio)))[1:], np.arange(leaf.ratios + 1, leaf.ratios + rows + 1)
        bound = np.sqrt(math.log(1 / self.delta) / (2.0 * np.arange(seen + 1, seen + rows + 1))) if self.delta else np.ones(rows)
        certain = (sums / counts < 1 - bound) | (bound < self.tie)
        leaf.ratio, leaf.ratios = float(sums[-1]), int(counts[-1])
        return int(certain.argmax()) + 1 if certain.any() else 0

    def push(self, x: np.ndarray, y: float) -> None:
        leaf, parent, right = _descend(self.root, x)
        leaf.model.push(x, y)
        leaf.rows.push(x, y)
        leaf.seen += 1
        if leaf.seen % self.chunk == 0:
            self._look(leaf)
        if len(leaf.best) == 2:
            first, second = leaf.best
            if first[0] > 0:
                leaf.ratio += max(0.0, second[0]) / first[0]
                leaf.ratios += 1
                bound = hoeffding_bound(leaf.seen, self.delta)
                if leaf.ratio / leaf.ratios < 1 - bound or bound < self.tie:
                    self._split(leaf, parent, right)

    def _look(self, leaf: _Leaf) -> None:
        x, *sums = leaf.rows.sums()
        found = []
        for j in range(self.d):
            order = np.argsort(x[:, j], kind="stable")
            xs, (y, n, q) = x[order], (s[order] for s in sums)
            worth = np.where(np.append(xs[1:, j] > xs[:-1, j], False), self.quality.qualities(xs, y, j, n, q), -np.inf)
            i = int(np.argmax(worth))
            if np.isfinite(worth[i]):
                found.append((float(worth[i]), j, float(xs[i, j])))
        found = sorted(found, key=lambda f: -f[0])[:2]
        if len(found) == 1:
            found.append((0.0, -1, 0.0))
        if tuple(f[1:] for f in found) != tuple(f[1:] for f in leaf.best):
            leaf.ratio, leaf.ratios = 0.0, 0
        leaf.best = tuple(found)

    def _split(self, leaf: _Leaf, parent: _Split | None, right: bool) -> _Split:
        _, j, t = leaf.best[0]
        sides = []
        over = leaf.rows.sums()[0][:, j] > t
        for side in (~over, over):
            rows = leaf.rows.where(side)
            sides.append(_Leaf(_side_model(leaf.model, rows), rows, len(rows)))
        node = _Split(j, t, *sides)
        if parent is None:
            self.root = node
        elif right:
            parent.right = node
        else:
            parent.left = node
        return node

    def leaves(self) -> int:
        count = lambda n: count(n.left) + count(n.right) if isinstance(n, _Split) else 1
        return count(self.root)

    def expression(self, names: Sequence[str]) -> Expr:
        def of(node) -> Expr:
            if isinstance(node, _Split):
                return StreamTree(names[node.input], node.threshold, of(node.left), of(node.right))
            errors = (n * (y / n - node.model.predict(x)) ** 2 + max(0.0, q - y * y / n) for x, y, n, q in zip(*node.rows.sums()))
            return StreamLeaf(node.model.expression(names), float(sum(errors)) / max(1, len(node.rows) - 1))

        return of(self.root)


@dataclass
class _Bag:
    """A leaf of an ExtraTree: for each distinct row of inputs how many there are and the sum of their targets, and both over all; the inputs' ranges."""

    cells: dict[tuple, list]
    n: int
    total: float
    low: list[float]
    high: list[float]

    @staticmethod
    def of(cells: dict[tuple, list]) -> _Bag:
        return _Bag(cells, sum(c[0] for c in cells.values()), sum(c[1] for c in cells.values()), [min(v) for v in zip(*cells)], [max(v) for v in zip(*cells)])

    def push(self, x: tuple, y: float) -> None:
        cell = self.cells.get(x)
        if cell is None:
            self.cells[x] = [1, y]
            self.low, self.high = ([f(*v) for v in zip(ends, x)] if ends else list(x) for f, ends in ((min, self.low), (max, self.high)))
        else:
            cell[0] += 1
            cell[1] += y
        self.n += 1
        self.total += y

    @property
    def mean(self) -> float:
        return self.total / self.n if self.n else 0.0


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of x, and for each row which it is."""
    order = np.lexsort(x.T[::-1])
    new = np.append(True, (x[order[1:]] != x[order[:-1]]).any(axis=1))[: len(x)]
    which = np.empty(len(x), int)
    which[order] = np.cumsum(new) - 1
    return x[order[new]], which


class ExtraTree:
    """A tree that splits a random input at a random place whenever a leaf holds `least` rows.

    Equal rows of inputs can't be split, so a leaf keeps their number and sum.
    """

    def __init__(self, d: int, least: int = 2, seed: int = 0):
        self.d, self.least, self.rng = d, least, np.random.default_rng(seed)
        self.root: object = _Bag.of({})

    def predict(self, x: np.ndarray) -> float:
        return _descend(self.root, x)[0].mean

    def push(self, x: np.ndarray, y: float) -> None:
        self._push(tuple(np.asarray(x, float).tolist()), float(y))

    def _push(self, x: tuple, y: float) -> tuple[float, tuple[_Bag, ...]]:
        """Learns a row; its prediction before, and the leaves that it left behind."""
        leaf, parent, right = _descend(self.root, x)
        before = leaf.mean
        leaf.push(x, y)
        if leaf.n < self.least:
            return before, (leaf,)
        j = int(self.rng.integers(self.d))
        low, high = leaf.low[j], leaf.high[j]
        if high <= low:
            return before, (leaf,)
        t = float(self.rng.uniform(low, high))
        if not low <= t < high:
            return before, (leaf,)
        sides = tuple(_Bag.of({k: v for k, v in leaf.cells.items() if (k[j] > t) == side}) for side in (False, True))
        node = _Split(j, t, *sides)
        if parent is None:
            self.root = node
        elif right:
            parent.right = node
        else:
            parent.left = node
        return before, sides

    def learn(self, x: np.ndarray, y: np.ndarray, groups: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Predicts and then learns each row. Rows whose leaf holds nothing but their equals split nothing; stretches of them are taken at once."""
        distinct, which = groups or _groups(x)
        rows = [tuple(v) for v in distinct.tolist()]
        at = {r: g for g, r in enumerate(rows)}
        leaves = [_descend(self.root, r)[0] for r in rows]
        alone = np.array([len(leaf.cells) == 1 and r in leaf.cells for r, leaf in zip(rows, leaves)], bool)
        out, ys, i, window = np.empty(len(y)), y.tolist(), 0, 64
        while i < len(y):
            calm = alone[which[i : i + window]]
            run = len(calm) if calm.all() else int(calm.argmin())
            if run >= 16:
                self._learn_alone(leaves, rows, which[i : i + run], y[i : i + run], out[i : i + run])
                i += run
                window = min(2 * window, 1 << 16) if run == len(calm) else max(64, window // 2)
                continue
            for k in range(i, min(i + run + 1, len(y))):
                out[k], left = self._push(rows[which[k]], ys[k])
                for leaf in left:
                    if len(left) == 2 or len(leaf.cells) <= 2:
                        for r in leaf.cells:
                            if r in at:
                                leaves[at[r]], alone[at[r]] = leaf, len(leaf.cells) == 1
            i += run + 1
            window = 64
        return out

    def _learn_alone(self, leaves: list[_Bag], rows: list[tuple], which: np.ndarray, y: np.ndarray, out: np.ndarray) -> None:
        order = np.argsort(which, kind="stable")
        sizes = np.bincount(which)
        draws, end = 0, 0
        for g in np.flatnonzero(sizes).tolist():
            leaf, k = leaves[g], int(sizes[g])
            take = order[end : end + k]
            sums = np.cumsum(np.append(leaf.total, y[take]))
            out[take] = sums[:-1] / np.arange(leaf.n, leaf.n + k)
            draws += min(k, max(0, leaf.n + k - self.least + 1))
            leaf.n, leaf.total = leaf.n + k, float(sums[-1])
            leaf.cells[rows[g]] = [leaf.n, leaf.total]
            end += k
        self.rng.integers(self.d, size=draws)  # as many as single rows draw


class Ensemble:
    """Learners that all see every row; the prediction is their mean."""

    def __init__(self, members: Sequence):
        self.members = list(members)

    def push(self, x: np.ndarray, y: float) -> None:
        for m in self.members:
            m.push(x, y)

    def predict(self, x: np.ndarray) -> float:
        return float(np.mean([m.predict(x) for m in self.members]))

    def learn(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        groups = _groups(x) if any(isinstance(m, ExtraTree) for m in self.members) else None
        return np.mean([m.learn(x, y, groups) if isinstance(m, ExtraTree) else _predict_and_learn(m, x, y) for m in self.members], axis=0)


# over tables and streams


#: Rows that are learned at once.
BLOCK_ROWS = 1 << 16
#: Tasks of a replay, at least: with few keys and few tasks two long streams would often share one.
LEAST_TASKS = 64
#: Rows of a range, about, that a task sorts: there are more ranges than tasks otherwise where a table has more rows, so that what a task holds does not grow with it.
RANGE_ROWS = 1 << 19
#: Rows of a packed block at most, and compressed bytes of blocks that go to Python at once.
PACKED_ROWS, BATCH_BYTES = 1 << 12, 4 << 20


def _predict_and_learn(learner, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The prediction of each row before it is learned; by blocks where the learner can."""
    if hasattr(learner, "learn"):
        return learner.learn(x, y)
    out = np.empty(len(y))
    for i, (xi, yi) in enumerate(zip(x, y)):
        out[i] = learner.predict(xi)
        learner.push(xi, yi)
    return out


def _learn(learner, x: np.ndarray, y: np.ndarray, every: int) -> Iterator[tuple[int, float, float]]:
    """Test, then train, on each row; yields (rows, RMSE, relative RMSE) of the last `every` rows, which the learner carries on to the next call."""
    full = ~(np.isnan(y) | np.isnan(x).any(axis=1))
    x, y = x[full], y[full]
    n, (errors, targets) = getattr(learner, "rows_seen", 0), getattr(learner, "recent", (np.empty(0), np.empty(0)))
    first = n - len(errors)  # rows before those that are held
    errors, targets = np.append(errors, (y - _predict_and_learn(learner, x, y)) ** 2), np.append(targets, y)
    for stop in range(n - n % every + every, n + len(y) + 1, every):
        last = slice(max(0, stop - first - every), stop - first)
        spread = float(np.var(targets[last])) or 1.0
        yield stop, float(np.sqrt(np.mean(errors[last]))), float(np.sqrt(np.mean(errors[last]) / spread))
    learner.rows_seen, learner.recent = n + len(y), (errors[-every:].copy(), targets[-every:].copy())


def _numbers(df: DataFrame, inputs: Sequence[str], target: str, seq: str, key: str) -> DataFrame:
    return df.select(key, seq, *(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate([*inputs, target])))


def replay(df: DataFrame, make: Callable[[], object], inputs: Sequence[str], target: str, seq: str, key: str, every: int = 100) -> DataFrame:
    """key, rows, rmse, rrse: the learning curve of each key's rows in order of seq, then of inputs and target.

    Rows of a key are learned in one task, since their order is the learner's meaning. They are sorted before, in ranges
    over all tasks, and come as compressed blocks of bare numbers, so that this task sorts blocks and holds the learner and no more.
    Rows are counted first: there is a range for every RANGE_ROWS of them.
    """
    d = len(inputs)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, now, held, size, points = None, None, [], 0, []

        def settle() -> None:
            if held:
                rows = np.concatenate(held)
                points.extend((now, *p) for p in _learn(learner, rows[:, :d], rows[:, d], every))
                held.clear()

        def told(type_: pa.DataType) -> pa.RecordBatch:
            keys, *rest = zip(*points)
            points.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, type_), pa.array(rest[0], pa.int64()), *(pa.array(r, pa.float64()) for r in rest[1:])], names=[key, "rows", "rmse", "rrse"])

        kind_ = None
        for batch in batches:
            kind_ = batch.column(0).type
            for here, n, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if learner is None or not (here == now or (here != here and now != now)):
                    settle()
                    learner, now, size = make(), here, 0
                held.append(np.frombuffer(pa.decompress(block.as_buffer(), n * (d + 1) * 8, "zstd")).reshape(d + 1, n).T)
                size += n
                if size >= BLOCK_ROWS:
                    settle()
                    size = 0
                if len(points) >= 10_000:
                    yield told(kind_)
        settle()
        if points:
            yield told(kind_)

    tasks = max(LEAST_TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbers = _numbers(df, inputs, target, seq, key)
    blocks = _blocks(numbers, seq, key, kind, max(tasks, -(-numbers.count() // RANGE_ROWS)))
    ordered = blocks.repartition(tasks, key).sortWithinPartitions(key, "_part", "_block").select(key, "_n", "_rows")
    return ordered.mapInArrow(run, f"`{key}` {kind}, rows long, rmse double, rrse double")


def _blocks(numbers: DataFrame, seq: str, key: str, kind: str, n_ranges: int) -> DataFrame:
    """key, _part, _block, _n, _rows: the values of each key's rows in order of seq, then of themselves: n doubles of each column, compressed; blocks in order of _part and _block."""
    values = [c for c in numbers.columns if c not in (key, seq)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            rows = np.column_stack([batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(1, batch.num_columns)])
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, np.arange(0, len(codes), PACKED_ROWS), [len(codes)]])).tolist()
            n = len(cuts) - 1
            packed = [pa.compress(rows[a:b].T.tobytes(), "zstd", asbytes=True) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(cuts[:-1])), pa.array([part] * n, pa.int32()), pa.array(range(done, done + n), pa.int64()), pa.array(np.diff(cuts), pa.int32()), pa.array(packed, pa.binary())], names=[key, "_part", "_block", "_n", "_rows"]
            )
            done += n

    numbers.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ranges = numbers.repartitionByRange(n_ranges, key, seq, *values).sortWithinPartitions(key, seq, *values)
    return ranges.select(key, *values).mapInArrow(pack, f"`{key}` {kind}, _part int, _block long, _n int, _rows binary")


def stream(df: DataFrame, make: Callable[[], object], inputs: Sequence[str], target: str, seq: str, key: str, every: int = 100) -> DataFrame:
    """As replay(), on a stream: the state of a key is its learner, and each micro-batch is learned in order of seq, then of inputs and target."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    d, kind = len(inputs), dict(df.dtypes)[key]
    values = [f"_{i}" for i in range(d + 1)]

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        learner = pickle.loads(state.get[0]) if state.exists else make()
        rows = pd.concat(list(frames)).sort_values([seq, *values], kind="stable", na_position="first")[values].to_numpy(float)
        points = list(_learn(learner, rows[:, :d], rows[:, d], every))
        state.update((pickle.dumps(learner),))
        yield pd.DataFrame([(k[0], *p) for p in points], columns=[key, "rows", "rmse", "rrse"])

    return _numbers(df, inputs, target, seq, key).groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, rows long, rmse double, rrse double", "learner binary", "append", GroupStateTimeout.NoTimeout)


def simple_regression(df: DataFrame, inputs: Sequence[str], target: str) -> Expr:
    """The model of SimpleRegressions from one aggregation (batch, or a complete-mode stream)."""
    y = F.col(target)
    out = []
    for i, c in enumerate(inputs):
        s = pair_sums(F.col(c), y)
        out += [F.coalesce(slope(s), F.lit(0.0)).alias(f"s{i}"), F.avg(c).alias(f"m{i}")]
    r = df.agg(F.avg(y).alias("y"), *out).first()
    w = [r[f"s{i}"] for i in range(len(inputs))]
    return Linear(tuple(inputs), (r["y"] - sum(a * r[f"m{i}"] for i, a in enumerate(w)), *w)) if r["y"] is not None else Constant(0.0)


def regression_sums(df: DataFrame, inputs: Sequence[str], target: str, *keys: str) -> DataFrame:
    """Sums of least squares by key, for a batch or for a stream in update or complete mode."""
    return df.groupBy(*keys).agg(*LeastSquares.columns([F.col(c) for c in inputs], F.col(target)))


