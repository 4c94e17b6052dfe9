"""Expressions as values: trees of nodes that compile to one Column (inventory E1-E12).

A learned model is an expression too, so scoring it is a projection that Catalyst sees
through. Nodes are immutable and compare by value, which makes a frame a memo of the
expressions that it already holds as columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import scalar
from larkspur.functions.stats import row_mean, row_stats

FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "not": (1, scalar.not_), "and": (2, scalar.and_), "or": (2, scalar.or_), "nand": (2, scalar.nand), "nor": (2, scalar.nor), "equal": (2, scalar.equal), "if": (3, scalar.if_then_else),
    "+": (2, scalar.add), "-": (2, scalar.subtract), "*": (2, scalar.multiply), "/": (2, scalar.divide), "p/": (2, scalar.protected_divide), "^": (2, scalar.power), "min": (2, scalar.minimum), "max": (2, scalar.maximum),
    "neg": (1, scalar.opposite), "inverse": (1, scalar.inverse), "abs": (1, scalar.absolute), "log": (1, scalar.log), "plog": (1, scalar.protected_log), "exp": (1, scalar.exp), "sqrt": (1, scalar.sqrt), "cos": (1, scalar.cos), "sin": (1, scalar.sin), ">": (2, scalar.greater),
}
COMMUTATIVE = frozenset({"and", "or", "nand", "nor", "equal", "+", "*", "min", "max"})


class Expr:
    """A node. Subclasses give their children and their Column."""

    children: tuple[Expr, ...] = ()

    def column(self) -> Column:
        raise NotImplementedError

    def with_children(self, children: tuple[Expr, ...]) -> Expr:
        return self

    def walk(self) -> Iterator[Expr]:
        """All nodes, each before what is below it."""
        yield self
        for c in self.children:
            yield from c.walk()

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)

    def depth(self) -> int:
        """Nodes on the longest way down; 1 for a leaf."""
        return 1 + max((c.depth() for c in self.children), default=0)

    def node(self, i: int) -> Expr:
        for k, x in enumerate(self.walk()):
            if k == i:
                return x
        raise IndexError(i)

    def depth_of(self, i: int) -> int:
        """The depth at which the i-th node stands; 0 for the root."""
        if i == 0:
            return 0
        i -= 1
        for c in self.children:
            if i < c.size():
                return 1 + c.depth_of(i)
            i -= c.size()
        raise IndexError(i)

    def substitute(self, i: int, new: Expr) -> Expr:
        """This expression with its i-th node replaced."""
        if i == 0:
            return new
        i -= 1
        out = []
        for c in self.children:
            n = c.size()
            out.append(c.substitute(i, new) if 0 <= i < n else c)
            i -= n
        return self.with_children(tuple(out))

    def leaves(self) -> list[Expr]:
        return [x for x in self.walk() if not x.children]

    def inner(self) -> list[Expr]:
        return [x for x in self.walk() if x.children]


@dataclass(frozen=True)
class Variable(Expr):
    name: str

    def column(self) -> Column:
        return F.col(self.name)

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Constant(Expr):
    value: object

    def column(self) -> Column:
        if isinstance(self.value, tuple):
            return F.array(*(F.lit(float(x)) for x in self.value))
        return F.lit(self.value)

    def __str__(self) -> str:
        return str(self.value)


@dataclass(frozen=True)
class Apply(Expr):
    """A named function of its arguments."""

    name: str
    children: tuple[Expr, ...] = field()

    def __post_init__(self):
        if self.name not in FUNCTIONS or FUNCTIONS[self.name][0] != len(self.children):
            raise TypeError(f"{self.name} of {len(self.children)} arguments")

    def column(self) -> Column:
        return FUNCTIONS[self.name][1](*(c.column() for c in self.children))

    def with_children(self, children):
        return replace(self, children=children)

    def canonical(self) -> Apply:
        """Arguments of a commutative function in one order."""
        return replace(self, children=tuple(sorted(self.children, key=str))) if self.name in COMMUTATIVE else self

    def __str__(self) -> str:
        if len(self.children) == 2:
            return f"({self.children[0]} {self.name} {self.children[1]})"
        return f"{self.name}({', '.join(map(str, self.children))})"


@dataclass(frozen=True)
class Stump(Expr):
    """Whether a value reaches a threshold."""

    children: tuple[Expr] = field()
    threshold: float

    def column(self) -> Column:
        return scalar.stump(self.children[0].column(), self.threshold)

    def with_children(self, children):
        return replace(self, children=children)

    def __str__(self) -> str:
        return f"({self.children[0]} >= {self.threshold})"


@dataclass(frozen=True)
class Aggregate(Expr):
    """An ensemble: the mean, or the statistics, of its members on each row."""

    children: tuple[Expr, ...] = field()
    kind: str = "mean"

    def column(self) -> Column:
        return {"mean": row_mean, "stats": row_stats}[self.kind](*(c.column() for c in self.children))

    def with_children(self, children):
        return replace(self, children=children)


@dataclass(frozen=True)
class Test(Expr):
    """Three branches of a condition: false, true and null. Each is evaluated on its own rows only."""

    condition: Expr
    failure: Expr
    success: Expr
    missing: Expr

    @property
    def children(self) -> tuple[Expr, ...]:
        return (self.condition, self.failure, self.success, self.missing)

    def column(self) -> Column:
        c = self.condition.column()
        return F.when(c.isNull(), self.missing.column()).when(c, self.success.column()).otherwise(self.failure.column())

    def with_children(self, children):
        return Test(*children)


@dataclass(frozen=True)
class Linear(Expr):
    """bias + sum of weights and variables."""

    names: tuple[str, ...]
    weights: tuple[float, ...]  # the bias first

    def column(self) -> Column:
        out = F.lit(float(self.weights[0]))
        for n, w in zip(self.names, self.weights[1:]):
            out = out + float(w) * F.col(n)
        return out


@dataclass(frozen=True)
class NormalisedLinear(Expr):
    """As Linear, over (x - mean) / (3 sd); a variable without spread has no part."""

    names: tuple[str, ...]
    weights: tuple[float, ...]
    means: tuple[float, ...]
    sds: tuple[float, ...]

    def column(self) -> Column:
        out = F.lit(float(self.weights[0]))
        for n, w, m, s in zip(self.names, self.weights[1:], self.means, self.sds):
            if s:
                out = out + float(w) * ((F.col(n) - float(m)) / (3 * float(s)))
        return out


@dataclass(frozen=True)
class AxisTree(Expr):
    """x < threshold goes left, else right; leaves are values."""

    name: str
    threshold: float
    left: Expr
    right: Expr

    @property
    def children(self) -> tuple[Expr, ...]:
        return (self.left, self.right)

    def column(self) -> Column:
        return F.when(F.col(self.name) < self.threshold, self.left.column()).otherwise(self.right.column())

    def with_children(self, children):
        return replace(self, left=children[0], right=children[1])


@dataclass(frozen=True)
class StreamTree(Expr):
    """x > threshold goes right, else left; leaves give (mean, variance)."""

    name: str
    threshold: float
    left: Expr
    right: Expr

    @property
    def children(self) -> tuple[Expr, ...]:
        return (self.left, self.right)

    def column(self) -> Column:
        return F.when(F.col(self.name) > self.threshold, self.right.column()).otherwise(self.left.column())

    def with_children(self, children):
        return replace(self, left=children[0], right=children[1])


@dataclass(frozen=True)
class StreamLeaf(Expr):
    """A leaf's model and the variance of its residuals."""

    model: Expr
    variance: float

    @property
    def children(self) -> tuple[Expr, ...]:
        return (self.model,)

    def column(self) -> Column:
        return F.struct(self.model.column().alias("mean"), F.lit(float(self.variance)).alias("variance"))

    def with_children(self, children):
        return replace(self, model=children[0])


@dataclass
class Memo:
    """A frame with the expressions that it holds as columns."""

    frame: DataFrame
    held: dict[Expr, str] = field(default_factory=dict)

    def column(self, e: Expr) -> Column:
        if e in self.held:
            return F.col(self.held[e])
        if isinstance(e, Apply):
            return FUNCTIONS[e.name][1](*(self.column(c) for c in e.children))
        return e.column()

    def hold(self, e: Expr, name: str) -> Memo:
        return Memo(self.frame.withColumn(name, self.column(e)), {**self.held, e: name})


def importance(log: Sequence[tuple[str, float, int]], rows: int) -> dict[str, float]:
    """Of each feature: the sum of its splits' scores, weighted by their shares of all rows."""
    out: dict[str, float] = {}
    for feature, score, n in log:
        out[feature] = out.get(feature, 0.0) + score * n / rows
    return out
