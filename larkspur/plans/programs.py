"""Random expressions, their variation, and their linear forms (inventory G1-G4)."""

from __future__ import annotations

import random
from collections.abc import Sequence

from larkspur.plans.expr import FUNCTIONS, Apply, Constant, Expr, Variable

MAX_DEPTH, ATTEMPTS = 17, 2
BOOLEAN = frozenset({"not", "and", "or", "nand", "nor"})


def _leaf(names: Sequence[str], rng: random.Random, constants: Sequence[float]) -> Expr:
    options = [*names, *constants]
    x = rng.choice(options)
    return Variable(x) if isinstance(x, str) else Constant(x)


def full(names: Sequence[str], functions: Sequence[str], depth: int, rng: random.Random, constants: Sequence[float] = ()) -> Expr:
    """Every leaf at this depth."""
    if depth <= 1:
        return _leaf(names, rng, constants)
    f = rng.choice(list(functions))
    return Apply(f, tuple(full(names, functions, depth - 1, rng, constants) for _ in range(FUNCTIONS[f][0])))


def grown(names: Sequence[str], functions: Sequence[str], depth: int, rng: random.Random, constants: Sequence[float] = ()) -> Expr:
    """Leaves at this depth or above."""
    if depth <= 1 or rng.random() < len(names) / (len(names) + len(functions)):
        return _leaf(names, rng, constants)
    f = rng.choice(list(functions))
    return Apply(f, tuple(grown(names, functions, depth - 1, rng, constants) for _ in range(FUNCTIONS[f][0])))


def ramped(names: Sequence[str], functions: Sequence[str], low: int, high: int, rng: random.Random) -> Expr:
    """Full or grown, of a depth drawn between low and high."""
    return rng.choice([full, grown])(names, functions, rng.randint(low, high), rng)


def _bounded(make, original: Expr, most: int = MAX_DEPTH) -> Expr:
    """The first of a few attempts within the depth, else the original."""
    for _ in range(ATTEMPTS):
        new = make()
        if new is not None and new.depth() <= most:
            return new
    return original


def shrink(e: Expr, rng: random.Random) -> Expr:
    """An inner node gives its place to one of its children."""

    def make():
        inner = [i for i, x in enumerate(e.walk()) if x.children]
        if not inner:
            return None
        i = rng.choice(inner)
        return e.substitute(i, rng.choice(e.node(i).children))

    return _bounded(make, e)


def swap(e: Expr, names: Sequence[str], functions: Sequence[str], rng: random.Random) -> Expr:
    """A node becomes another of as many arguments."""

    def make():
        i = rng.randrange(e.size())
        x = e.node(i)
        if isinstance(x, Apply):
            same = [f for f in functions if FUNCTIONS[f][0] == len(x.children)]
            return e.substitute(i, Apply(rng.choice(same), x.children)) if same else None
        return e.substitute(i, Variable(rng.choice(list(names))))

    return _bounded(make, e)


def insert(e: Expr, names: Sequence[str], functions: Sequence[str], rng: random.Random) -> Expr:
    """A new node takes a node's place and has it as an argument."""

    def make():
        i = rng.randrange(e.size())
        f = rng.choice(list(functions))
        arguments = [Variable(rng.choice(list(names))) for _ in range(FUNCTIONS[f][0])]
        arguments[rng.randrange(len(arguments))] = e.node(i)
        return e.substitute(i, Apply(f, tuple(arguments)))

    return _bounded(make, e)


def koza(e: Expr, names: Sequence[str], functions: Sequence[str], rng: random.Random, depth: int = 4) -> Expr:
    """A subtree becomes a random one."""
    return _bounded(lambda: e.substitute(rng.randrange(e.size()), grown(names, functions, depth, rng)), e)


def crossover(a: Expr, b: Expr, rng: random.Random) -> tuple[Expr, Expr]:
    """Both exchange a subtree."""
    i, j = rng.randrange(a.size()), rng.randrange(b.size())
    x, y = a.substitute(i, b.node(j)), b.substitute(j, a.node(i))
    return (x if x.depth() <= MAX_DEPTH else a), (y if y.depth() <= MAX_DEPTH else b)


Symbol = str | float


def to_postfix(e: Expr) -> list[Symbol]:
    if isinstance(e, Variable):
        return [e.name]
    if isinstance(e, Constant):
        return [e.value]
    return [s for c in e.children for s in to_postfix(c)] + [e.name]


def from_postfix(symbols: Sequence[Symbol]) -> Expr:
    stack: list[Expr] = []
    for s in symbols:
        if isinstance(s, str) and s in FUNCTIONS:
            n = FUNCTIONS[s][0]
            if len(stack) < n:
                raise ValueError(f"{s} lacks arguments")
            stack[-n:] = [Apply(s, tuple(stack[-n:]))]
        else:
            stack.append(Variable(s) if isinstance(s, str) else Constant(s))
    if len(stack) != 1:
        raise ValueError(f"{len(stack)} expressions remain")
    return stack[0]


def to_prefix(e: Expr) -> list[Symbol]:
    return to_postfix(e) if not e.children else [e.name, *(s for c in e.children for s in to_prefix(c))]


def from_prefix(symbols: Sequence[Symbol]) -> Expr:
    at = 0

    def read() -> Expr:
        nonlocal at
        s = symbols[at]
        at += 1
        if isinstance(s, str) and s in FUNCTIONS:
            return Apply(s, tuple(read() for _ in range(FUNCTIONS[s][0])))
        return Variable(s) if isinstance(s, str) else Constant(s)

    e = read()
    if at != len(symbols):
        raise ValueError("symbols remain")
    return e


def postfix_actions(stack: Sequence[str], names: dict[str, str], functions: Sequence[str], left: int) -> list[Symbol]:
    """The symbols that may come next, given the types on the stack ("bool" or "double") and how many symbols are left, so that one expression can still be finished."""
    out: list[Symbol] = []
    if left > len(stack):
        out += list(names)
    for f in functions:
        n = FUNCTIONS[f][0]
        wanted = "bool" if f in BOOLEAN else "double"
        if len(stack) >= n and all(t == wanted for t in stack[-n:]) and left >= len(stack) - n + 1:
            out.append(f)
    return out
