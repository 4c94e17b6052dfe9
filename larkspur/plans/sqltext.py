"""SQL text of what random choices and repeated formulas compute, for the oracles."""

from __future__ import annotations


def number(x: float) -> str:
    """A literal that is a double, not a decimal."""
    text = repr(float(x))
    return f"({text})" if "e" in text else f"({text}e0)"


def key(seed: int, *of: str) -> str:
    """The digest that frame.drawn_key makes."""
    return "md5(" + " || ':' || ".join([f"'{seed}'", *(f"CAST({x} AS VARCHAR)" for x in of)]) + ")"


def uniform(seed: int, *of: str, low: float = 0.0, high: float = 1.0) -> str:
    u = f"(CAST('0x' || substr({key(seed, *of)}, 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"
    return u if (low, high) == (0.0, 1.0) else f"({number(low)} + {u} * {number(high - low)})"


def gaussian(seed: int, of: str, mean: str = "0", sd: str = "1") -> str:
    return f"({mean} + {sd} * sqrt(-2 * ln(greatest({uniform(seed, of)}, 1e-300))) * cos(2 * pi() * {uniform(seed + 1_000_003, of)}))"


def laplace(seed: int, of: str, mean: float, scale: float) -> str:
    u = f"({uniform(seed, of)} - 0.5e0)"
    return f"({number(mean)} - {number(scale)} * sign({u}) * ln(greatest(1 - 2 * abs({u}), 1e-300)))"


def gamma(seed: int, of: str, shape: float, scale: float = 1.0, tries: int = 16) -> str:
    """For shapes from 1 on: the first accepted of a list of tries."""
    d = shape - 1 / 3
    v = f"power(1 + {number(1 / (9 * d) ** 0.5)} * e.x, 3)"
    accepted = f"{v} > 0 AND ln(greatest(e.u, 1e-300)) < 0.5e0 * e.x * e.x + {number(d)} - {number(d)} * {v} + {number(d)} * ln(greatest({v}, 1e-300))"
    drawn = ", ".join(f"{{'x': {gaussian(seed + 7919 * k, of)}, 'u': {uniform(seed + 7919 * k + 3, of)}}}" for k in range(tries))
    value = f"list_transform(list_filter([{drawn}], lambda e: {accepted}), lambda e: {number(d)} * {v})[1]"
    return f"(coalesce({value}, {number(d)}) * {number(scale)})"


def poisson(u: str) -> str:
    """How often a row is drawn into a bootstrap, from a uniform number."""
    p, total, out = 2.718281828459045**-1, 0.0, ""
    for k in range(7):
        total += p
        out += f" WHEN {u} < {number(total)} THEN {k}"
        p /= k + 1
    return f"(CASE{out} ELSE 7 END)"


def gaussian_cdf(z: str) -> str:
    """By the same rational approximation of the error function."""
    z = f"(({z}) / sqrt(2))"
    t = f"(1 / (1 + 0.3275911e0 * abs({z})))"
    poly = f"({t} * (0.254829592e0 + {t} * (-0.284496736e0 + {t} * (1.421413741e0 + {t} * (-1.453152027e0 + {t} * 1.061405429e0)))))"
    return f"(0.5e0 * (1 + sign({z}) * (1 - {poly} * exp(-({z}) * ({z})))))"
