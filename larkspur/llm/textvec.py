"""Vectorised views of Arrow text columns: words, lines and their 64-bit hashes.

Text is handled as the UTF-8 bytes of an Arrow buffer, so no Python string is made.
A null text counts as empty. All arrays are numpy; all hashes are functions of the
bytes alone, equal in every process and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from larkspur.llm.arrowmap import remembered

#: Bytes of text that are hashed at once; one longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]

def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call of this task."""
    made = remembered("powers")
    have = made.get(base)
    if have is None or len(have) < n:
        have = np.empty(max(n, CHUNK_BYTES + 1), dtype=_U)
        have[0] = 1
        have[1:] = base
        made[base] = have = np.cumprod(have, dtype=_U)
    return have[:n]


#: Bytes of words that white space ends.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of letters, digits and whatever is not ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of lines.
LINE = np.ones(256, dtype=bool)
LINE[0x0A] = False


@dataclass
class Pieces:
    """Words (or lines) of consecutive texts: byte bounds, hashes, and each text's range of pieces."""

    data: np.ndarray
    begin: np.ndarray  # byte bounds of each text
    end: np.ndarray
    start: np.ndarray  # byte bounds of each piece
    stop: np.ndarray
    hash: np.ndarray
    lo: np.ndarray  # each text's pieces are lo..hi
    hi: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        """The text of each piece."""
        return np.repeat(np.arange(len(self.lo)), self.hi - self.lo)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def spans(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes number at most `most`, or one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def pieces(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED, fold: bool = False) -> Pieces:
    """The maximal runs of bytes of `kind` in each text; `fold` lower-cases A-Z in their hashes."""
    offsets = offsets - offsets[0]
    begin, end = offsets[:-1], offsets[1:]
    n = len(data)
    if not n:
        none, zero = np.empty(0, np.int64), np.zeros(len(begin), np.int64)
        return Pieces(data, begin, end, none, none, np.empty(0, _U), zero, zero)
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    full = begin < end
    first[begin[full]] = inside[begin[full]]
    last[end[full] - 1] = inside[end[full] - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.empty(n + 1, dtype=_U)
    total[0] = 0
    value = (_FOLDED if fold else _BYTE)[data]
    value *= powers(_BASE, n)
    np.cumsum(value, out=total[1:])
    h = total[stop] - total[start]
    h *= powers(_INVERSE, n + 1)[start]
    return Pieces(data, begin, end, start, stop, mix(h), np.searchsorted(start, begin), np.searchsorted(start, end))


_STEP = 0xD6E8FEB86659FD93


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive values, in order; none if there are fewer than n."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, _U)
    out = h[:m].copy()
    for j in range(1, n):
        out *= _U(_STEP)
        out += h[j : j + m]
    return mix(out)


def grams_within(p: Pieces, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive pieces of one text, and the position of each one's first piece."""
    g = grams(p.hash, n)
    inside = np.zeros(len(g) + 1, dtype=np.int32)
    lo, hi = p.lo, p.hi - n + 1
    some = hi > lo
    np.add.at(inside, lo[some], 1)
    np.add.at(inside, hi[some], -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    return g[at], at
