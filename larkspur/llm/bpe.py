r"""Byte-level BPE encoding and decoding over padded numpy matrices.

Distinct pieces of text that the worker has not met yet are put, by length, into
padded matrices of token ids. In each round every row merges its leftmost pair of
least rank; pairs are looked up in a hashed table, rows close up, and rows without a
pair leave the matrix. A piece longer than the widest matrix takes a heap of its
pairs instead, with the same merges.

Cases: a null or empty text has no tokens and decodes to no bytes; special tokens
are ordinary text; texts of any length are encoded whole; repeated rows each get a
result. Only the id and the text column are read unless `carry` names more.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm.arrowmap import column, map_arrow, remembered
from larkspur.llm.textvec import mix

WIDTHS = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256)
#: Pieces whose tokens a worker remembers; beyond it starts anew.
REMEMBERED = 200_000
NONE = np.int32(2**31 - 1)
_U = np.uint64


class PairTable:
    """Ranks by pair of token ids, in an open-addressed table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(rank)) * 3))))
        self.key = np.full(1 << self.bits, np.iinfo(np.uint64).max, _U)
        self.rank = np.full(1 << self.bits, NONE, np.int32)
        key = (left.astype(_U) << _U(32)) | right.astype(_U)
        at, todo = self.slot(key), np.arange(len(key))
        while len(todo):
            free = self.key[at[todo]] == np.iinfo(np.uint64).max
            slots, first = np.unique(at[todo[free]], return_index=True)
            put = todo[free][first]
            self.key[slots], self.rank[slots] = key[put], rank[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(_U) << _U(32)) | right.astype(_U)
        at, out = self.slot(key), np.full(len(key), NONE, np.int32)
        todo = np.arange(len(key))
        while len(todo):
            there = self.key[at[todo]]
            same = there == key[todo]
            out[todo[same]] = self.rank[at[todo[same]]]
            todo = todo[~same & (there != np.iinfo(np.uint64).max)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out


class Vocabulary:
    """The rank file of a byte-level BPE, with its pairs and what was encoded lately."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex

        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        self.split = regex.compile(pattern).findall
        size = max(self.rank.values()) + 1
        token = [b""] * size
        for t, r in self.rank.items():
            token[r] = t
        self.text = np.frombuffer(b"".join(token), np.uint8)
        self.size = np.array([len(t) for t in token], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        sides = [(self.rank[t[:i]], self.rank[t[i:]], r) for t, r in self.rank.items() for i in range(1, len(t)) if t[:i] in self.rank and t[i:] in self.rank]
        left, right, rank = (np.array(x, np.int32) for x in zip(*sides))
        self.pairs = PairTable(left, right, rank)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.count = np.empty(0, np.int32), np.empty(0, np.int64)
        self.first = np.empty(0, np.int64)

    def learn(self, new: list[str]) -> None:
        """Encodes pieces and remembers their tokens."""
        raw = [p.encode() for p in new]
        out: list[np.ndarray | None] = [None] * len(raw)
        by: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            whole = self.rank.get(b)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(b) <= WIDTHS[-1]:
                by.setdefault(next(w for w in WIDTHS if len(b) <= w), []).append(i)
            else:
                out[i] = self.by_heap(b)
        for width, rows in by.items():
            for lo in range(0, len(rows), 1 << 14):
                part = rows[lo : lo + (1 << 14)]
                for i, ids in zip(part, self.by_matrix([raw[i] for i in part], width)):
                    out[i] = ids
        base = len(self.ids)
        count = np.array([len(x) for x in out], np.int64)
        self.first = np.concatenate([self.first, base + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, *out])
        n = len(self.known)
        self.known.update(zip(new, range(n, n + len(new))))

    def by_matrix(self, raw: list[bytes], width: int) -> list[np.ndarray]:
        n = len(raw)
        size = np.array([len(b) for b in raw])
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        rank = np.full((n, width), NONE, np.int32)
        has = np.arange(width - 1) < (size - 1)[:, None]
        rank[:, :-1][has] = self.pairs.find(ids[:, :-1][has], ids[:, 1:][has])
        live, done = np.arange(n), [None] * n
        columns = np.arange(width)
        while len(live):
            j = rank.argmin(axis=1)  # the leftmost of least rank
            row = np.arange(len(live))
            best = rank[row, j]
            over = best == NONE
            if over.any():
                for k in np.flatnonzero(over):
                    done[live[k]] = ids[k, : size[k]].copy()
                keep = ~over
                ids, rank, size, live, j, best = ids[keep], rank[keep], size[keep], live[keep], j[keep], best[keep]
                row = np.arange(len(live))
                if not len(live):
                    break
            ids[row, j] = best
            shift = np.minimum(columns + (columns > j[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, shift, 1), np.take_along_axis(rank, shift, 1)
            size = size - 1
            gone = np.arange(width) >= size[:, None]
            ids[gone], rank[gone] = -1, NONE
            rank[row, size - 1] = NONE
            right = j + 1 < size
            rank[row[right], j[right]] = self.pairs.find(ids[row[right], j[right]], ids[row[right], j[right] + 1])
            left = j > 0
            rank[row[left], j[left] - 1] = self.pairs.find(ids[row[left], j[left] - 1], ids[row[left], j[left]])
            most = int(size.max())
            if most <= width // 2:  # closed up: a narrower matrix holds the rest
                width = most
                ids, rank, columns = ids[:, :width], rank[:, :width], columns[:width]
        return done

    def by_heap(self, raw: bytes) -> np.ndarray:
        ids = self.byte[np.frombuffer(raw, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        token = [raw[i : i + 1] for i in range(n)]
        get = self.rank.get
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := get(token[i] + token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, k = heapq.heappop(heap)
            if not (alive[i] and k < n and alive[k] and after[i] == k and get(token[i] + token[k]) == r):
                continue
            ids[i], token[i], alive[k] = r, token[i] + token[k], False
            after[i] = after[k]
            if after[i] < n:
                before[after[i]] = i
                if (x := get(token[i] + token[after[i]])) is not None:
                    heapq.heappush(heap, (x, i, after[i]))
            if before[i] >= 0 and (x := get(token[before[i]] + token[i])) is not None:
                heapq.heappush(heap, (x, before[i], i))
        return np.array([ids[i] for i in range(n) if alive[i]], np.int32)

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        if len(self.known) > REMEMBERED:
            self.forget()
        out: list[np.ndarray] = []
        waiting: list[list[str]] = []
        held = 0
        for text in texts:
            waiting.append(self.split(text))
            held += len(text)
            if held > 1 << 20:
                out += self._look_up(waiting)
                waiting, held = [], 0
        return out + self._look_up(waiting)

    def _look_up(self, split: list[list[str]]) -> list[np.ndarray]:
        """Token ids of each list of pieces; the new ones among them are encoded together."""
        new = dict.fromkeys(p for parts in split for p in parts if p not in self.known)
        if new:
            self.learn(list(new))
        out = []
        for parts in split:
            k = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
            out.append(self.ids[ranges(self.first[k], self.count[k])])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return self.text[ranges(self.at[ids], self.size[ids])].tobytes()


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0].., first[1].. : the concatenated ranges of these counts."""
    total = int(count.sum())
    step = np.ones(total, np.int64)
    some = count > 0
    first, count = first[some], count[some]
    if not len(first):
        return step[:0]
    step[0] = first[0]
    step[np.cumsum(count)[:-1]] = first[1:] - (first[:-1] + count[:-1] - 1)
    return np.cumsum(step)


def vocabulary(ranks: bytes, pattern: str, key: str | None = None) -> Vocabulary:
    """The vocabulary of a rank file's content, made once in each process until another operator's task runs there."""
    key, made = key or hashlib.sha256(ranks).hexdigest(), remembered("bpe")
    if (key, pattern) not in made:
        made[key, pattern] = Vocabulary(ranks, pattern)
    return made[key, pattern]


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """For each document its token ids, and the bytes that they decode to."""
    return _map(docs, path, pattern, doc_id, text, carry, "ids array<int>, decoded binary", lambda ids, raw: (pa.array(ids, pa.list_(pa.int32())), pa.array(raw, pa.binary())))


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """As encode(), with digests of the ids and of the decoded bytes in place of both, or beside the ids."""

    def made(ids: list[np.ndarray], raw: list[bytes]):
        return (
            *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []),
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
        )

    return _map(docs, path, pattern, doc_id, text, carry, "ids array<int>, " * with_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string", made)


def _map(docs: DataFrame, path: str, pattern: str, doc_id: str, text: str, carry: tuple[str, ...], result: str, made) -> DataFrame:
    new = [c.split()[0] for c in result.split(", ")]
    names = [c for c in docs.columns if c in {doc_id, *carry} and c not in new]
    own = [f"`{c}` {t}" for c, t in docs.dtypes if c in names]

    with open(path, "rb") as f:
        ranks = f.read()  # a vocabulary's file, of a few MB at most; workers need not have it
    key, sent = hashlib.sha256(ranks).hexdigest(), docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = remembered("bpe").get((key, pattern)) or vocabulary(sent.value, pattern, key)
        ids = v.encode(t or "" for t in column(batch, text).to_pylist())
        raw = [v.decode(x) for x in ids]
        return pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), *made(ids, raw)], names=[*names, *new])

    return map_arrow(docs.select(*dict.fromkeys([*names, text])), run, ", ".join([*own, result]), remembers="bpe")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    """Per document: the number of tokens and digests of the ids and of what they decode to."""
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
