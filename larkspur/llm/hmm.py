"""Hidden Markov language model.

Tokens are lower-cased words and one end per text. A latent state emits a symbol: one
of the TOP most frequent words, a class of rarer words (by their last two bytes), or
the end. A rarer word is drawn from its class by its own count, so a text's likelihood
is that of its symbols times that of its words given their classes, which sums to one
over all texts. The emission table is of fixed size; counts of rare words stay
distributed.

1. Words of the training texts are counted (a shuffle of distinct words per run).
2. Baum-Welch: each pass computes expected counts of transitions and emissions in every
   partition and adds them up over all training texts, whose symbols are written once.
   Passes go on until one raises the log10-likelihood a training token by less than
   CONVERGED, at any size. Texts are whole: those of like length go step by step together,
   and a long one goes in blocks whose first states are kept, so that memory is bounded.
   First values are the shares of symbols with noise.
3. Every text is scored by the scaled forward recursion over all its tokens, exactly;
   rare words look up their counts by a second shuffle, which returns sums to their texts.

Cases: a null or empty text is the end alone; no training texts leave the smoothed
uniform distribution; a null id counts as the empty text in the fold; rows that repeat
an id are scored and learned from each; ids may be of any type; texts of any length are
learned from and scored whole. Words are equal if their 64-bit hashes are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrowmap import column, small_batches
from larkspur.llm.exchange import blob, deal, keys, partitions, run_id, to_buckets, whole_partitions
from larkspur.llm.shared import is_whole, keep, settled
from larkspur.llm.textvec import SPACED, Pieces, buffers, mix, pieces, spans

TOP, CLASSES, STATES = 20_000, 1024, 8
#: Tokens that go step by step together; a text with more goes in blocks of as many.
GROUP = 1 << 18
#: Tokens of a row of training symbols, within which texts of like length find each other.
RUN = 3_000_000
#: Gain in log10-likelihood a training token below which passes end.
CONVERGED = 1e-3
ADD = 0.1
_U = np.uint64


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def rest_class(p: Pieces, some: np.ndarray) -> np.ndarray:
    """The class of words by their last two bytes, lower-cased."""
    last = p.data[p.stop[some] - 1].astype(_U)
    before = np.where(p.stop[some] - p.start[some] > 1, p.data[np.maximum(p.stop[some] - 2, 0)], 0).astype(_U)
    fold = lambda b: np.where((b >= 65) & (b <= 90), b + _U(32), b)
    return (mix(fold(last) * _U(256) + fold(before) + _U(1)) % _U(CLASSES)).astype(np.int32)


@dataclass
class Lexicon:
    """Symbols of words, and what the base score and the classes need of the counts."""

    slot_key: np.ndarray
    slot_symbol: np.ndarray
    count: np.ndarray  # of each top word
    rest_total: np.ndarray  # log10 of the mass of each class
    share: np.ndarray  # of each symbol among the training tokens
    tokens: int
    kinds: int
    ends: int

    @property
    def symbols(self) -> int:
        return len(self.count) + CLASSES + 1

    def symbol(self, p: Pieces) -> np.ndarray:
        h, bits = p.hash, int(np.log2(len(self.slot_key)))
        at, out = (h >> _U(64 - bits)).astype(np.int64), np.full(len(h), -1, np.int32)
        todo = np.arange(len(h))
        while len(todo):
            there = self.slot_symbol[at[todo]]
            same = (self.slot_key[at[todo]] == h[todo]) & (there >= 0)
            out[todo[same]] = there[same]
            todo = todo[~same & (there >= 0)]
            at[todo] = (at[todo] + 1) & (len(self.slot_key) - 1)
        rest = np.flatnonzero(out < 0)
        out[rest] = len(self.count) + rest_class(p, rest)
        return out


def _table(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = max(10, int(np.ceil(np.log2(max(1, len(hashes)) * 6))))
    key, symbol = np.zeros(1 << bits, _U), np.full(1 << bits, -1, np.int32)
    for s, h in enumerate(hashes.tolist()):
        at = h >> (64 - bits)
        while symbol[at] >= 0:
            at = (at + 1) & ((1 << bits) - 1)
        key[at], symbol[at] = h, s
    return key, symbol


def _runs(batches: Iterator[pa.RecordBatch], most: int, make) -> Iterator[tuple[list, int]]:
    """Lists of make(pieces, ids) of consecutive texts, and the number of texts before them."""
    held, n, seen, first = [], 0, 0, 0
    for b in batches:
        data, at = buffers(column(b, "t"))
        for lo, hi in spans(at):
            p = pieces(data[at[lo] : at[hi]], at[lo : hi + 1], SPACED, fold=True)
            held.append(make(p, column(b, "i").slice(lo, hi - lo).to_pylist()))
            n += len(p.hash) + hi - lo
            seen += hi - lo
            if n >= most:
                yield held, first
                held, n, first = [], 0, seen
    if held:
        yield held, first


def learn_lexicon(source: DataFrame) -> Lexicon:
    """Counts the words of the training texts."""
    spark = source.sparkSession
    n = partitions(source)
    key = keys(n).tolist()
    most = min(max(n * 4096, 200_000), 1_000_000)

    def make(p: Pieces, ids: list):
        train = np.array([not held_out(i) for i in ids])
        w = np.flatnonzero(np.repeat(train, p.hi - p.lo))
        h, first, count = np.unique(p.hash[w], return_index=True, return_counts=True)
        return h, rest_class(p, w[first]), count, int(train.sum())

    def ask(batches):
        for run, _ in _runs(batches, most, make):
            h, c, m = (np.concatenate(x) for x in list(zip(*run))[:3])
            h, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            c, m = c[first], np.bincount(inverse, m, len(h)).astype(np.int64)
            order, cut = deal(h, n)
            h, c, m = h[order], c[order].astype(np.int16), m[order].astype(np.int32)
            ends = sum(x[3] for x in run)
            rows = [(key[k], blob(h[s]), blob(c[s]), blob(m[s]), ends if k == 0 else 0) for k in range(n) for s in [slice(cut[k], cut[k + 1])] if k == 0 or cut[k] < cut[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 3, pa.int64()])], names=["bucket", "h", "c", "m", "ends"])

    def answer(got):
        h, c, m = (np.frombuffer(b"".join(x for b in got for x in column(b, name).to_pylist()), kind) for name, kind in (("h", _U), ("c", np.int16), ("m", np.int32)))
        ends = sum(sum(column(b, "ends").to_pylist()) for b in got)
        h, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        c, m = c[first].astype(np.int64), np.bincount(inverse, m, len(h)).astype(np.int64)
        top = np.lexsort((h, -m))[:TOP]
        # the most frequent words, then sums by class (as word 0), then ends (class -1)
        kinds, total = np.bincount(c, minlength=CLASSES), np.bincount(c, m, CLASSES).astype(np.int64)
        cls = np.flatnonzero(kinds)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.zeros(len(top), np.int8), np.ones(len(cls), np.int8), np.full(1, 2, np.int8)])),
                pa.array(np.concatenate([h[top].view(np.int64), np.zeros(len(cls) + 1, np.int64)])),
                pa.array(np.concatenate([c[top], cls, [-1]]).astype(np.int32)),
                pa.array(np.concatenate([m[top], total[cls], [ends]]).astype(np.int64)),
                pa.array(np.concatenate([np.ones(len(top), np.int64), kinds[cls], [0]])),
            ],
            names=["what", "h", "c", "m", "kinds"],
        )

    small_batches(spark)
    asks = source.mapInArrow(ask, "bucket int, h binary, c binary, m binary, ends long")
    counts = whole_partitions(to_buckets(asks, n), answer, "what tinyint, h long, c int, m long, kinds long").persist()  # read three times below
    top = _most_frequent(counts.where("what = 0"))
    sums = counts.where("what > 0").groupBy("what", "c").agg(F.sum("m").alias("m"), F.sum("kinds").alias("kinds")).toPandas()  # CLASSES + 1 rows
    counts.unpersist()
    ends = int(sums.loc[sums["what"] == 2, "m"].sum())
    by = sums[sums["what"] == 1]
    total, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    total[by["c"]], kinds[by["c"]] = by["m"], by["kinds"]
    tokens, distinct = int(total.sum()) + ends, int(kinds.sum()) + (ends > 0)
    np.subtract.at(total, top["c"].to_numpy(), top["m"].to_numpy())
    np.subtract.at(kinds, top["c"].to_numpy(), 1)
    hashes, count = top["h"].to_numpy(np.int64).view(_U), top["m"].to_numpy(np.float64)
    mass = np.concatenate([count, total, [ends]]) + ADD
    return Lexicon(*_table(hashes), count, np.log10(total + ADD * (kinds + 1)), mass / mass.sum(), tokens, distinct, ends)


def _most_frequent(words: DataFrame):
    """The TOP words of the greatest counts, ties by hash: those above a count on a grid of 16 steps an octave, so that few are sorted."""
    step = F.floor(F.log2("m") * 16).cast("int")
    sizes = words.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("k", ascending=False)  # 16 rows an octave
    enough = sizes.loc[sizes["n"].cumsum() >= TOP, "k"]
    return words.where(step >= (int(enough.max()) if len(enough) else 0)).orderBy(F.col("m").desc(), "h").limit(TOP).toPandas()


@dataclass
class Model:
    """Start of a text, transitions, and emissions by symbol."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol x state

    @staticmethod
    def first(share: np.ndarray) -> Model:
        noise = np.random.default_rng(7).gamma(2.0, size=(len(share), STATES))
        emit = share[:, None] * noise
        move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
        return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))

    @staticmethod
    def of(counts: tuple[np.ndarray, ...], share: np.ndarray) -> Model:
        """The maximisation step, smoothed so that every symbol can come from every state."""
        start, move, emit = counts
        unit = lambda x, add, axis=0: (x + add) / (x + add).sum(axis=axis, keepdims=True)
        return Model(unit(start, 0.1), unit(move, 0.1, 1), unit(emit, 20 * share[:, None]))


def groups(size: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Texts in order of falling size, in groups of at most `most` tokens or one text."""
    order = np.argsort(-size, kind="stable")
    total = np.concatenate([[0], np.cumsum(size[order])])
    lo = 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, side="right")) - 1)
        yield order[lo:hi]
        lo = hi


def stepwise(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts by falling size: the bounds of steps (all first tokens, all second ones, ..), each token's text, and its place."""
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    at = np.concatenate([[0], np.cumsum(live)])
    step = np.repeat(np.arange(len(live)), live)
    text = np.arange(at[-1]) - at[step]
    return at, text, begin[text] + step


def _blocks(at: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Steps in blocks of at most `most` tokens, or one step."""
    out, lo, n = [], 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def forward(emitted: np.ndarray, at: list[int], model: Model, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The scaled forward recursion over steps with bounds `at`, from the states before them (None: the start): shares of states after each token, and its factor of the likelihood."""
    a, c, ones = np.empty_like(emitted), np.empty(len(emitted)), np.ones(STATES)
    for lo, hi in zip(at, at[1:]):
        now, factor = a[lo:hi], c[lo:hi]
        if before is None:
            np.multiply(model.start, emitted[lo:hi], out=now)
        else:
            np.matmul(before[: hi - lo], model.move, out=now)
            now *= emitted[lo:hi]
        np.dot(now, ones, out=factor)
        now /= factor[:, None]
        before = now
    return a, c


def expected(symbols: np.ndarray, bounds: np.ndarray, model: Model, most: int = GROUP) -> tuple[tuple[np.ndarray, ...], float]:
    """The expectation step over texts: expected counts of starts, transitions and emissions, and the log10-likelihood."""
    start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros_like(model.emit)
    back = np.ascontiguousarray(model.move.T)
    likelihood = 0.0
    size = np.diff(bounds)
    for some in groups(size, most):
        at, _, place = stepwise(bounds[some], size[some])
        blocks = _blocks(at, most)
        entered: list[np.ndarray | None] = [None]  # the states before each block
        for lo, hi in blocks[:-1]:
            a, _ = forward(model.emit[symbols[place[at[lo] : at[hi]]]], (at[lo : hi + 1] - at[lo]).tolist(), model, entered[-1])
            entered.append(a[at[hi - 1] - at[lo] :].copy())
        after = None  # emission, scale and what follows, of the step behind
        for (lo, hi), before in zip(blocks[::-1], entered[::-1]):
            ends = (at[lo : hi + 1] - at[lo]).tolist()
            s = symbols[place[at[lo] : at[hi]]]
            right = model.emit[s]
            a, c = forward(right, ends, model, before)
            likelihood += float(np.log10(c).sum())
            right /= c[:, None]
            beta = np.ones((ends[1], STATES))
            for x, y in zip(ends[-2::-1], ends[::-1]):
                now = a[x:y]
                if after is not None:
                    move += now[: len(after)].T @ after
                    np.matmul(after, back, out=beta[: len(after)])
                now *= beta[: y - x]
                after = right[x:y]
                after *= beta[: y - x]
            if before is None:
                start += a[: ends[1]].sum(axis=0)
            else:
                after = after.copy()  # the next block's last step is not shorter
            a = np.ascontiguousarray(a.T)
            for k in range(STATES):
                emit[:, k] += np.bincount(s, a[k], len(emit))
    return (start, move * model.move, emit), likelihood


def log_likelihood(symbols: np.ndarray, bounds: np.ndarray, model: Model, most: int = GROUP) -> np.ndarray:
    """log10 of each text's likelihood: the scaled forward recursion over all its symbols."""
    size = np.diff(bounds)
    out = np.zeros(len(size))
    for some in groups(size, most):
        at, text, place = stepwise(bounds[some], size[some])
        before = None
        for lo, hi in _blocks(at, most):
            tokens = slice(at[lo], at[hi])
            a, c = forward(model.emit[symbols[place[tokens]]], (at[lo : hi + 1] - at[lo]).tolist(), model, before)
            out[some] += np.bincount(text[tokens], np.log10(c), len(some))
            before = a[at[hi - 1] - at[lo] :].copy()
    return out


def with_ends(symbols: np.ndarray, p: Pieces, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with an end after each text, and the bounds of texts."""
    size = p.hi - p.lo
    bounds = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(bounds[-1], end, np.int32)
    inside = np.ones(len(out), bool)
    inside[bounds[1:] - 1] = False
    out[inside] = symbols
    return out, bounds


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    symbols = np.concatenate([s for s, _ in parts])
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in parts]))])
    return symbols, bounds


def _train_symbols(lexicon: Lexicon):
    def make(p: Pieces, ids: list):
        symbols, bounds = with_ends(lexicon.symbol(p), p, lexicon.symbols - 1)
        train = np.array([not held_out(i) for i in ids])
        return symbols[np.repeat(train, np.diff(bounds))], np.concatenate([[0], np.cumsum(np.diff(bounds)[train])])

    return make


def training_symbols(source: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The symbols of all training texts, written once for all passes: a row for each run of texts."""
    sent = source.sparkSession.sparkContext.broadcast(lexicon)
    kind = np.uint16 if lexicon.symbols <= 1 << 16 else np.int32

    def code(batches):
        for run, _ in _runs(batches, RUN, _train_symbols(sent.value)):
            symbols, bounds = _joined(run)
            if len(bounds) > 1:
                yield pa.RecordBatch.from_arrays([pa.array([blob(symbols.astype(kind))], pa.binary()), pa.array([blob(np.diff(bounds).astype(np.int64))], pa.binary())], names=["symbols", "sizes"])

    small_batches(source.sparkSession)
    return keep(source.mapInArrow(code, "symbols binary, sizes binary"), "symbols")


def baum_welch(training: DataFrame, lexicon: Lexicon, model: Model) -> tuple[Model, float]:
    """One pass over all training texts: expected counts of each partition are added up. The next model, and the log10-likelihood a token under this one."""
    sent = training.sparkSession.sparkContext.broadcast(model)
    kind = np.uint16 if lexicon.symbols <= 1 << 16 else np.int32
    last = 1 + STATES + lexicon.symbols  # row of the likelihood and the number of tokens

    def count(batches):
        total, seen = None, np.zeros(STATES)
        for b in batches:
            for s, n in zip(column(b, "symbols"), column(b, "sizes")):
                symbols = np.frombuffer(s.as_py(), kind)
                new, likelihood = expected(symbols, np.concatenate([[0], np.cumsum(np.frombuffer(n.as_py(), np.int64))]), sent.value)
                total = new if total is None else tuple(a + b for a, b in zip(total, new))
                seen[:2] += likelihood, len(symbols)
        if total is not None:
            flat = np.concatenate([total[0][None], total[1], total[2], seen[None]])
            some = np.flatnonzero(flat.any(axis=1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(np.ascontiguousarray(flat[some, k])) for k in range(STATES))], names=["row", *(f"s{k}" for k in range(STATES))])

    small_batches(training.sparkSession)
    parts = training.mapInArrow(count, "row int, " + ", ".join(f"s{k} double" for k in range(STATES)))
    rows = parts.groupBy("row").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(STATES))).toPandas()  # TOP + CLASSES + STATES + 3 rows at most
    sent.destroy()
    flat = np.zeros((last + 1, STATES))
    flat[rows["row"].to_numpy(np.int64)] = rows[[f"s{k}" for k in range(STATES)]].to_numpy()
    return Model.of((flat[0], flat[1 : 1 + STATES], flat[1 + STATES : last]), lexicon.share), flat[last, 0] / max(1.0, flat[last, 1])


def train(source: DataFrame, lexicon: Lexicon, passes: int | None = None) -> tuple[Model, list[float]]:
    """Passes over all training texts, as many as said or until they converge: the model, and the log10-likelihood a token before each pass."""
    model, found = Model.first(lexicon.share), []
    training = training_symbols(source, lexicon)
    while passes is None or len(found) < passes:
        model, likelihood = baum_welch(training, lexicon, model)
        found.append(float(likelihood))
        if passes is None and len(found) > 1 and found[-1] - found[-2] < CONVERGED:
            break
    return model, found


def score(source: DataFrame, lexicon: Lexicon, model: Model) -> DataFrame:
    """Scores every text; counts of rare words come from their buckets, which hold those of the whole corpus."""
    spark = source.sparkSession
    n = partitions(source)
    key = keys(n).tolist()
    most = min(max(n * 8192, 400_000), 1_000_000)
    sent = spark.sparkContext.broadcast((lexicon, model))
    header = ["tokens", "known", "base", "score"]
    kind = dict(source.dtypes)["i"]
    arrow_id = pa.int64() if kind == "bigint" else pa.string()

    def make(p: Pieces, ids: list):
        lexicon = sent.value[0]
        symbol = lexicon.symbol(p)
        owner = p.owner
        m = len(ids)
        top = symbol < len(lexicon.count)
        base = np.bincount(owner[top], np.log10(lexicon.count[symbol[top]] + ADD), m) if len(lexicon.count) else np.zeros(m)
        base += np.log10(lexicon.ends + ADD)
        known = np.bincount(owner[top], minlength=m) + (lexicon.ends > 0)
        rest = np.flatnonzero(~top)
        given = -np.bincount(owner[rest], lexicon.rest_total[symbol[rest] - len(lexicon.count)], m)
        return with_ends(symbol, p, lexicon.symbols - 1), ids, base, known, given, p.hash[rest], owner[rest]

    def ask(batches):
        lexicon, model = sent.value
        for run, first in _runs(batches, most, make):
            symbols, bounds = _joined([x[0] for x in run])
            ids = [i for x in run for i in x[1]]
            base, known, given = (np.concatenate([x[k] for x in run]) for k in (2, 3, 4))
            before = np.cumsum([0, *(len(x[1]) for x in run)])
            h, doc = np.concatenate([x[5] for x in run]), np.concatenate([x[6] + b for x, b in zip(run, before)])
            exact = log_likelihood(symbols, bounds, model) + given
            tokens = np.diff(bounds)
            base = base - tokens * np.log10(lexicon.tokens + ADD * (lexicon.kinds + 1))
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(h))).astype(np.int32)
            h, doc = h[at], doc[at].astype(np.int32)
            count[np.array([held_out(i) for i in ids], bool)[doc]] *= -1  # counts of held-out texts teach nothing
            order, cut = deal(h, n)
            h, doc, count = h[order], doc[order], count[order]
            me = run_id(first)
            rows = []
            for k in range(n):
                s = slice(cut[k], cut[k + 1])
                if cut[k] == cut[k + 1] and k != me % n:
                    continue
                part = h[s]
                start = np.flatnonzero(np.concatenate([np.ones(min(1, len(part)), bool), part[1:] != part[:-1]]))
                row = (key[k], me, blob(part[start]), blob(np.diff(np.append(start, len(part))).astype(np.int32)), blob(doc[s]), blob(count[s]))
                rows.append((*row, *((ids, blob(tokens.astype(np.int64)), blob(known.astype(np.int64)), blob(base), blob(exact)) if k == me % n else (None,) * 5)))
            types = [pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.list_(arrow_id), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["bucket", "run", "h", "docs", "doc", "count", "ids", *header])

    def answer(got):
        rows = [r for b in got for r in b.to_pylist()]
        h = np.concatenate([np.frombuffer(r["h"], _U) for r in rows])
        docs = np.concatenate([np.frombuffer(r["docs"], np.int32) for r in rows])
        count = np.concatenate([np.frombuffer(r["count"], np.int32) for r in rows])
        _, word = np.unique(h, return_inverse=True)
        word = np.repeat(word, docs)
        c = np.bincount(word, np.maximum(count, 0))[word] if len(word) else np.empty(0)
        value, known = np.log10(c + ADD) * np.abs(count), np.where(c > 0, np.abs(count), 0)
        at = 0
        out = []
        for r in rows:
            doc = np.frombuffer(r["doc"], np.int32)
            s = slice(at, at + len(doc))
            at += len(doc)
            some, inverse = np.unique(doc, return_inverse=True)
            out.append((r["run"], blob(some), blob(np.bincount(inverse, value[s], len(some))), blob(np.bincount(inverse, known[s], len(some)).astype(np.int32)), r["ids"], *(r[x] for x in header)))
        types = [pa.int64(), *[pa.binary()] * 3, pa.list_(arrow_id), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["run", "doc", "value", "more", "ids", *header])

    def collect(got):
        head, parts = {}, {}
        for b in got:
            for r in b.to_pylist():
                if r["ids"] is not None:
                    head[r["run"]] = r
                parts.setdefault(r["run"], []).append((r["doc"], r["value"], r["more"]))
        for run, r in head.items():
            tokens, known = np.frombuffer(r["tokens"], np.int64), np.frombuffer(r["known"], np.int64).copy()
            base, exact = np.frombuffer(r["base"]).copy(), np.frombuffer(r["score"]).copy()
            for doc, value, more in parts[run]:
                d, v = np.frombuffer(doc, np.int32), np.frombuffer(value)
                base[d] += v
                exact[d] += v
                known[d] += np.frombuffer(more, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["ids"], arrow_id), pa.array([held_out(i) for i in r["ids"]]), pa.array(tokens), pa.array(known), pa.array(np.full(len(tokens), lexicon.tokens, np.int64)), pa.array(base), pa.array(exact)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    small_batches(spark)
    blobs = "tokens binary, known binary, base binary, score binary"
    asks = source.mapInArrow(ask, f"bucket int, run long, h binary, docs binary, doc binary, count binary, ids array<{kind}>, {blobs}")
    answers = whole_partitions(to_buckets(asks, n), answer, f"run long, doc binary, value binary, more binary, ids array<{kind}>, {blobs}")
    return whole_partitions(answers.repartition(n, "run"), collect, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def language_model_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", passes: int | None = None) -> DataFrame:
    """Learns the model from the texts that are not held out and scores all of them; the fold is that of the id as text."""
    name = F.col(doc_id).cast("long" if is_whole(docs, doc_id) else "string")
    source = settled(docs.select(name.alias("i"), F.col(text).alias("t")))
    lexicon = learn_lexicon(source)
    model, _ = train(source, lexicon, passes)
    scored = score(source, lexicon, model)
    return scored.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType)) if not is_whole(docs, doc_id) else scored


def op3_hmm(spark, sf_dir: str) -> DataFrame:
    """Per document: the base score of its words and the model's log10 probability of its text."""
    return language_model_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
