"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each text (byte classes, words, repeats, lines) are computed with numpy
from Arrow buffers. Trees are complete, of one depth, so a forest is four arrays that
all rows walk together. Trees are fitted on the driver from the statistics of at most
MAX_TRAIN labelled rows, those of least hash; every document is scored.

Cases: a null or empty text has statistics of zero and is scored like any other;
repeated rows each get a score; labels that are null or whose document is missing
teach nothing, and repeated labels, or rows that repeat a labelled id, each count, up to
the bound; with no labels, or labels of one kind,
the score is constant (their share, or 0.5). Labels, language, source and id are not
inputs. Only the id and the text are read unless `carry` names more columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrowmap import column, map_arrow
from larkspur.llm.textvec import ALNUM, LINE, SPACED, Pieces, buffers, pieces, spans

#: Bound on the labelled rows that trees are fitted on.
MAX_TRAIN = 20_000
BINS, DEPTH, ROUNDS, RATE, LEAST_WEIGHT, RIDGE = 64, 4, 80, 0.15, 2.0, 1.0

_CLASSES = np.zeros((256, 12), np.float64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!?", b"'\"()-", b"#$%&*@^~+=<>|\\/_{}[]`", b"|")):
    _CLASSES[list(_chars), _k] = 1
_CLASSES[128:, 11] = 1


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each text."""
    parts = [np.empty((0, 0))]
    parts = [_of(pieces(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1], SPACED, fold=True), pieces(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1], LINE)) for lo, hi in spans(offsets)]
    return np.concatenate(parts) if parts else np.empty((0, 32))


def _mean(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return total / np.maximum(n, 1)


def _by_text(values: np.ndarray, p: Pieces) -> np.ndarray:
    """Sums of a value of each piece over the pieces of each text."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[p.hi] - total[p.lo]


def _repeats(p: Pieces, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text: distinct pieces, and the count of its most frequent piece."""
    n = len(p.lo)
    order = np.lexsort((p.hash, owner))
    h, o = p.hash[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(h)))
    most = np.zeros(n)
    np.maximum.at(most, o[at], run)
    return np.bincount(o[at], minlength=n).astype(np.float64), most


def _of(p: Pieces, lines: Pieces) -> np.ndarray:
    n = len(p.lo)
    hist = np.zeros((n, 256))
    for i in range(n):
        if p.end[i] > p.begin[i]:
            hist[i] = np.bincount(p.data[p.begin[i] : p.end[i]], minlength=256)
    size = hist.sum(axis=1)
    share = hist @ _CLASSES / np.maximum(size, 1)[:, None]
    q = hist / np.maximum(size, 1)[:, None]
    entropy = -(q * np.log2(np.where(q > 0, q, 1))).sum(axis=1)
    owner = p.owner
    words = (p.hi - p.lo).astype(np.float64)
    length = (p.stop - p.start).astype(np.float64)
    mean = _mean(_by_text(length, p), words)
    spread = np.sqrt(np.maximum(0, _mean(_by_text(length**2, p), words) - mean**2))
    distinct, most = _repeats(p, owner)
    first, last = (p.data[p.start], p.data[p.stop - 1]) if len(p.start) else (np.empty(0, np.uint8),) * 2
    ends = _mean(_by_text(np.isin(last, list(b".!?")), p), words)
    odd = _mean(_by_text(~ALNUM[last] & ~np.isin(last, list(b".,;:!?)\"'")), p), words)
    upper = _mean(_by_text((first >= 65) & (first <= 90), p), words)
    digit = _mean(_by_text((first >= 48) & (first <= 57), p), words)
    short = _mean(_by_text(length <= 3, p), words)
    long = _mean(_by_text(length >= 16, p), words)
    pair = np.zeros(len(p.hash), bool)
    if len(p.hash):
        pair[1:] = (p.hash[1:] == p.hash[:-1]) & (owner[1:] == owner[:-1])
    twice = _mean(_by_text(pair, p), words)
    number = (lines.hi - lines.lo).astype(np.float64)
    line_kinds, _ = _repeats(lines, lines.owner)
    width = _mean(_by_text((lines.stop - lines.start).astype(np.float64), lines), number)
    return np.column_stack([np.log1p(size), share, entropy, np.log1p(words), mean, spread, _mean(distinct, words), _mean(most, words), ends, odd, upper, digit, short, long, twice, np.log1p(number), _mean(line_kinds, number), np.log1p(width)])


@dataclass
class Forest:
    """Complete trees: node k of a level has children 2k and 2k+1; a value above its threshold goes right."""

    feature: np.ndarray  # tree x inner node
    threshold: np.ndarray
    leaf: np.ndarray  # tree x leaf
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (leaf.size - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosts trees of log loss over histograms of at most BINS bins a statistic."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        share = min(max(share, 0.01), 0.99)
        return Forest(np.empty((0, 0), int), np.empty((0, 0)), np.empty((0, 0)), float(np.log(share / (1 - share))))
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS, method="nearest")) for j in range(m)]
    code = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    start = float(np.log(share / (1 - share)))
    margin = np.full(n, start)
    features, thresholds, values = [], [], []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold, cut = np.zeros(inner, int), np.full(inner, np.inf), np.full(inner, BINS, int)
        node = np.zeros(n, int)
        for level in range(DEPTH):
            width, base = 2**level, 2**level - 1
            best = np.full(width, 1e-6)
            local = node - base
            for j in range(m):
                key = local * BINS + code[:, j]
                gs = np.cumsum(np.bincount(key, g, width * BINS).reshape(width, BINS), axis=1)
                hs = np.cumsum(np.bincount(key, h, width * BINS).reshape(width, BINS), axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hs < LEAST_WEIGHT) | (ht - hs < LEAST_WEIGHT)] = -1
                gain[:, len(edges[j]) :] = -1
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                for k in np.flatnonzero(top > best):
                    best[k], feature[base + k], cut[base + k], threshold[base + k] = top[k], j, at[k], edges[j][at[k]]
            node = 2 * node + 1 + (code[np.arange(n), feature[node]] > cut[node])
        at = node - inner
        leaf = -RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + RIDGE)
        margin += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        values.append(leaf)
    return Forest(np.array(features), np.array(thresholds), np.array(values), start)


def _rows(docs: DataFrame, names: list[str], text: str, result: str, made) -> DataFrame:
    own = [f"`{c}` {t}" for c, t in docs.dtypes if c in names]
    new = [x.split()[0] for x in result.split(", ")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(*buffers(column(batch, text)))
        return pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), *made(x)], names=[*names, *new])

    return map_arrow(docs.select(*dict.fromkeys([*names, text])), run, ", ".join([*own, result]))


def learn(docs: DataFrame, labels: DataFrame, train_if=None, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_TRAIN) -> Forest:
    """Trees fitted on at most `most` labelled rows for which the condition train_if on the id holds."""
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("_y")).where("_id is not null and _y is not null")
    if train_if is not None:
        known = known.where(train_if(F.col("_id")))
    # a share of the labels of a little more than `most`, so that no more of them meet in the task that takes the first
    share = min(1.0, 1.2 * most / max(1, known.count()))
    known = known.where(F.shiftrightunsigned(F.xxhash64("_id"), 11) <= int(share * 2**53)).orderBy(F.xxhash64("_id"), "_id", "_y").limit(most)  # bounded, so it may be broadcast
    taught = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(known), "_id")
    rows = _rows(taught, ["_id", "_y"], "_text", "x array<double>", lambda x: (pa.array(list(x), pa.list_(pa.float64())),))
    # ids that repeat may match more rows than there are labels
    got = rows.orderBy(F.xxhash64("_id"), "_id", "_y", F.xxhash64("x")).limit(most).toPandas()
    if not len(got):
        return fit(np.empty((0, 1)), np.empty(0))
    return fit(np.stack(got["x"].to_list()), (got["_y"].to_numpy() > 0.5).astype(float))


def score(docs: DataFrame, forest: Forest, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The score of each document; higher is better."""
    names = [c for c in docs.columns if c in {doc_id, *carry} and c != "score"]
    return _rows(docs, names, text, "score double", lambda x: (pa.array(forest.score(x) if len(x) else [], pa.float64()),))


def third(doc_id) -> F.Column:
    """The fold of a document: its checksum's remainder by 3; that of 1 is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Per document: whether it is held out, its score, and the label that the score predicts."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    forest = learn(docs, labels, lambda i: third(i) != 1)
    return score(docs, forest).select("doc_id", (third(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
