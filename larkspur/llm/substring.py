"""Substring dedup by seed and extend.

A window is WINDOW consecutive words of one document. Winnowing takes, of every window,
the 7-word gram of least hash as its anchor, so documents that share a window share its
anchor.
1. Anchors are counted over the corpus; those of two documents or more are seeds, kept
   as a Bloom filter of bounded size.
2. Documents are joined on seeds: each seed is extended both ways to the windows that
   it anchors, and each such window is held against the least document that has it.
   Within a run of documents this is settled at once, and only the least document of
   the run asks further, so a passage that many documents share costs one row a run.
3. Windows found in an earlier document that follow each other make a maximal repeat;
   the words that these cover are removed.

Cases: a null or empty text has no words; a text of fewer words than a window keeps
all; a window that recurs only in its own document stays; rows that repeat an id, with
equal texts or other ones, are one document to each other, so neither removes from the
other, and each loses what its own text repeats; a row with a null id neither removes nor
is removed from; ids that are not whole numbers are compared in their order. Windows are
equal if their 64-bit hashes are; all are judged on the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import bloom
from larkspur.llm.arrowmap import BATCH_ROWS, column, map_arrow, small_batches
from larkspur.llm.exchange import blob, deal, keys, partitions, size_of, to_buckets, whole_partitions
from larkspur.llm.shared import is_whole, named, numbered
from larkspur.llm.textvec import SPACED, Pieces, buffers, grams_within, mix, pieces, spans

WINDOW, GRAM = 13, 7
#: Least bits of the filter of seeds (16 MB); a larger input has more of them, up to the filters' bound.
SEED_BITS = 1 << 27
_U = np.uint64


def anchors_of(g: np.ndarray, first: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For every `span` consecutive grams of one text: the position in g of the last of least hash, and the first word."""
    m = len(g) - span + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    whole = first[span - 1 :] - first[:m] == span - 1  # else they are of two texts
    best, at = g[:m].copy(), np.arange(m)
    for j in range(1, span):
        less = g[j : j + m] <= best
        best = np.where(less, g[j : j + m], best)
        at = np.where(less, np.arange(j, j + m), at)
    return at[whole], first[:m][whole]


def anchored(p: Pieces, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: its hash, its first word, and its anchor's hash."""
    w, start = grams_within(p, window)
    g, first = grams_within(p, gram)
    at, begin = anchors_of(g, first, window - gram + 1)
    assert len(begin) == len(start)
    return w, start, g[at]


class Seeds:
    """A filter of anchors, cut into a slice for each bucket of hashes."""

    def __init__(self, words: np.ndarray, n: int):
        self.words, self.n = words, n
        self.width = len(words) * 64 // n

    @staticmethod
    def places(low: np.ndarray, width: int) -> list[np.ndarray]:
        """Bits within a slice of a value's lower half."""
        x = mix(low.astype(_U))
        return [((x >> _U(s)) & _U(0xFFFFFFFF)) % _U(width) for s in (0, 32)]

    def has(self, anchor: np.ndarray) -> np.ndarray:
        base = ((anchor >> _U(32)) % _U(self.n)) * _U(self.width)
        out = np.ones(len(anchor), bool)
        for at in self.places(anchor & _U(0xFFFFFFFF), self.width):
            at = at + base
            out &= (self.words[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) == 1
        return out


def _runs(batches: Iterator[pa.RecordBatch], make, most: int) -> Iterator[list]:
    """Lists of make(pieces, ids, hashes of texts) of consecutive documents with about `most` words together."""
    held, n = [], 0
    for b in batches:
        data, at = buffers(column(b, "t"))
        ids, x = (column(b, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("i", "x"))
        for lo, hi in spans(at):
            p = pieces(data[at[lo] : at[hi]], at[lo : hi + 1], SPACED)
            held.append(make(p, ids[lo:hi], x[lo:hi]))
            n += len(p.hash)
            if n >= most:
                yield held
                held, n = [], 0
    if held:
        yield held


def seed_bits(docs: DataFrame) -> int:
    """Bits of the filter for an input of this size: about one for 16 bytes of files, within bounds."""
    size = size_of(docs)
    return max(SEED_BITS, bloom.bits_for(size // 256) if size else SEED_BITS)


def seeds(source: DataFrame, n: int, window: int, gram: int, bits: int = SEED_BITS) -> Seeds:
    """The anchors that two documents or more have."""
    key = keys(n).tolist()
    most = min(max(n * 4096, 200_000), 2_000_000)

    def make(p: Pieces, ids: np.ndarray, _):
        _, start, anchor = anchored(p, window, gram)
        return anchor, ids[np.searchsorted(p.hi, start, side="right")]

    def ask(batches):
        for run in _runs(batches, make, most):
            a, doc = (np.concatenate(x) for x in zip(*run))
            order = np.lexsort((doc, a))
            a, doc = a[order], doc[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
            a, doc = a[new], doc[new]
            first = np.ones(len(a), bool)
            first[1:] = a[1:] != a[:-1]
            at = np.flatnonzero(first)
            count = np.diff(np.append(at, len(a)))
            once, twice = a[at[count == 1]], a[at[count > 1]]
            order, cut = deal(once, n)
            once = once[order].astype(np.uint32)
            order, cut2 = deal(twice, n)
            twice = twice[order].astype(np.uint32)
            rows = [(key[k], k, blob(once[cut[k] : cut[k + 1]]), blob(twice[cut2[k] : cut2[k + 1]])) for k in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32(), pa.int32(), pa.binary(), pa.binary()])], names=["bucket", "k", "once", "twice"])

    def answer(got: list[pa.RecordBatch]):
        by: dict[int, list[tuple[bytes, bytes]]] = {}
        for b in got:
            for k, once, twice in zip(column(b, "k").to_pylist(), column(b, "once").to_pylist(), column(b, "twice").to_pylist()):
                by.setdefault(k, []).append((once, twice))
        width = bits // n // 64 * 64
        for k, rows in by.items():
            once = np.sort(np.frombuffer(b"".join(r[0] for r in rows), np.uint32))
            more = once[1:][once[1:] == once[:-1]]  # of two runs; documents that share an id may be among them, which costs work only
            twice = np.frombuffer(b"".join(r[1] for r in rows), np.uint32)
            two = np.unique(np.concatenate([more, twice, np.intersect1d(once, twice)]))
            bit = np.zeros(width, bool)
            for at in Seeds.places(two, width):
                bit[at.astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob(np.packbits(bit, bitorder="little"))], pa.binary())], names=["k", "bits"])

    small_batches(source.sparkSession)
    asks = source.mapInArrow(ask, "bucket int, k int, once binary, twice binary")
    slices = whole_partitions(to_buckets(asks, n), answer, "k int, bits binary").toPandas()  # `bits` in all, which are bounded
    width = bits // n // 64 * 64
    words = np.zeros(n * width // 64, _U)
    for k, b in zip(slices["k"], slices["bits"]):
        words[k * width // 64 : (k + 1) * width // 64] = np.frombuffer(b, _U)
    return Seeds(words, n)


def _packed(doc: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """An order by row (its id and the hash of its text), and each row with its count, as bytes."""
    order = np.lexsort((x, doc))
    doc, x = doc[order], x[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (x[1:] != x[:-1])
    first = np.flatnonzero(new)
    return order, [blob(doc[first]), blob(x[first]), blob(np.diff(np.append(first, len(doc))).astype(np.int32))]


def _unpacked(got: list[pa.RecordBatch], *names: str) -> tuple[np.ndarray, np.ndarray]:
    doc, x, n = (np.frombuffer(b"".join(v for b in got for v in column(b, c).to_pylist()), t) for c, t in zip(names, (np.int64, np.int64, np.int32)))
    return np.repeat(doc, n), np.repeat(x, n)


def _numbers(got: list[pa.RecordBatch], name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(v for b in got for v in column(b, name).to_pylist()), kind)


def repeats(source: DataFrame, found: Seeds, window: int, gram: int) -> DataFrame:
    """For each row with any: doc, x (the hash of its text), starts (first words of windows that a document of smaller id has)."""
    spark = source.sparkSession
    n = found.n
    key = keys(n).tolist()
    most = min(max(n * 4096, 200_000), 1_000_000)
    sent = spark.sparkContext.broadcast(found)
    rows_of = lambda names: [f"{c} binary" for c in names]
    asked, settled_, told = ["doc", "x", "n", "h", "at"], ["doc2", "x2", "n2", "at2"], ["doc", "x", "n", "at"]

    def make(p: Pieces, ids: np.ndarray, x: np.ndarray):
        w, start, anchor = anchored(p, window, gram)
        some = sent.value.has(anchor)
        w, start = w[some], start[some]
        owner = np.searchsorted(p.hi, start, side="right")
        return w, ids[owner], x[owner], (start - p.lo[owner]).astype(np.int32)

    def by_row(doc: np.ndarray, x: np.ndarray, *rest: np.ndarray) -> list[bytes]:
        order, head = _packed(doc, x)
        return [*head, *(blob(v[order]) for v in rest)]

    def to_rows(doc: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of rows: those of one id are spread, too."""
        return deal(mix(doc.view(_U) ^ mix(x.view(_U))), n)

    def ask(batches):
        for run in _runs(batches, make, most):
            h, doc, x, at = (np.concatenate(v) for v in zip(*run))
            order = np.lexsort((doc, h))
            h, doc, x, at = h[order], doc[order], x[order], at[order]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            least = doc[np.flatnonzero(first)][np.cumsum(first) - 1] if len(h) else doc
            done = doc > least  # an earlier document of this run has it
            order, cut = deal(h[~done], n)
            h, doc1, x1, at1 = h[~done][order], doc[~done][order], x[~done][order], at[~done][order]
            order, cut2 = to_rows(doc[done], x[done])
            doc2, x2, at2 = doc[done][order], x[done][order], at[done][order]
            rows = [
                (key[k], *by_row(doc1[s], x1[s], h[s], at1[s]), *by_row(doc2[z], x2[z], at2[z]))
                for k in range(n)
                for s, z in [(slice(cut[k], cut[k + 1]), slice(cut2[k], cut2[k + 1]))]
                if cut[k] < cut[k + 1] or cut2[k] < cut2[k + 1]
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 9])], names=["bucket", *asked, *settled_])

    def answer(got: list[pa.RecordBatch]):
        (doc, x), h, at = _unpacked(got, "doc", "x", "n"), _numbers(got, "h", _U), _numbers(got, "at", np.int32)
        order = np.lexsort((doc, h))
        h, doc, x, at = h[order], doc[order], x[order], at[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        later = doc > (doc[np.flatnonzero(first)][np.cumsum(first) - 1] if len(h) else doc)
        doc2, x2 = _unpacked(got, "doc2", "x2", "n2")
        doc, x, at = np.concatenate([doc[later], doc2]), np.concatenate([x[later], x2]), np.concatenate([at[later], _numbers(got, "at2", np.int32)])
        order, cut = to_rows(doc, x)
        doc, x, at = doc[order], x[order], at[order]
        rows = [(key[k], *by_row(doc[s], x[s], at[s])) for k in range(n) for s in [slice(cut[k], cut[k + 1])] if cut[k] < cut[k + 1]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 4])], names=["bucket", *told])

    def collect(got: list[pa.RecordBatch]):
        (doc, x), at = _unpacked(got, "doc", "x", "n"), _numbers(got, "at", np.int32)
        order = np.lexsort((at, x, doc))
        doc, x, at = doc[order], x[order], at[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (x[1:] != x[:-1])
        first = np.flatnonzero(new)
        cut = np.append(first, len(doc))
        for lo in range(0, len(first), BATCH_ROWS):
            hi = min(lo + BATCH_ROWS, len(first))
            starts = pa.ListArray.from_arrays(pa.array((cut[lo : hi + 1] - cut[lo]).astype(np.int32)), pa.array(at[cut[lo] : cut[hi]]))
            yield pa.RecordBatch.from_arrays([pa.array(doc[first[lo:hi]]), pa.array(x[first[lo:hi]]), starts], names=["doc", "x", "starts"])

    small_batches(spark)
    asks = source.mapInArrow(ask, ", ".join(["bucket int", *rows_of([*asked, *settled_])]))
    answers = whole_partitions(to_buckets(asks, n), answer, ", ".join(["bucket int", *rows_of(told)]))
    return whole_partitions(to_buckets(answers, n), collect, "doc long, x long, starts array<int>")


def removed_ranges(docs: DataFrame, doc_id: str, text: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """For each row with repeats: doc, x (the hash of its text), starts (the first words of its repeated windows)."""
    source = docs.select(F.col(doc_id).cast("long").alias("i"), F.xxhash64(text).alias("x"), F.col(text).alias("t")).where("i is not null and t is not null")
    found = seeds(source, partitions(docs), window, gram, seed_bits(docs))
    return repeats(source, found, window, gram)


def maximal_repeats(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Windows by their first words as maximal word ranges."""
    s = np.unique(starts)
    if not len(s):
        return []
    gap = np.flatnonzero(np.diff(s) > window)  # windows that meet make one range
    return list(zip(s[np.append(0, gap + 1)].tolist(), (s[np.append(gap, len(s) - 1)] + window).tolist()))


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """For each document: the id, n_words, repeats (maximal ranges of words, removed), and the kept words joined by a space."""
    if not is_whole(docs, doc_id):
        rows, ranks = numbered(docs, doc_id, text)
        return named(dedup_substrings(rows, "_id", "_text", window, gram), ranks, _id=doc_id)
    gone = removed_ranges(docs, doc_id, text, window, gram)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(doc_id).cast("long").alias("_i"), F.xxhash64(text).alias("_x"))
    joined = rows.join(gone, (F.col("_i") == F.col("doc")) & (F.col("_x") == F.col("x")), "left").select("_id", "_text", "starts")
    kind = dict(docs.dtypes)[doc_id]

    def run(batch: pa.RecordBatch):
        data, at = buffers(column(batch, "_text"))
        ids, starts = column(batch, "_id"), column(batch, "starts")
        for lo, hi in spans(at):
            p = pieces(data[at[lo] : at[hi]], at[lo : hi + 1], SPACED)
            words, cut, kept = [], [], []
            for i in range(hi - lo):
                n = int(p.hi[i] - p.lo[i])
                ranges = maximal_repeats(starts[lo + i].values.to_numpy(), window) if starts[lo + i].is_valid else []
                raw = p.data[p.begin[i] : p.end[i]].tobytes()
                if ranges:
                    a, b = (x[p.lo[i] : p.hi[i]] - p.begin[i] for x in (p.start, p.stop))
                    parts, k = [], 0
                    for x, y in [*ranges, (n, n)]:
                        if x > k:
                            parts.append(raw[a[k] : b[x - 1]])
                        k = y
                    raw = b" ".join(parts)
                words.append(n)
                cut.append([{"start": x, "stop": y} for x, y in ranges])
                kept.append(b" ".join(raw.split()))  # at the six bytes of white space that SPACED names
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(words, pa.int64()), pa.array(cut, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string())], names=[doc_id, "n_words", "repeats", "kept"]
            )

    return map_arrow(joined, run, f"`{doc_id}` {kind}, n_words long, repeats array<struct<start:long,stop:long>>, kept string")


def op5_substrings(spark, sf_dir: str) -> DataFrame:
    """Per document: words, words removed as repeats of earlier documents, and a digest of the words kept."""
    done = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda s, r: s + r.stop - r.start)
    return done.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE doc_id IS NOT NULL AND len(w) > 12)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
gone AS (SELECT DISTINCT r, i + k AS j FROM (SELECT r, i FROM g JOIN f USING (g) WHERE doc_id > first), range(13) t(k)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS text FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) ANTI JOIN gone USING (r, j) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
"""
