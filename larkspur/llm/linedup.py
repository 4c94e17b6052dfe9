"""Line dedup by pairwise patience alignment.

Lines are hashed. An aligned block, a run of lines consecutive in both, of at least
LEAST_CHARS bytes is deleted from the later document. So only documents that share a run
that reaches LEAST_CHARS can lose lines to each other: the shortest such runs from each line
on and up to each line are hashed, and a pair is aligned by patience diff (lines unique in
both, in their longest increasing order, then matches grown outward and recursively
between). The result is that of the alignments with all earlier documents; those that cannot
change it are left out:

1. A later document is aligned with the owner (of least id) of each run that it shares.
2. While a shared run of it has a line left, it is aligned with the run's other earlier
   holders, in rounds of GROWTH times as many, until the line goes or all were tried. Here
   holders that differ only in lines that no document left has are one, of least id.

Documents of the same lines are one class: those of later ids are aligned in full with the
first, and set aside before pairing; the class goes on as one, by the least id.

Cases: a null or empty text has no lines and stays; lines are compared byte for byte;
empty lines are not counted and go with the line before them; rows that repeat an id, with
equal texts or other ones, are one document to each other, so neither loses lines to the
other, and each loses what its own text shares with earlier ids; a row with a null id is
compared with nothing and stays; ids may be of any type that has an order; texts are read
whole.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import bloom
from larkspur.llm.arrowmap import column, map_arrow
from larkspur.llm.shared import fresh, keep
from larkspur.llm.textvec import LINE, buffers, pieces, spans

#: Bytes of an aligned block that is deleted.
LEAST_CHARS = 40
#: Later documents aligned with one owner in one row group.
SALT_ROWS = 1000
#: Pairs aligned by one task that writes one file.
FILE_PAIRS = 2000
#: Documents' lines in one file.
FILE_DOCS = 2000
#: Holders of a run in the first round after its owner, and the factor from round to round.
GROWTH = 16


def _line_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """For each row, known by its id i and the hash x of its text, the hashes and sizes of its lines."""

    def run(batch: pa.RecordBatch):
        data, at = buffers(column(batch, "t"))
        ids, texts = column(batch, "i"), column(batch, "x")
        for lo, hi in spans(at):
            p = pieces(data[at[lo] : at[hi]], at[lo : hi + 1], LINE)
            cuts = pa.array(np.append(p.lo, len(p.hash)).astype(np.int32))
            h = pa.ListArray.from_arrays(cuts, pa.array(p.hash.view(np.int64)))
            n = pa.ListArray.from_arrays(cuts, pa.array((p.stop - p.start).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), texts.slice(lo, hi - lo), h, n], names=["i", "x", "h", "n"])

    rows = docs.select(F.col(doc_id).alias("i"), F.xxhash64(text).alias("x"), F.col(text).alias("t"))
    return map_arrow(rows, run, f"i {dict(rows.dtypes)['i']}, x long, h array<long>, n array<int>")


def unique_matches(a: list[int], b: list[int], alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """Lines that are unique in both ranges, in their longest order that increases in both."""
    where: dict[int, int] = {}
    for i in range(alo, ahi):
        where[a[i]] = -1 if a[i] in where else i
    there: dict[int, int] = {}
    for j in range(blo, bhi):
        there[b[j]] = -1 if b[j] in there else j
    both = [(i, j) for h, i in where.items() if i >= 0 and (j := there.get(h, -1)) >= 0]  # by position in a
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(both)
    for k, (_, j) in enumerate(both):
        x = bisect_left(tails, j)
        before[k] = ends[x - 1] if x else -1
        if x == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[x], ends[x] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(both[k])
        k = before[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of a and b, both increasing."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        alo, ahi, blo, bhi = work.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        i, j = alo, blo
        anchors = unique_matches(a, b, alo, ahi, blo, bhi)
        for x, y in anchors:
            out.append((x, y))
            work.append((i, x, j, y))
            i, j = x + 1, y + 1
        if anchors:
            work.append((i, ahi, j, bhi))
    return sorted(out)


def aligned_lines(later: list[int], owner: list[int], size: list[int], least: int = LEAST_CHARS) -> list[int]:
    """Positions in `later` of the lines in aligned blocks of at least `least` bytes."""
    out: list[int] = []
    block: list[int] = []
    last = None
    for i, j in [*patience(later, owner), (-9, -9)]:
        if last is not None and (i, j) == (last[0] + 1, last[1] + 1):
            block.append(i)
        else:
            if sum(size[k] for k in block) >= least:
                out += block
            block = [i]
        last = (i, j)
    return out


def runs(h: list[int], n: list[int], least: int = LEAST_CHARS) -> set[tuple[int, int, int]]:
    """The shortest runs of at least `least` bytes from each line on and up to each line: hash and bounds. Any line of a longer run is in one of these within it."""
    bounds = set()
    stop = size = 0
    for start in range(len(h)):
        while stop < len(h) and (size < least or stop == start):
            size, stop = size + n[stop], stop + 1
        if size < least:
            break
        bounds.add((start, stop))
        size -= n[start]
    start = size = 0
    for stop in range(1, len(h) + 1):
        size += n[stop - 1]
        while start < stop - 1 and size - n[start] >= least:
            size, start = size - n[start], start + 1
        if size >= least:
            bounds.add((start, stop))
    return {(hash(tuple(h[a:b])), a, b) for a, b in bounds}


def squeezed(at: list[int], h: list[int], lines: int) -> list[int]:
    """Lines h at the positions `at` of a text of so many, with one 0 for each stretch of others."""
    out, last = [], -1
    for k, x in zip(at, h):
        out += [x] if k == last + 1 else [0, x]
        last = k
    return out if last + 1 == lines else [*out, 0]


def _aligned(linked: DataFrame, later: DataFrame, owners: DataFrame, least: int) -> DataFrame:
    """id and gone of the pairs (id, owner); later has id, h, n, owners have owner, oh (of an owner's id there may be several)."""
    # an owner of many is copied for every SALT_ROWS of its pairs
    salts = linked.groupBy("owner").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    copies = salts.join(owners, "owner").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    dealt = linked.join(later.select("id", "h", "n"), "id").join(salts, "owner").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts").cast("long")).cast("int")).drop("salts")
    pairs = dealt.join(copies.select("owner", "salt", "oh"), ["owner", "salt"]).select("id", "h", "n", "oh")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        gone = [aligned_lines(h, oh, n, least) for h, oh, n in zip(*(column(batch, c).to_pylist() for c in ("h", "oh", "n")))]
        return pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(gone, pa.list_(pa.int32()))], names=["id", "gone"])

    return map_arrow(pairs, run, "id long, gone array<int>").where("size(gone) > 0")


def _united(cut: DataFrame) -> DataFrame:
    return cut.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def _runs_left(ones: DataFrame, least: int) -> DataFrame:
    """id, i and hash of the runs of classes (id, i, h, n, gone) that have a line left; each once."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, out = [], []
        for k, (h, n, gone) in enumerate(zip(*(column(batch, c).to_pylist() for c in ("h", "n", "gone")))):
            gone = set(gone or ())
            some = {x for x, start, stop in runs(h, n, least) if not gone.issuperset(range(start, stop))}
            at += [k] * len(some)
            out += some
        rows = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([column(batch, "id").take(rows), column(batch, "i").take(rows), pa.array(out, pa.int64())], names=["id", "i", "run"])

    return map_arrow(ones.select("id", "i", "h", "n", "gone"), run, f"id long, i {dict(ones.dtypes)['i']}, run long")


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """For each row with something to delete: i (its id), x (the hash of its text) and the positions of those lines, counted without empty ones."""
    lines = keep(_line_rows(docs.where(F.col(doc_id).isNotNull()), doc_id, text).where("size(h) > 0"), "lines")
    key, most = ["k0", "k1", "k2"], lines.count()
    lines = lines.select("*", F.size("h").alias("k0"), F.xxhash64("h").alias("k1"), F.xxhash64(F.lit(7), "h").alias("k2"))
    # written with their numbers, so that all readers see the same
    classes = keep(lines.groupBy(*key).agg(F.min("i").alias("first")).withColumn("id", F.monotonically_increasing_id()), "classes", most)
    classed = keep(lines.join(classes, key).drop(*key), "classed", most, FILE_DOCS)
    same = classed.where(f"i > first and aggregate(n, 0L, (s, x) -> s + x) >= {least}").select("i", "x", F.sequence(F.lit(0), F.size("h") - 1).alias("gone"))
    ones = keep(classed.where("i = first").dropDuplicates(["id"]).select("id", "i", "h", "n"), "ones", most, FILE_DOCS)

    each = keep(_runs_left(ones.withColumn("gone", F.lit(None).cast("array<int>")), least), "runs")
    # written, so that the join below reads both sides by its own shuffles, which Spark splits where one run has very many rows
    owned = keep(each.groupBy("run").agg(F.min("i").alias("owner"), F.count(F.lit(1)).alias("df")).where("df > 1"), "owned", n_runs := each.count())
    shared = keep(each.join(owned, "run").where("i > owner"), "shared", n_runs)
    linked = keep(shared.select("id", "owner").distinct(), "pairs", shared.count())
    cut = keep(_aligned(linked, ones, ones.select(F.col("i").alias("owner"), F.col("h").alias("oh")), least), "cut", linked.count(), FILE_PAIRS)

    # runs that others than the owner hold before the document, and of which a line is left
    some = shared.where("df > 2").select("id", "run")
    left = _runs_left(ones.join(some.select("id").distinct(), "id", "left_semi").join(_united(cut), "id", "left"), least)
    left = keep(left.join(some, ["id", "run"], "left_semi"), "left", shared.count())
    if not left.isEmpty():
        cut = _other_holders(ones, each, left, cut, least)
    rows = classed.where("i = first").select("i", "x", "id").join(_united(cut), "id").select("i", "x", "gone")
    return rows.unionByName(same).dropDuplicates(["i", "x"])


def _other_holders(ones: DataFrame, each: DataFrame, left: DataFrame, cut: DataFrame, least: int) -> DataFrame:
    """cut, and what alignments with the other earlier holders of the runs that are left delete."""
    texts = keep(ones.join(left.select("id").distinct(), "id", "left_semi"), "texts")
    held = keep(each.join(left.select("run").distinct(), "run", "left_semi").select("run", F.col("i").alias("owner")), "held")
    known = keep(texts.select(F.explode("h").alias("line")).distinct(), "known")
    holders = ones.withColumnRenamed("i", "owner").join(held.select("owner").distinct(), "owner", "left_semi")
    places = keep(holders.select("owner", F.xxhash64("h").alias("x"), F.size("h").alias("lines"), F.posexplode("h").alias("at", "line")), "places").join(known, "line")
    places = places.groupBy("owner", "x", "lines").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("some"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        some = zip(*(column(batch, c).to_pylist() for c in ("at", "line", "lines")))
        return pa.RecordBatch.from_arrays([column(batch, "owner"), pa.array([squeezed(*x) for x in some], pa.list_(pa.int64()))], names=["owner", "oh"])

    short = map_arrow(places.select("owner", F.col("some.at").alias("at"), F.col("some.line").alias("line"), "lines"), run, f"owner {dict(ones.dtypes)['i']}, oh array<long>")
    owners = keep(short.groupBy("oh").agg(F.min("owner").alias("owner")), "owners")
    # holders of a run in an order of their hashes, by about how many are before each
    held = keep(held.join(owners.select("owner").distinct(), "owner", "left_semi"), "holders")
    count = held.groupBy("run").agg(F.count(F.lit(1)).alias("count"))
    order = F.shiftrightunsigned(F.xxhash64("owner", "run"), 11) / F.lit(2.0**53) * F.col("count")
    held = keep(held.join(count, "run").select("run", "owner", order.alias("order"), "count"), "holders")
    most = held.agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    begin, end = 0, GROWTH
    while begin < most and not left.isEmpty():
        now = held.where((F.col("order") >= begin) & (F.col("order") < end))
        linked = keep(left.join(now, "run").where("owner < i").select("id", "owner").distinct(), "pairs", left.count() * GROWTH)
        cut = cut.unionByName(keep(_aligned(linked, texts, owners, least), "cut", linked.count(), FILE_PAIRS))
        gone = _united(cut.join(left.select("id").distinct(), "id", "left_semi"))
        left = keep(_runs_left(texts.join(gone, "id"), least).join(left, ["id", "run"], "left_semi").unionByName(left.join(gone, "id", "left_anti").select("id", "i", "run")), "left", left.count())
        begin, end = end, end * GROWTH
    return cut


def strip(raw: str, gone: set[int]) -> tuple[str, int]:
    """The text without these lines (counted without empty ones), and the number of its lines."""
    out, k = [], 0
    hold = True
    for line in raw.split("\n"):
        if line:
            hold = k not in gone
            k += 1
        if hold:
            out.append(line)
    return "\n".join(out), k


_let_through = bloom.let_through


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), least: int = LEAST_CHARS) -> DataFrame:
    """Documents with their text after deletion, n_lines and n_removed; an untouched text is unchanged, null included."""
    new = ("n_lines", "n_removed")
    names = [c for c in docs.columns if c in {doc_id, text, *carry} and c not in new]
    own = [f"`{c}` {t}" for c, t in docs.dtypes if c in names]
    i, x, cut = fresh(docs.columns, "i", "x", "gone")
    gone = keep(removed_lines(docs, doc_id, text, least).select(F.col("i").alias(i), F.col("x").alias(x), F.col("gone").alias(cut)), "gone")
    rows = docs.select(*(F.col(f"`{c}`") for c in names))
    # only texts that may lose lines meet their cuts in a shuffle; a filter of bounded size sends the others past it
    loses = _let_through(rows, bloom.of_ids(gone, x), F.xxhash64(text))
    joined = rows.where(loses).join(gone, (F.col(f"`{doc_id}`") == F.col(i)) & (F.xxhash64(text) == F.col(x)), "left").drop(i, x)
    joined = joined.unionByName(rows.where(~loses).withColumn(cut, F.lit(None).cast("array<int>")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, cuts = column(batch, text).to_pylist(), column(batch, cut).to_pylist()
        got = [(t, sum(1 for x in (t or "").split("\n") if x), 0) if not g else (*strip(t or "", set(g)), len(g)) for t, g in zip(texts, cuts)]
        texts, lines, removed = zip(*got)
        by = {text: pa.array(texts, pa.string())}
        return pa.RecordBatch.from_arrays([*(by[c] if c in by else column(batch, c) for c in names), pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], names=[*names, *new])

    return map_arrow(joined, run, ", ".join([*own, "n_lines long, n_removed long"]))


def op6_lines(spark, sf_dir: str) -> DataFrame:
    """Per document: lines, lines deleted, and a digest of the text that is left."""
    done = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
