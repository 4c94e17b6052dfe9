"""N-gram Jaccard join by vertical partitioning.

The set of a text is that of its distinct 5-word shingles, known by 64-bit hashes.
1. Each bucket of hashes counts for every text how many of its shingles no other text
   has. A text with too many can't reach the threshold and is done.
2. Texts of one set are a class, which goes on as one. The global order of shingles is
   by the number of classes that have them (to an eighth of an octave), then by hash;
   it is cut into FRAGMENTS of about equal numbers of occurrences, and each class into
   its segments of them.
3. Two classes that reach the threshold share one of the first shingles in the order,
   among the first 20 % of either (and one more). Classes that share such a shingle are
   compared with pivots, those of them that come first; a pair that is connected already
   is left out, and in each turn there are PIVOT_GROWTH times as many pivots until none
   of a shingle's classes is left to compare.
4. A comparison counts the overlap in each fragment separately, segment against segment,
   and sums it per pair.
So no pair within a group has to be made whose ends are known to be connected.

Cases: a text without words, or null, has the empty set and links with nothing; a text
of fewer than five words has its word sequence as its one shingle; a row with a null id
has a set but is no node, so it links nothing and its component is null; rows that repeat
an id are one node, which links through the set of each of them, and all get its
component; ids that are not whole numbers are compared in their order; equal sets link
whatever their texts. Shingles are equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm import bloom
from larkspur.llm.arrowmap import column, map_arrow, small_batches, tidied
from larkspur.llm.components import components, hot_keys, looked_up
from larkspur.llm.exchange import blob, deal, keys, partitions, run_id, to_buckets, whole_partitions
from larkspur.llm.shared import is_whole, keep, named, numbered, settled
from larkspur.llm.textvec import SPACED, buffers, grams, grams_within, mix, pieces, spans

WORDS, PERCENT = 5, 80
#: Fragments of the order of shingles, in which overlaps are counted.
FRAGMENTS = 4
#: Steps of the order to a doubling of the number of classes.
LEVELS = 8
#: Pairs for each row of the index up to which all are looked at; while more remain, pivots go first.
FULL_PAIRS = 16
#: Sets of classes in one file.
FILE_SETS = 2000
#: Pivots of a shingle in the first turn, and the factor from turn to turn.
PIVOTS, PIVOT_GROWTH = 4, 8
_U = np.uint64
#: Makes the second hash of a set.
SECOND = _U(0xA5A5A5A5A5A5A5A5)


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, and their bounds."""
    sets, sizes = [np.empty(0, _U)], [np.zeros(1, np.int64)]
    for lo, hi in spans(at):
        p = pieces(data[at[lo] : at[hi]], at[lo : hi + 1], SPACED, fold=True)
        g, first = grams_within(p, words)
        owner = np.searchsorted(p.hi, first, side="right")
        short = np.flatnonzero((p.hi > p.lo) & (p.hi - p.lo < words))
        if len(short):
            g = np.concatenate([g, mix(np.array([grams(p.hash[p.lo[i] : p.hi[i]], int(p.hi[i] - p.lo[i]))[0] ^ _U(p.hi[i] - p.lo[i]) for i in short], _U))])
            owner = np.concatenate([owner, short])
        order = np.lexsort((g, owner))
        g, owner = g[order], owner[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
        sets.append(g[new])
        sizes.append(np.bincount(owner[new], minlength=hi - lo))
    return np.concatenate(sets), np.cumsum(np.concatenate(sizes))


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, _U), np.cumsum(values, dtype=_U)])
    return total[cuts[1:]] - total[cuts[:-1]]


def set_sizes(docs: DataFrame, doc_id: str, text: str, words: int = WORDS) -> DataFrame:
    """For each row: id, n (size of its set), s0 and s1 (hashes of the set), alone (its shingles that no other row has).

    A bucket knows a shingle by the lower half of its hash. Two that meet there make a text look less alone, which costs a comparison and changes no result.
    """
    spark = docs.sparkSession
    docs = settled(docs.select(doc_id, text))
    n_buckets = partitions(docs)
    key = keys(n_buckets).tolist()
    most = min(max(n_buckets * 4096, 200_000), 2_000_000)
    names = ["bucket", "run", "ids", "n", "s0", "s1", "docs", "sizes", "asked", "shared"]

    def flush(ids: np.ndarray, sets: list[np.ndarray], sizes: list[np.ndarray], first: int) -> Iterator[pa.RecordBatch]:
        h, size = np.concatenate(sets), np.concatenate(sizes)
        cuts = np.concatenate([[0], np.cumsum(size)])
        run = run_id(first)
        owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = np.zeros(len(s) + 1, bool)
        same[1:-1] = s[1:] == s[:-1]
        alone = np.zeros(len(s), bool)
        alone[order] = ~same[:-1] & ~same[1:]  # in one text of this run
        shared = s[~same[:-1] & same[1:]]
        asked, who = h[alone], owner[alone]
        to, bound = deal(asked, n_buckets)
        asked, who = asked[to].astype(np.uint32), who[to]
        to, sbound = deal(shared, n_buckets)
        shared = shared[to].astype(np.uint32)
        rows = []
        for k in range(n_buckets):
            a = slice(bound[k], bound[k + 1])
            d, c = np.unique(who[a], return_counts=True)  # who ascends in a bucket
            rows.append((key[k], run, None, None, None, None, blob(d.astype(np.int32)), blob(c.astype(np.int32)), blob(asked[a]), blob(shared[sbound[k] : sbound[k + 1]])))
        k = run % n_buckets
        rows[k] = (*rows[k][:2], ids.tolist(), blob(size.astype(np.int64)), blob(_sums(h, cuts)), blob(_sums(mix(h ^ SECOND), cuts)), *rows[k][6:])
        types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 7]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, sizes, held, first, seen = [], [], [], 0, 0, 0
        for b in batches:
            data, at = buffers(column(b, "t"))
            for lo, hi in spans(at):  # a run may end within a batch
                h, cuts = shingle_sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], words)
                ids += column(b, "i").slice(lo, hi - lo).to_pylist()
                sets.append(h)
                sizes.append(np.diff(cuts))
                held += len(h)
                seen += hi - lo
                if held >= most:
                    yield from flush(ids_array(ids), sets, sizes, first)
                    ids, sets, sizes, held, first = [], [], [], 0, seen
        if ids:
            yield from flush(ids_array(ids), sets, sizes, first)

    def ids_array(ids: list) -> np.ndarray:
        return np.array(ids, dtype=object)

    def answer(got: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in got for r in b.to_pylist()]
        asked = [np.frombuffer(r["asked"], np.uint32) for r in rows]
        every = np.concatenate([*asked, *(np.frombuffer(r["shared"], np.uint32) for r in rows)])
        n = sum(map(len, asked))
        order = np.argsort(every, kind="stable")
        s = every[order]
        same = np.zeros(len(s) + 1, bool)
        same[1:-1] = s[1:] == s[:-1]
        alone = np.zeros(len(s), np.int64)
        alone[order] = ~same[:-1] & ~same[1:]
        # what is shared in a run has one entry here but two owners there; asked entries alone count
        total = np.concatenate([[0], np.cumsum(alone[:n])])
        at = 0
        out = []
        for r, a in zip(rows, asked):
            c = np.cumsum(np.frombuffer(r["sizes"], np.int32))
            count = total[at + c] - total[at + np.concatenate([[0], c[:-1]]).astype(np.int64)] if len(c) else np.empty(0, np.int64)
            at += len(a)
            out.append((r["run"], r["ids"], r["n"], r["s0"], r["s1"], r["docs"], blob(count.astype(np.int32))))
        types = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["run", "ids", "n", "s0", "s1", "docs", "alone"])

    def collect(got: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, count = {}, {}
        for b in got:
            for r in b.to_pylist():
                if r["ids"] is not None:
                    head[r["run"]] = r
                count.setdefault(r["run"], []).append((r["docs"], r["alone"]))
        for run, r in head.items():
            alone = np.zeros(len(r["ids"]), np.int64)
            for d, c in count[run]:
                alone[np.frombuffer(d, np.int32)] += np.frombuffer(c, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["ids"], pa.int64()), *(pa.array(np.frombuffer(r[c], np.int64)) for c in ("n", "s0", "s1")), pa.array(alone)], names=["id", "n", "s0", "s1", "alone"]
            )

    small_batches(spark)
    source = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))
    asks = source.mapInArrow(tidied(ask), "bucket int, run long, ids array<long>, n binary, s0 binary, s1 binary, docs binary, sizes binary, asked binary, shared binary")
    answers = whole_partitions(to_buckets(asks, n_buckets), answer, "run long, ids array<long>, n binary, s0 binary, s1 binary, docs binary, alone binary")
    return whole_partitions(answers.repartition(n_buckets, "run"), collect, "id long, n long, s0 long, s1 long, alone long")


def _sets_of(rows: DataFrame, words: int) -> DataFrame:
    """Of rows (c, n, s0, s1, t) that have the set that n, s0 and s1 name: c, n and the shingles of t."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        h, cuts = shingle_sets(*buffers(column(b, "t")), words)
        n, s0, s1 = (column(b, c).to_numpy() for c in ("n", "s0", "s1"))
        same = (np.diff(cuts) == n) & (_sums(h, cuts).view(np.int64) == s0) & (_sums(mix(h ^ SECOND), cuts).view(np.int64) == s1)
        sets = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(h.view(np.int64)))
        return pa.RecordBatch.from_arrays([column(b, "c"), column(b, "n"), sets], names=["c", "n", "g"]).filter(pa.array(same))

    return map_arrow(rows.select("c", "n", "s0", "s1", "t"), run, "c long, n long, g array<long>")


def fragment_cuts(common: DataFrame, fragments: int = FRAGMENTS) -> list[tuple[int, int]]:
    """Cuts (level, g) of the order between fragments of about equal numbers of occurrences: hashes are spread evenly within a level."""
    mass = common.groupBy("level").agg(F.sum("df").alias("m")).orderBy("level").collect()  # LEVELS rows an octave
    total, before, cuts = sum(r.m for r in mass), 0, []
    for r in mass:
        while len(cuts) + 1 < fragments and before + r.m >= total * (len(cuts) + 1) / fragments:
            part = (total * (len(cuts) + 1) / fragments - before) / r.m
            cuts.append((r.level, min(int(part * 2**64), 2**64 - 1) - 2**63))
        before += r.m
    return cuts


def _in_fragment(cuts: list[tuple[int, int]], i: int):
    """Whether a shingle (level, g) is in fragment i, from one cut to the next."""
    after = lambda x, cut: (x.level > cut[0]) | ((x.level == cut[0]) & (x.g >= cut[1]))

    def holds(x):
        low = after(x, cuts[i - 1]) if i else F.lit(True)
        return low & ~after(x, cuts[i]) if i < len(cuts) else low

    return holds


def _linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold: overlaps are counted in each fragment and summed per pair."""
    left = segments.select(F.col("c").alias("a"), "f", F.col("seg").alias("sa"), F.col("n").alias("na"))
    right = segments.select(F.col("c").alias("b"), "f", F.col("seg").alias("sb"), F.col("n").alias("nb"))
    partial = pairs.join(left, "a").join(right, ["b", "f"]).select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("part"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    return total.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def class_links(docs: DataFrame, classes: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame | None:
    """Links (a, b) between classes whose components are those of all links; classes have c, rep (an id with the set), n, s0, s1."""
    let = bloom.of_ids(classes, "rep")
    there = bloom.only(docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null"), let, "i")
    sets = keep(_sets_of(there.join(classes.withColumnRenamed("rep", "i"), "i"), words).dropDuplicates(["c"]), "sets", number := classes.count(), FILE_SETS)
    each = sets.select("c", F.explode("g").alias("g"))
    # what is joined on shingles below is written first, so that both sides are shuffled for the join and Spark splits a shingle that very many have
    level = F.floor(F.log2("df") * LEVELS).cast("int").alias("level")
    common = keep(each.groupBy("g").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("g", "df", level), "common")
    shared = each.join(common, "g").groupBy("c").agg(F.array_sort(F.collect_list(F.struct("level", "g"))).alias("gs")).join(classes.select("c", "n"), "c")
    shared = keep(shared.where(100 * F.size("gs") >= percent * F.col("n")), "shared", number, FILE_SETS)
    # positions count the shingles that no other class has, which come first in the order
    alone = F.col("n") - F.size("gs")
    first = F.floor(F.col("n") * (100 - percent) / 100) + 1 - alone
    prefix = shared.select("c", "n", alone.alias("alone"), F.posexplode(F.slice("gs", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("k", "x"))
    index = keep(prefix.select("x.g", "x.level", "c", "n", (F.col("alone") + F.col("k")).alias("at")), "index")
    cuts, most = fragment_cuts(common), index.count()
    piece = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.transform(F.filter("gs", _in_fragment(cuts, i)), lambda x: x.g).alias("seg")) for i in range(len(cuts) + 1))))
    segments = keep(shared.select("c", "n", piece.alias("p")).select("c", "n", "p.f", "p.seg").where("size(seg) > 0"), "segments")
    # what follows a pair's first common shingle bounds its overlap
    near = (100 + percent) * F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) >= percent * (F.col("na") + F.col("nb"))

    def side(rows: DataFrame, x: str) -> DataFrame:
        return rows.select(F.col("g").alias("g2" if x == "a" else "g"), F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("at").alias(f"at{x}"), F.col("label").alias(f"l{x}"))

    links = None
    rows, pivots_now = index.withColumn("label", F.col("c")), PIVOTS
    while True:
        # of the shingles that the same classes have, the first in the order stands for all
        groups = rows.groupBy("level", "g").agg(F.count(F.lit(1)).alias("k"), F.min("label").alias("l0"), F.max("label").alias("l1"), *(F.bit_xor(F.xxhash64("c", F.lit(i))).alias(f"x{i}") for i in range(2))).where("l0 < l1")
        first = groups.groupBy("k", "x0", "x1").agg(F.min(F.struct("level", "g")).alias("y")).select("k", F.col("y.g").alias("g"))
        rows = keep(rows.join(first, "g"), "open", most)
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k")).first()
        if not size.n:
            return links
        rows = rows.drop("k")
        full = links is not None and size.k <= 2 * FULL_PAIRS * size.n
        if full:
            met = side(rows, "b").join(side(rows, "a"), (F.col("g") == F.col("g2")) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & near)
            pairs = met.select("a", "b").distinct()
        else:
            # those with the fewest rarer shingles before it are the nearest to what the group shares
            central = F.row_number().over(Window.partitionBy("g").orderBy("at", "n", "c"))
            pivots = keep(rows.withColumn("place", central).where(F.col("place") <= pivots_now).drop("place"), "pivots", most)
            met = side(rows, "b").join(side(pivots, "a"), (F.col("g") == F.col("g2")) & (F.col("a") != F.col("b")) & (F.col("la") != F.col("lb")) & near)
            pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            rows = rows.join(pivots.select("g", "c"), ["g", "c"], "left_anti")
            pivots_now *= PIVOT_GROWTH
        new = keep(_linked(pairs, segments, percent), "links", most)
        links = new if links is None else links.unionByName(new)
        if full:
            return links
        rows = rows.drop("label").join(components(links).withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """For each row: the id, n_shingles, and component_id, the least id that links reach."""
    if not is_whole(docs, doc_id):
        rows, ranks = numbered(docs, doc_id, text)
        return named(near_duplicates(rows, "_id", "_text", words, percent), ranks, _id=doc_id, component_id="component_id")
    key = ["n", "s0", "s1"]
    sizes = keep(set_sizes(docs, doc_id, text, words), "sizes")
    most = sizes.count()
    can = sizes.where(F.col("id").isNotNull() & (F.col("n") > 0) & (100 * (F.col("n") - F.col("alone")) >= percent * F.col("n")))
    # written with its numbers, so that all readers see the same
    classes = keep(can.groupBy(*key).agg(F.min("id").alias("rep")).withColumn("c", F.monotonically_increasing_id()), "classes", most)
    links = class_links(docs, classes, doc_id, text, words, percent)
    which = F.xxhash64(*key)
    several = keep(sizes.where("id is not null").groupBy("id").agg(F.min(which).alias("lo"), F.max(which).alias("hi")).where("lo < hi").select("id"), "several", most)
    repeated = not several.isEmpty()
    if repeated:  # an id with several sets joins their classes
        of_id = keep(can.join(several, "id").join(classes, key).select("id", "c").distinct(), "classes")
        star = of_id.groupBy("id").agg(F.min("c").alias("a")).join(of_id, "id").select("a", F.col("c").alias("b"))
        links = star if links is None else links.unionByName(star)
    found = classes.select(*key, "rep", "c", F.col("c").alias("label")) if links is None else classes.join(components(links).withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    found = keep(found, "found", most)
    members = looked_up(found, "label", found.groupBy("label").agg(F.min("rep").alias("component")), hot_keys(found, "label", most))
    out = sizes.join(members.select(*key, "component"), key, "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))
    if repeated:
        out = keep(out, "rows")
        whole = out.join(several, "id").groupBy("id").agg(F.min("component").alias("whole"))
        out = out.join(whole, "id", "left").select("id", "n", F.coalesce("whole", "component").alias("component"))
    return out.select(F.col("id").cast(docs.schema[doc_id].dataType).alias(doc_id), F.col("n").alias("n_shingles"), F.col("component").cast("long").alias("component_id"))


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Per document: the size of its set of shingles and the component of near duplicates that it is in."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP4_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
e AS MATERIALIZED (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
c AS (SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.reach)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(reach) FROM c WHERE c.node = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""
