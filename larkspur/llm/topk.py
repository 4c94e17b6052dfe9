"""Exact top-k search by inner product in three phases under a uniform threshold.

Vectors of equal components are one class, of which the k + 1 smallest ids can matter.
Classes are dealt into blocks of about equal norms, queries into blocks of their own; a
pair of blocks holds, for every query, one list of partial scores for each fragment of
the dimensions.
1. Each pair of blocks looks up the best entries of its lists and reports the k best
   scores of their classes; the k-th best of all is a cutoff that the result reaches.
2. The cutoff goes with the queries to the blocks that can reach it by their norms. Lists
   are made fragment by fragment; a query whose best partial score with the most that is
   left (the product of norms) stays below the cutoff is multiplied no further. A class
   whose partial score is, in every fragment, below that fragment's share of the cutoff
   (its least score plus a uniform part of what the cutoff leaves) can't reach it; the
   entries above their share are collected.
3. The scores of these are resolved exactly, and the best are ranked.

Cases: vectors that are null, empty, or hold null or non-finite components take no part;
all others do, whatever their size: products beyond what doubles or longs hold are made
of whole numbers without bounds, and a score beyond a long's range counts as the nearest
long, before ranking. A double component of 2**1016 or more counts as the greatest double.
Only vectors of one length are compared; a null id takes no part, and ids have to be whole
numbers (else ValueError); repeated ids are candidates once for each distinct vector, and
a query asks once for each; ties go to the smaller id. A query with fewer candidates than
k gets all of them.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.arrowmap import column, map_arrow
from larkspur.llm.shared import is_whole, keep

K, FRAGMENTS = 5, 4
BLOCK, QUERY_BLOCK = 4096, 1024
#: Steps of norms to a doubling, within which classes share blocks.
LEVELS = 4
#: Rows of the table of levels up to which it is broadcast.
FEW = 1 << 16
LONG = np.iinfo(np.int64)


def quantised(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """Ids and vectors of whole numbers (as doubles, which hold them exactly) of the rows that take part."""
    if not is_whole(df, vec_id):
        raise ValueError(f"{vec_id} is not a column of whole numbers")
    most = F.lit(sys.float_info.max)

    def whole(c: Column) -> Column:
        x = F.least(F.greatest(c * 256.0, -most), most)
        return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)  # beyond that all doubles are whole

    return (
        df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
        .where(F.col("id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= most), F.lit(False))))
        .select("id", F.transform("x", whole).alias("v"))
    )


def _greatest(m: np.ndarray) -> float:
    return float(np.abs(m).max()) if m.size else 0.0


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, which must fit in a long; through doubles where these are exact."""
    if _greatest(q) * _greatest(c) * q.shape[1] < 2**53:
        return (q @ c.T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers of any size, held within a long's range."""
    if _greatest(q) * _greatest(c) * max(1, q.shape[1]) < 2**62:
        return products(q, c)
    exact = np.frompyfunc(int, 1, 1)
    return np.clip(exact(q) @ exact(c).T, LONG.min, LONG.max).astype(np.int64).reshape(len(q), len(c))


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.empty((0, 0))


def _bounds(d: int, m: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, d, min(m, d) + 1).astype(int).tolist()
    return list(zip(cuts, cuts[1:]))


def _norms(m: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """The norm of each fragment of each row, a little more than exact."""
    return np.stack([np.sqrt((m[:, a:b] ** 2).sum(axis=1)) for a, b in bounds]) * (1 + 1e-9)


def lists_that_reach(q: np.ndarray, c: np.ndarray, cut: np.ndarray, fragments: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows of q that may reach their cutoff (-inf: none) with a row of c, and their partial scores by fragment."""
    bounds = _bounds(q.shape[1], fragments)
    qn, cn = _norms(q, bounds), _norms(c, bounds)
    rows = np.flatnonzero(qn.T @ cn.max(axis=1) >= cut)
    lists: list[np.ndarray] = []
    total = np.zeros((len(rows), len(c)), np.int64)
    for f, (a, b) in enumerate(bounds):
        lists.append(products(q[rows, a:b], c[:, a:b]))
        total += lists[-1]
        if f + 1 < len(bounds):
            left = np.flatnonzero((total + qn[f + 1 :, rows].T @ cn[f + 1 :]).max(axis=1) >= cut[rows])
            if len(left) < len(rows):
                rows, total, lists = rows[left], total[left], [x[left] for x in lists]
    return rows, lists


def _best(scores: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties by the least id of a class."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((first[at], -scores[at]))[:k]]


def search(df: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, fragments: int = FRAGMENTS) -> DataFrame:
    """The k candidates of highest inner product for each row that is_query (of `id`) selects: query_id, rank, vec_id, score."""
    rows = keep(quantised(df, vec_id, vector), "vectors")
    window = Window.partitionBy("v").orderBy("id")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    # a class needs only k + 1 ids: each map task keeps as many before the shuffle
    classes = rows.distinct().withColumn("n", F.row_number().over(window)).where(F.col("n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    level = F.when(norm > 0, F.floor(F.log2(norm) * LEVELS)).otherwise(-10_000).cast("int")
    classes = keep(classes.select("v", "ids", F.size("v").alias("d"), norm.alias("norm"), level.alias("level")), "classes")
    queries = rows.where(is_query).distinct()
    asks = max(1, -(-queries.count() // QUERY_BLOCK))
    levels = keep(classes.groupBy("d", "level").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"), F.max("norm").alias("norm")), "levels")
    few = F.broadcast if levels.count() <= FEW else lambda x: x

    dealt = classes.drop("norm").join(few(levels), ["d", "level"]).withColumn("b", F.pmod(F.xxhash64("v"), F.col("blocks")))
    c_blocks = keep(dealt.groupBy("d", "level", "b").agg(F.collect_list(F.struct("v", "ids")).alias("c")), "blocks")
    q_rows = queries.select(F.size("v").alias("d"), F.pmod(F.xxhash64("id", "v"), F.lit(asks)).alias("qb"), "id", "v", norm.alias("qn"))

    def pairs(q_rows: DataFrame, can_reach: Column, *more: str) -> DataFrame:
        """Every block of queries with every block of classes of its length that can_reach lets through: blocks are small and of bounded size."""
        q_blocks = q_rows.groupBy("d", "qb").agg(F.collect_list(F.struct("id", "v", *more)).alias("q"), F.max("qn").alias("qn"), *(F.min(F.coalesce(x, F.lit(LONG.min))).alias(x) for x in more))
        spread = q_blocks.join(few(levels), "d").where(can_reach).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        return spread.select("d", "level", "b", "q").join(c_blocks.hint("shuffle_hash"), ["d", "level", "b"])

    def parts(batch: pa.RecordBatch):
        """Of each pair: queries' ids, rows and cutoffs, classes' rows, ids and least ids, and which rows of both are so large that they need whole numbers without bounds."""
        for i in range(batch.num_rows):
            q, c = column(batch, "q")[i].values, column(batch, "c")[i].values
            ids = c.field("ids")
            first = ids.values.to_numpy()[ids.offsets.to_numpy()[:-1]]
            qv, cv = _matrix(q.field("v")), _matrix(c.field("v"))
            limit = (2.0**62 / max(1, qv.shape[1])) ** 0.5
            yield q, qv, cv, ids.to_pylist(), first, np.abs(qv).max(axis=1) >= limit, np.abs(cv).max(axis=1) >= limit

    def gather(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Phase 1: for each query the scores of the classes that head its lists."""
        out: list[tuple] = []
        for q, qv, cv, ids, first, huge_q, huge_c in parts(batch):
            plain = np.flatnonzero(~huge_c)
            lists = [products(qv[~huge_q, a:b], cv[plain, a:b]) for a, b in _bounds(qv.shape[1], fragments)]
            top = min(k + 1, len(plain))
            heads = np.concatenate([np.argpartition(x, len(plain) - top, axis=1)[:, len(plain) - top :] for x in lists], axis=1) if top else np.empty((len(qv), 0), int)
            at = np.cumsum(~huge_q) - 1
            for r, (qid, vec) in enumerate(zip(q.field("id").to_pylist(), qv.tolist())):
                if huge_q[r]:
                    some, values = np.arange(len(cv)), scores(qv[r : r + 1], cv)[0]
                else:
                    j = np.unique(heads[at[r]])
                    some, values = plain[j], sum(x[at[r], j] for x in lists)
                    if huge_c.any():
                        some, values = np.concatenate([some, np.flatnonzero(huge_c)]), np.concatenate([values, scores(qv[r : r + 1], cv[huge_c])[0]])
                best = _best(values, first[some], k + 1)
                found = [s for j, s in zip(some[best].tolist(), values[best].tolist()) for i in ids[j] if i != qid]
                out.append((qid, vec, sorted(found, reverse=True)[:k]))
        qid, vec, found = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(vec, pa.list_(pa.float64())), pa.array(found, pa.list_(pa.int64()))], names=["id", "v", "scores"])

    local = map_arrow(pairs(q_rows, F.lit(True)), gather, "id long, v array<double>, scores array<long>")
    order = Window.partitionBy("id", "v").orderBy(F.col("s").desc())
    cutoff = local.select("id", "v", F.explode("scores").alias("s")).withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("id", "v", F.col("s").alias("cutoff"))
    with_cutoff = keep(q_rows.join(cutoff, ["id", "v"], "left"), "cutoffs")

    def resolve(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Phases 2 and 3: entries above their share of the cutoff, then their exact scores."""
        out: list[tuple] = []
        for q, qv, cv, ids, first, huge_q, huge_c in parts(batch):
            cut = np.array([LONG.min if x is None else x for x in q.field("cutoff").to_pylist()], np.int64)
            plain_q, plain = np.flatnonzero(~huge_q), np.flatnonzero(~huge_c)
            names = q.field("id").to_pylist()

            def put(r: int, some: np.ndarray, total: np.ndarray) -> None:
                some, total = some[total >= cut[r]], total[total >= cut[r]]  # noqa: B023
                best = _best(total, first[some], k + 1)  # noqa: B023
                found = sorted((-s, i) for j, s in zip(some[best].tolist(), total[best].tolist()) for i in ids[j] if i != names[r])[:k]  # noqa: B023
                out.extend((names[r], i, -s) for s, i in found)  # noqa: B023

            if len(plain_q) and len(plain):
                asked = np.where(cut[plain_q] == LONG.min, -np.inf, cut[plain_q].astype(np.float64) * (1 - 1e-9 * np.sign(cut[plain_q])))
                reach, lists = lists_that_reach(qv[plain_q], cv[plain], asked, fragments)
                least = [x.min(axis=1) for x in lists]
                for at, r in enumerate(plain_q[reach].tolist()):
                    if cut[r] == LONG.min:
                        some = np.arange(len(plain))
                    else:
                        room = int(cut[r]) - sum(int(x[at]) for x in least)
                        share = LONG.min if room <= 0 else -(-room // len(lists))
                        some = np.flatnonzero(np.logical_or.reduce([x[at] - low[at] >= share for x, low in zip(lists, least)]))
                    put(r, plain[some], sum(x[at, some] for x in lists))
            for r in np.flatnonzero(huge_q).tolist():
                put(r, np.arange(len(cv)), scores(qv[r : r + 1], cv)[0])
            if huge_c.any():
                for r in plain_q.tolist():
                    put(r, np.flatnonzero(huge_c), scores(qv[r : r + 1], cv[huge_c])[0])
        qid, i, s = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])

    within = F.col("qn") * F.col("norm") * (1 + 1e-9) >= F.col("cutoff")
    found = map_arrow(pairs(with_cutoff, within, "cutoff"), resolve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    """The five best candidates of every vector whose id is divisible by 50."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
