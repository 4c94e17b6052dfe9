"""Pareto operators over tables of points (inventory P1-P10).

Objectives are columns with a sign: 1 where more is better, -1 where less is. In two
dimensions fronts are a sort and a running maximum; in more, points are first compared
within partitions, and only local fronts meet. Fronts are small beside their tables.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.plans.store import kept

Objectives = Sequence[tuple[str, int]]
FAR = 1.7976931348623157e308
#: Points that one task ranks, in two dimensions.
RANGE_POINTS = 1_000_000
#: Distinct points of a strip in which dominated points are counted and nearest ones found.
STRIP_POINTS = 20_000


def _better(objectives: Objectives, left: str = "", right: str = "") -> tuple[Column, Column]:
    """Whether left is nowhere worse than right, and somewhere better."""
    nowhere, somewhere = F.lit(True), F.lit(False)
    for name, sign in objectives:
        a, b = F.col(left + name) * sign, F.col(right + name) * sign
        nowhere, somewhere = nowhere & (a >= b), somewhere | (a > b)
    return nowhere, somewhere


def dominates(objectives: Objectives, left: str, right: str, strictly: bool = False) -> Column:
    """Of two points in one row, by the prefixes of their columns; strictly: better everywhere."""
    if strictly:
        out = F.lit(True)
        for name, sign in objectives:
            out = out & (F.col(left + name) * sign > F.col(right + name) * sign)
        return out
    nowhere, somewhere = _better(objectives, left, right)
    return nowhere & somewhere


def front_2d(points: DataFrame, objectives: Objectives) -> DataFrame:
    """Points that none dominates: the best second objective of each first one, above all that have a better first."""
    (a, sa), (b, sb) = objectives
    best = points.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy((-F.col(a) * sa).cast("double").alias("_x")).agg(F.max(F.col(b) * sb).cast("double").alias("_y"))
    # the running maximum in two levels, over ranges of the first objective
    cuts = sorted(set(best.approxQuantile("_x", [i / 64 for i in range(1, 64)], 0.005)))
    part = sum(((F.col("_x") > c).cast("int") for c in cuts), F.lit(0))
    dealt = best.withColumn("_part", part)
    before = dealt.groupBy("_part").agg(F.max("_y").alias("_t")).select("_part", F.max("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    ahead = F.max("_y").over(Window.partitionBy("_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1))
    run = dealt.join(F.broadcast(before), "_part").withColumn("_ahead", F.greatest(ahead, F.col("_before")))
    first = run.where(F.col("_ahead").isNull() | (F.col("_y") > F.col("_ahead"))).select((-F.col("_x") * sa).alias("_a"), (F.col("_y") * sb).alias("_b"))
    return points.join(first, (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b")), "left_semi")


def front(points: DataFrame, objectives: Objectives) -> DataFrame:
    """Points that none dominates, for any number of objectives.

    Each partition keeps its own front; the fronts meet in rounds that halve their number.
    """
    if len(objectives) == 2:
        return front_2d(points, objectives)
    names, signs = [n for n, _ in objectives], np.array([s for _, s in objectives], float)

    def local(batches):
        import pandas as pd

        held: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf.dropna(subset=names)
            both = pdf if held is None else pd.concat([held, pdf])
            held = both[non_dominated(both[names].to_numpy(float) * signs)]
        if held is not None and len(held):
            yield held

    n = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = points.mapInPandas(local, points.schema)
    while n > 1:
        n = n // 8
        out = out.repartition(max(1, n)).mapInPandas(local, points.schema)
    return out


def non_dominated(x: np.ndarray) -> np.ndarray:
    """Rows of x (more is better) that no row dominates."""
    order = np.lexsort(x.T[::-1])[::-1]
    keep: list[int] = []
    for i in order:
        if not keep or not ((x[keep] >= x[i]).all(axis=1) & (x[keep] > x[i]).any(axis=1)).any():
            keep.append(i)
    out = np.zeros(len(x), bool)
    out[keep] = True
    return out


def distinct_front(points: DataFrame, objectives: Objectives) -> DataFrame:
    """A front without repeated points, in lexicographic order."""
    names = [n for n, _ in objectives]
    return front(points, objectives).dropDuplicates(names).orderBy(*(F.col(n) for n in names))


def ranks(points: DataFrame, objectives: Objectives) -> DataFrame:
    """Column `rank`: 0 for the front, 1 for the front without that, and so on, until no point is left.

    A point with a null or NaN objective has a null rank. With two objectives ranks are found in one
    sorted pass; with more there is one pass a rank.
    """
    names = [n for n, _ in objectives]
    points = points.drop("rank")
    full = F.lit(True)
    for n in names:
        full = full & F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double"))
    distinct = points.where(full).select(*names).distinct()
    ranked = _ranks_2d(distinct, objectives) if len(objectives) == 2 else _ranks_peeled(distinct, objectives)
    return points.join(ranked, names, "left").select(*points.columns, "rank")


def _ranks_2d(distinct: DataFrame, objectives: Objectives) -> DataFrame:
    """Ranks of distinct points: from the best first objective on, a point is in the first front whose best second objective so far is worse.

    Ranges of the first objective of about RANGE_POINTS take their turns, one sorted task each; one number a front goes from one to the next.
    """
    (a, sa), (b, sb) = objectives
    points = kept(distinct.select(a, b, (F.col(a) * sa).cast("double").alias("_x"), (F.col(b) * sb).cast("double").alias("_y")), "points")
    n = -(-points.count() // RANGE_POINTS)
    cuts = sorted(set(points.approxQuantile("_x", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    schema = points.select(a, b, "_y").withColumn("rank", F.lit(0)).schema
    tails: list[float] = []  # the best second objective of each front so far, negated, so in ascending order
    out = None
    for k in range(len(cuts), -1, -1):
        part = points
        if k:
            part = part.where(F.col("_x") > cuts[k - 1])
        if k < len(cuts):
            part = part.where(F.col("_x") <= cuts[k])
        sent = points.sparkSession.sparkContext.broadcast(tails)

        def run(batches):
            ends = list(sent.value)
            for batch in batches:
                found = []
                for y in batch.column(2).to_pylist():
                    r = bisect_right(ends, -y)
                    ends[r : r + 1] = [-y]
                    found.append(r)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[a, b, "_y", "rank"])

        now = kept(part.repartition(1).sortWithinPartitions(F.col("_x").desc(), F.col("_y").desc()).select(a, b, "_y").mapInArrow(run, schema), "ranks")
        sent.destroy()
        if k:
            for row in now.groupBy("rank").agg(F.max("_y").alias("y")).orderBy("rank").toLocalIterator():
                tails[row["rank"] : row["rank"] + 1] = [-row["y"]]
        out = now if out is None else out.unionByName(now)
    return out.select(a, b, "rank")


def _ranks_peeled(distinct: DataFrame, objectives: Objectives) -> DataFrame:
    """Ranks of distinct points, front by front."""
    names = [n for n, _ in objectives]
    left, out, rank = kept(distinct, "points"), None, 0
    while not left.isEmpty():
        now = kept(front(left, objectives).withColumn("rank", F.lit(rank)), "front")
        out = now if out is None else out.unionByName(now)
        left = kept(left.join(now, names, "left_anti"), "points")
        rank += 1
        if rank % 64 == 0:  # else the plan grows with the ranks
            out = kept(out, "ranks")
    return distinct.withColumn("rank", F.lit(0)) if out is None else out


def _neighbours(points: DataFrame, name: str, by: list[str]) -> DataFrame:
    """points with _lag and _lead, the values of a column before and after each row's, and _span, the column's range.

    Within the groups of `by` by windows; of a whole table in two levels, so that no task sorts it all.
    """
    if by:
        order, whole = Window.partitionBy(*by).orderBy(name), Window.partitionBy(*by)
        return points.select("*", F.lag(name).over(order).alias("_lag"), F.lead(name).over(order).alias("_lead"), (F.max(name).over(whole) - F.min(name).over(whole)).alias("_span"))
    cuts = sorted(set(points.select(F.col(name).cast("double").alias("x")).approxQuantile("x", [i / 64 for i in range(1, 64)], 0.005)))
    part = sum((F.coalesce((F.col(name) > x).cast("int"), F.lit(0)) for x in cuts), F.lit(0))
    dealt = points.withColumn("_part", part)
    order = Window.orderBy("_part")  # over 64 rows
    ends = dealt.groupBy("_part").agg(F.min(name).alias("_lo"), F.max(name).alias("_hi"))
    sides = ends.select(
        "_part", F.max("_hi").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.min("_lo").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
        (F.max("_hi").over(Window.partitionBy()) - F.min("_lo").over(Window.partitionBy())).alias("_span"),
    )
    inside = Window.partitionBy("_part").orderBy(name)
    beside = dealt.join(F.broadcast(sides), "_part")
    return beside.select(*points.columns, F.coalesce(F.lag(name).over(inside), "_before").alias("_lag"), F.coalesce(F.lead(name).over(inside), "_after").alias("_lead"), "_span")


def crowding(points: DataFrame, objectives: Objectives, by: list[str] = []) -> DataFrame:
    """Column `crowding`: over the objectives, the gap between a point's neighbours over the range; FAR at the ends. Of fronts, which `by` tells apart."""
    out = points.withColumn("_total", F.lit(0.0))
    for name, _ in objectives:
        gap = F.try_divide(F.col("_lead") - F.col("_lag"), F.col("_span"))
        here = F.when(F.col("_lag").isNull() | F.col("_lead").isNull(), F.lit(float("inf"))).otherwise(F.coalesce(gap, F.lit(0.0)))
        out = _neighbours(out, name, by).withColumn("_total", F.col("_total") + here).drop("_lag", "_lead", "_span")
    return out.withColumn("crowding", F.when(F.col("_total") == float("inf"), F.lit(FAR)).otherwise(F.col("_total"))).drop("_total")


def spread(front_points: DataFrame, objectives: Objectives) -> DataFrame:
    """spread: how uneven a front's distances are, 0 if even: those between neighbours in two objectives, else those to the nearest other point."""
    names = [n for n, _ in objectives]
    if len(names) == 2:
        a, b = names
        order = Window.orderBy(a, b)  # over a front, which is small
        d = F.sqrt(F.pow(F.col(a) - F.lag(a).over(order), F.lit(2.0)) + F.pow(F.col(b) - F.lag(b).over(order), F.lit(2.0)))
        gaps = front_points.select(d.alias("d")).where("d is not null")
    else:
        one = kept(front_points.select(*names).distinct().withColumn("_i", F.monotonically_increasing_id()), "front")
        left, right = (one.select(*(F.col(n).cast("double").alias(f"{x}_{n}") for n in names), F.col("_i").alias(f"{x}_i")) for x in "lr")
        d = F.sqrt(sum((F.pow(F.col(f"l_{n}") - F.col(f"r_{n}"), F.lit(2.0)) for n in names), F.lit(0.0)))
        gaps = left.join(right, F.col("l_i") != F.col("r_i")).groupBy("l_i").agg(F.min(d).alias("d")).select("d")
    mean = gaps.agg(F.avg("d").alias("m"))
    return gaps.join(F.broadcast(mean)).agg(F.coalesce(F.try_divide(F.sum(F.abs(F.col("d") - F.col("m"))), F.sum("d")), F.lit(0.0)).alias("spread"))


def hypervolume(points: DataFrame, objectives: Objectives, reference: Sequence[float]) -> DataFrame:
    """hypervolume of what a front dominates down to a reference point; points beyond it are dropped.

    From three objectives on the volume is cut into slabs between the values of the last one, each
    measured over the others: a join of the front with itself for each objective beyond two.
    """
    beyond = F.lit(True)
    for (n, s), r in zip(objectives, reference):
        beyond = beyond & (F.col(n) * s > r * s)
    inside = points.where(beyond)
    if len(objectives) > 1:
        inside = front(inside, objectives)
    gains = kept(inside.select(*(((F.col(n) - r) * s).cast("double").alias(f"g{i}") for i, ((n, s), r) in enumerate(zip(objectives, reference)))).distinct(), "gains")
    return _volume(gains, [], [f"g{i}" for i in range(len(objectives))]).agg(F.coalesce(F.sum("volume"), F.lit(0.0)).alias("hypervolume"))


def _volume(gains: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """keys, volume: of the union of the boxes from 0 to each row of a key's gains."""
    if len(dims) == 1:
        return gains.groupBy(*keys).agg(F.max(dims[0]).alias("volume"))
    x, y = dims[:2]
    if len(dims) == 2:
        ahead = F.max(y).over(Window.partitionBy(*keys).orderBy(F.col(x).desc(), F.col(y).desc()).rowsBetween(Window.unboundedPreceding, -1))
        step = gains.select(*keys, (F.col(x) * F.greatest(F.col(y) - F.coalesce(ahead, F.lit(0.0)), F.lit(0.0))).alias("v"))
        return step.groupBy(*keys).agg(F.sum("v").alias("volume"))
    z, top = dims[-1], f"top{len(dims)}"
    below = F.lag("_z").over(Window.partitionBy(*keys).orderBy("_z"))
    slabs = gains.select(*keys, F.col(z).alias("_z")).distinct().select(*keys, F.col("_z").alias(top), (F.col("_z") - F.coalesce(below, F.lit(0.0))).alias("_thick"))
    in_slab = gains.join(slabs, keys).where(F.col(z) >= F.col(top)) if keys else gains.join(slabs, F.col(z) >= F.col(top))
    each = _volume(in_slab.select(*keys, top, *dims[:-1]), [*keys, top], dims[:-1])
    return each.join(slabs, [*keys, top]).groupBy(*keys).agg(F.sum(F.col("volume") * F.col("_thick")).alias("volume"))


def epsilon(points: DataFrame, reference: DataFrame, objectives: Objectives, multiplicative: bool = False) -> DataFrame:
    """epsilon: the least shift (or factor) by which points weakly dominate every point of a reference front. Spark sends one of them to all if it is small."""
    ref = reference.select(*(F.col(n).alias(f"r_{n}") for n, _ in objectives)).distinct()
    need = lambda n, s: F.try_divide(F.col(f"r_{n}"), F.col(n)) if multiplicative and s > 0 else F.try_divide(F.col(n), F.col(f"r_{n}")) if multiplicative else (F.col(f"r_{n}") - F.col(n)) * s
    parts = [need(n, s) for n, s in objectives]
    worst = F.greatest(*parts) if len(parts) > 1 else parts[0]
    pairs = ref.join(points.select(*(n for n, _ in objectives)).distinct())
    return pairs.groupBy(*(f"r_{n}" for n, _ in objectives)).agg(F.min(worst).alias("e")).agg(F.max("e").alias("epsilon"))


def archive(points: DataFrame, objectives: Objectives, capacity: int) -> DataFrame:
    """A front of at most `capacity` points: those of least crowding go first, one at a time."""
    import pandas as pd

    pdf = distinct_front(points, objectives).toPandas()
    names = [n for n, _ in objectives]
    while len(pdf) > capacity:
        x = pdf[names].to_numpy(float)
        crowd = np.zeros(len(x))
        for j in range(len(names)):
            order = np.argsort(x[:, j], kind="stable")
            span = x[order[-1], j] - x[order[0], j] or 1.0
            crowd[order[[0, -1]]] = np.inf
            crowd[order[1:-1]] += (x[order[2:], j] - x[order[:-2], j]) / span
        pdf = pdf.drop(pdf.index[int(crowd.argmin())]).reset_index(drop=True)
    return points.sparkSession.createDataFrame(pd.DataFrame(pdf), points.schema)


def lexicographic(objectives: Objectives) -> list[Column]:
    """Sort keys that put the best point first."""
    return [F.col(n).desc() if s > 0 else F.col(n).asc() for n, s in objectives]


def lexicographic_keys(objectives: Objectives) -> list[Column]:
    """Values whose ascending order puts the best point first."""
    return [-F.col(n) if s > 0 else F.col(n) for n, s in objectives]


def by_rank_and_crowding() -> list[Column]:
    return [F.col("rank").asc(), F.col("crowding").desc()]


def spea2(points: DataFrame, objectives: Objectives, row: str) -> DataFrame:
    """strength (points dominated), raw (strengths of those that dominate it), and fitness raw + 1 / (2 + distance to the nearest), of a population.

    In two objectives the sums are counted and the nearest found over strips, and no pairs are made.
    With more objectives, or with objectives that no double holds (infinite, NaN, whole numbers from 2^53
    on), or ids that repeat or are null, every pair is looked at.
    """
    if len(objectives) != 2:
        return _spea2_by_pairs(points, objectives, row)
    (a, sa), (b, sb) = objectives
    flat = points.select(F.col(row).alias("_row"), (F.col(a) * sa).cast("double").alias("x"), (F.col(b) * sb).cast("double").alias("y"))
    odd = [F.coalesce(F.max(F.isnan(v) | (F.abs(v) >= (2.0**53 if dict(points.dtypes)[n] == "bigint" or "decimal" in dict(points.dtypes)[n] else float("inf")))), F.lit(False)) for n, v in ((a, F.col("x")), (b, F.col("y")))]
    seen = flat.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_row").alias("ids"), *(o.alias(f"odd{i}") for i, o in enumerate(odd))).first()
    if seen.odd0 or seen.odd1 or seen.n != seen.ids:
        return _spea2_by_pairs(points, objectives, row)
    places = kept(flat.where("x is not null and y is not null").groupBy("x", "y").agg(F.count(F.lit(1)).alias("c")), "places")
    n = places.count()
    up = _sums_below(places.select("x", "y", F.col("c").alias("w")), n).withColumnRenamed("s", "below")
    strong = kept(places.join(up, ["x", "y"]).select("x", "y", "c", (F.col("below") - F.col("c")).alias("strength")), "strengths")
    down = _sums_below(strong.select((-F.col("x")).alias("x"), (-F.col("y")).alias("y"), (F.col("c") * F.col("strength")).alias("w")), n)
    down = down.select((-F.col("x")).alias("x"), (-F.col("y")).alias("y"), F.col("s").alias("above"))
    near = F.when(F.col("c") > 1, F.lit(0.0)).otherwise(F.col("d"))
    found = strong.join(down, ["x", "y"]).join(_nearest(places, n), ["x", "y"], "left").select("x", "y", "strength", (F.col("above") - F.col("c") * F.col("strength")).alias("raw"), near.alias("near"))
    out = flat.join(found, ["x", "y"], "left").select(F.col("_row").alias(row), F.coalesce("strength", F.lit(0)).alias("strength"), F.coalesce("raw", F.lit(0)).alias("raw"), "near")
    return out.select(row, "strength", "raw", (F.col("raw") + F.coalesce(1 / (2 + F.col("near")), F.lit(0.5))).alias("fitness"))


def _strips(points: DataFrame, name: str, n: int) -> Column:
    """Which of at most 64 ranges of a column, of about STRIP_POINTS or more, a row is in."""
    k = min(64, -(-n // STRIP_POINTS))
    cuts = sorted(set(points.approxQuantile(name, [i / k for i in range(1, k)], 0.2 / k))) if k > 1 else []
    return sum(((F.col(name) > x).cast("int") for x in cuts), F.lit(0))


def _sums_before(rank: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each place the sum of w over those places before it whose rank (a permutation) is less: by merges, level by level."""
    n, out = len(w), np.zeros(len(w), np.int64)
    at, size = np.arange(n), 1
    while size < n:
        order = np.argsort(at // (2 * size) * n + rank, kind="stable")
        left = at[order] % (2 * size) < size
        sums = np.append(0, np.cumsum(np.where(left, w[order], 0)))
        first = at[order] // (2 * size) * (2 * size)  # a pair of runs stands where it stood
        gain = sums[:-1] - sums[first]
        out[order[~left]] += gain[~left]
        size *= 2
    return out


def _ranked(*keys: np.ndarray) -> np.ndarray:
    """The rank of each row by keys, the last one first."""
    out = np.empty(len(keys[0]), np.int64)
    out[np.lexsort(keys)] = np.arange(len(out))
    return out


def _sums_below(points: DataFrame, n: int) -> DataFrame:
    """x, y, s: of distinct points (x, y, w) the sum of w over those nowhere greater, with themselves.

    Those in the same range of x are counted there, those in lower ranges of x but the same one of y there, and the others by range.
    """
    import pandas as pd

    dealt = kept(points.select("x", "y", "w", _strips(points, "x", n).alias("i"), _strips(points, "y", n).alias("j")), "dealt")
    cells = dealt.groupBy("i", "j").agg(F.sum("w").alias("w")).collect()  # at most 64 x 64
    grid = np.zeros((65, 65), np.int64)
    for r in cells:
        grid[r.i + 1, r.j + 1] = r.w
    grid = grid.cumsum(axis=0).cumsum(axis=1)

    def beside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"], ignore_index=True)
        y, w = pdf["y"].to_numpy(), pdf["w"].to_numpy()
        inside = _sums_before(_ranked(np.arange(len(y)), y), w) + w
        return pdf[["x", "y"]].assign(s=inside + grid[pdf["i"].to_numpy(), pdf["j"].to_numpy()])

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "i"], ignore_index=True)
        i, w = pdf["i"].to_numpy(), pdf["w"].to_numpy()
        return pdf[["x", "y"]].assign(s=_sums_before(_ranked(-np.arange(len(i)), i), w))

    schema = "x double, y double, s long"
    return dealt.groupBy("i").applyInPandas(beside, schema).unionByName(dealt.groupBy("j").applyInPandas(across, schema)).groupBy("x", "y").agg(F.sum("s").alias("s"))


def _nearest_of(queries: np.ndarray, points: np.ndarray, best: np.ndarray) -> np.ndarray:
    """The least distance of each query to a point other than itself, no more than best: outward along the axis of more values, until the gap there is no less."""
    if not len(queries) or not len(points):
        return best
    axis = int(len(np.unique(points[:, 1])) > len(np.unique(points[:, 0])))
    points, best = points[np.argsort(points[:, axis], kind="stable")], best.copy()
    starts = np.searchsorted(points[:, axis], queries[:, axis])
    for step in (1, -1):
        at = starts if step > 0 else starts - 1
        open_ = np.arange(len(queries))
        while True:
            inside = (at >= 0) & (at < len(points))
            open_, at = open_[inside], at[inside]
            gap = np.abs(points[at, axis] - queries[open_, axis])
            closer = gap < best[open_]
            open_, at = open_[closer], at[closer]
            if not len(open_):
                break
            q, p = queries[open_], points[at]
            d = np.sqrt((p[:, 0] - q[:, 0]) ** 2 + (p[:, 1] - q[:, 1]) ** 2)
            best[open_] = np.minimum(best[open_], np.where((p == q).all(axis=1), np.inf, d))
            at = at + step
    return best


def _nearest(points: DataFrame, n: int) -> DataFrame:
    """x, y, d: the distance from each of distinct points to the nearest other; none if there is no other. First within ranges of x, then in the other ranges that are less far."""
    import pandas as pd

    dealt = kept(points.select("x", "y", _strips(points, "x", n).alias("i")), "dealt")
    ends = [(r.i, r.lo, r.hi) for r in dealt.groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()]  # at most 64

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = pdf[["x", "y"]].to_numpy()
        d = _nearest_of(xy, xy, np.full(len(xy), np.inf))
        own = int(pdf["i"].iloc[0])
        out = [pdf[["x", "y"]].assign(d=d, i=-1)]
        for i, lo, hi in ends:
            far = np.maximum(lo - xy[:, 0], xy[:, 0] - hi)
            if i != own:
                out.append(pdf[["x", "y"]].assign(d=d, i=i)[far < d])
        return pd.concat(out, ignore_index=True)

    def elsewhere(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        best = _nearest_of(asked[["x", "y"]].to_numpy(), there[["x", "y"]].to_numpy(), asked["d"].to_numpy())
        return asked[["x", "y"]].assign(d=best)

    first = kept(dealt.groupBy("i").applyInPandas(inside, "x double, y double, d double, i int"), "near")
    second = first.where("i >= 0").groupBy("i").cogroup(dealt.groupBy("i")).applyInPandas(elsewhere, "x double, y double, d double")
    both = first.where("i < 0").select("x", "y", "d").unionByName(second)
    return both.groupBy("x", "y").agg(F.min("d").alias("d")).select("x", "y", F.when(F.col("d") < float("inf"), F.col("d")).alias("d"))


def _spea2_by_pairs(points: DataFrame, objectives: Objectives, row: str) -> DataFrame:
    names = [n for n, _ in objectives]
    a = points.select(F.col(row).alias("a_row"), *(F.col(n).alias(f"a_{n}") for n in names))
    b = points.select(F.col(row).alias("b_row"), *(F.col(n).alias(f"b_{n}") for n in names))
    beats = a.join(b, dominates(objectives, "a_", "b_")).select("a_row", "b_row")
    strength = a.select("a_row").join(beats.groupBy("a_row").agg(F.count(F.lit(1)).alias("strength")), "a_row", "left").select("a_row", F.coalesce("strength", F.lit(0)).alias("strength"))
    raw = beats.join(strength, "a_row").groupBy("b_row").agg(F.sum("strength").alias("raw"))
    d = F.sqrt(sum((F.pow(F.col(f"a_{n}") - F.col(f"b_{n}"), F.lit(2.0)) for n in names), F.lit(0.0)))
    near = a.join(b, F.col("a_row") != F.col("b_row")).groupBy("a_row").agg(F.min(d).alias("near"))
    out = strength.join(raw.withColumnRenamed("b_row", "a_row"), "a_row", "left").join(near, "a_row", "left")
    return out.select(F.col("a_row").alias(row), "strength", F.coalesce("raw", F.lit(0)).alias("raw"), (F.coalesce("raw", F.lit(0)) + F.coalesce(1 / (2 + F.col("near")), F.lit(0.5))).alias("fitness"))


def limits(points: DataFrame, objectives: Objectives) -> DataFrame:
    """The least and greatest value of each objective."""
    return points.agg(*(f(n).alias(f"{p}_{n}") for n, _ in objectives for p, f in (("min", F.min), ("max", F.max))))
