"""Table operators over a frame with an explicit row id (inventory T1-T28).

A row id is a column of consecutive whole numbers from 0, made by with_row_id() from an
order; no operator here depends on the order in which Spark happens to hold rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.plans.store import kept

ROW = "row_id"


def with_row_id(df: DataFrame, *order: str | Column, name: str = ROW) -> DataFrame:
    """Consecutive ids in an order that has no ties.

    Rows are dealt by ranges of the order and written once, so that all readers see the
    same ranges; an id is the position in its range plus the rows of those before it, so
    no task holds more than a range.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    key = F.struct(*cols)
    names = df.select(key.alias("_key")).schema["_key"].dataType.names
    ranged = df.withColumn("_key", key).repartitionByRange(*(F.col(f"_key.{c}") for c in names))
    dealt = kept(ranged.withColumn("_part", F.spark_partition_id()), "ranges")
    at = F.row_number().over(Window.partitionBy("_part").orderBy("_key"))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return dealt.withColumn("_at", at).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") - 1).drop("_key", "_part", "_at", "_before")


def add_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """A column of nulls."""
    return df.withColumn(name, F.lit(None).cast(kind))


def append_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows, allowMissingColumns=True)


def resize(df: DataFrame, n: int, rows: int) -> DataFrame:
    """The first n of `rows` rows, or all with rows of nulls up to n."""
    kept = df.where(F.col(ROW) < n)
    if n <= rows:
        return kept
    return kept.unionByName(df.sparkSession.range(rows, n).select(F.col("id").alias(ROW)), allowMissingColumns=True).select(*df.columns)


def row(df: DataFrame, i: int) -> DataFrame:
    return df.where(F.col(ROW) == i)


def set_cell(df: DataFrame, i: int, column: str, value) -> DataFrame:
    return df.withColumn(column, F.when(F.col(ROW) == i, F.lit(value)).otherwise(F.col(column)))


def find_column(df: DataFrame, name: str) -> int:
    """Its position, or -1."""
    return df.columns.index(name) if name in df.columns else -1


def order_of(column: str, increasing: bool) -> list[Column]:
    """The sort keys of the inventory's flag, which is inverted (T6): `increasing` sorts downwards with nulls last."""
    x = F.col(column)
    return [x.desc_nulls_last() if increasing else x.asc_nulls_first(), F.col(ROW).asc()]


def sort(df: DataFrame, column: str, increasing: bool = True) -> DataFrame:
    return df.orderBy(*order_of(column, increasing))


def drawn_key(seed: int, *of: str | Column) -> Column:
    """A digest of a seed and columns, which any engine makes alike: the order of random choices."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *((F.col(c) if isinstance(c, str) else c).cast("string") for c in of)).cast("binary"))


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """A random order that depends on the row id and the seed alone."""
    return df.orderBy(drawn_key(seed, ROW), ROW)


def shuffled_places(df: DataFrame, seed: int, name: str = "place") -> DataFrame:
    """df with each row's place in that order, which outlasts the next shuffle."""
    return with_row_id(df, drawn_key(seed, ROW).alias("h"), F.col(ROW).alias("i"), name=name)


def between(df: DataFrame, begin: int, end: int) -> DataFrame:
    return df.where((F.col(ROW) >= begin) & (F.col(ROW) < end))


def outside(df: DataFrame, begin: int, end: int) -> DataFrame:
    """All rows but those of begin..end; none is lost (T9's intent)."""
    return df.where(~((F.col(ROW) >= begin) & (F.col(ROW) < end)))


def train_test(df: DataFrame, test_share: float, rows: int, seed: int) -> DataFrame:
    """Column `test`: a random floor(rows * (1 - test_share)) rows train. The cut is exact."""
    ranked = shuffled_places(df.select(ROW), seed, "_rank")
    return df.join(ranked, ROW).withColumn("test", F.col("_rank") >= int(rows * (1 - test_share))).drop("_rank")


def folds(df: DataFrame, k: int) -> DataFrame:
    """Column `fold`: row j is tested in fold j mod k."""
    return df.withColumn("fold", (F.col(ROW) % k).cast("int"))


def every_fold(df: DataFrame, k: int) -> DataFrame:
    """Each row once for each of the k folds, with whether it is tested there."""
    return df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("test", F.pmod(F.col(ROW) - F.col("fold"), F.lit(k)) == 0)


def sampled_function(spark: SparkSession, n: int, inputs: dict[str, Column], target: Column, seed_column: str = ROW) -> DataFrame:
    """Rows of inputs drawn by expressions of the row id, and a target computed from them."""
    df = spark.range(n).withColumnRenamed("id", ROW)
    return df.select(ROW, *(x.alias(name) for name, x in inputs.items())).withColumn("y", target)


def empty(spark: SparkSession, inputs: dict[str, str], target: tuple[str, str]) -> DataFrame:
    """A frame without rows of a domain's inputs and its supervision."""
    return spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in [*inputs.items(), target]))


def interval(spark: SparkSession, begin: int, end: int) -> DataFrame:
    return spark.range(begin, end).withColumnRenamed("id", ROW)


def subset(df: DataFrame, k: int, seed: int) -> DataFrame:
    """Exactly k rows (or all), in order of their ids."""
    return df.orderBy(drawn_key(seed, ROW), ROW).limit(k).orderBy(ROW)


def draw(seed: int, of: Column, *more: Column) -> Column:
    """A number of 0..1 made from a seed and columns: the first 52 bits of their digest, so the same on every run, partitioning and engine."""
    return F.conv(F.substring(drawn_key(seed, of, *more), 1, 13), 16, 10).cast("double") / float(2**52)


def bootstrap(df: DataFrame, rows: int, seed: int, bags: int = 1) -> DataFrame:
    """Rows drawn with replacement, as a column `multiplicity` (and `bag`); `rows` draws a bag."""
    draws = df.sparkSession.range(rows * bags).select(F.floor(F.col("id") / rows).cast("int").alias("bag"), F.floor(draw(seed, F.col("id")) * rows).cast("long").alias(ROW))
    return df.join(draws.groupBy("bag", ROW).agg(F.count(F.lit(1)).alias("multiplicity")), ROW)


def random_row(df: DataFrame, seed: int) -> DataFrame:
    return df.orderBy(drawn_key(seed, ROW), ROW).limit(1)


def branch(condition: Column) -> Column:
    """0 for false, 1 for true, 2 for null."""
    return F.when(condition.isNull(), F.lit(2)).when(condition, F.lit(1)).otherwise(F.lit(0))


def is_constant(y: Column) -> Column:
    """Whether all values lie within 1e-9 of each other's extremes; so for at most one row."""
    return F.coalesce(F.max(y) - F.min(y) <= 1e-9, F.lit(True))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order, F.col(ROW)).limit(n)


def best(value: Column, key: Column, largest: bool = True) -> Column:
    """The value of the row of best key; the first row wins a tie."""
    return F.max_by(value, F.struct(key, -F.col(ROW))) if largest else F.min_by(value, F.struct(key, F.col(ROW)))


def repeat_to(df: DataFrame, n: int, rows: int) -> DataFrame:
    """Rows from the start again until there are n."""
    wanted = df.sparkSession.range(n).select(F.col("id").alias("_at"), (F.col("id") % rows).alias(ROW))
    return wanted.join(df, ROW).withColumn(ROW, F.col("_at")).drop("_at")


def find_element(v: Column, x) -> Column:
    """First position from 0, or -1."""
    return (F.array_position(v, x) - 1).cast("int")


def exists(df: DataFrame, points: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns equal those of some point."""
    return df.join(points.select(*columns).distinct(), columns, "left_semi")


def quartiles(df: DataFrame, column: str) -> DataFrame:
    """min, q25, q50, q75, max: the values at positions n/4, n/2 and 3n/4 of the sorted column, not interpolated."""
    ranked = with_row_id(df.where(F.col(column).isNotNull()).select(column, ROW), F.col(column).alias("v"), F.col(ROW).alias("i"), name="_rank")
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))
    at = ranked.join(F.broadcast(n))
    pick = lambda p: F.max(F.when(F.col("_rank") == p, F.col(column)))
    q = lambda k: F.floor(F.col("_n") * k / 4)
    return at.agg(F.min(column).alias("min"), pick(q(1)).alias("q25"), pick(q(2)).alias("q50"), pick(q(3)).alias("q75"), F.max(column).alias("max"))


def roles(df: DataFrame) -> tuple[list[str], str | None]:
    """Input columns (all doubles) and the supervision (the last string)."""
    inputs = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    targets = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return inputs, targets[-1] if targets else None


def duplicated(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def picked(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ids are in another frame."""
    return df.join(ids.select(ROW).distinct(), ROW, "left_semi")


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
