"""Queries for sources, samplers, trees, incremental learners and search, with SQL where it can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import sampling
from larkspur.plans.store import shared_folder
from larkspur.session import table
from larkspur.sources import files
from larkspur.streaming import learners

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put



# sources


@query("SELECT CAST(p_size AS DOUBLE) AS size, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS price, p_partkey AS k, p_brand AS brand, p_size > 25 AS large FROM part")
def s01_arff(spark, sf_dir):
    """Parts written as ARFF and read again: numbers, whole numbers, a nominal, a boolean and missing values."""
    p = table(spark, sf_dir, "part")
    brands = [r.p_brand for r in p.select("p_brand").distinct().orderBy("p_brand").collect()]  # a nominal's values are few
    head = ["% parts", "@relation parts", "@attribute size numeric", "@attribute price real", "@attribute k integer", "@attribute brand {" + ",".join(f"'{b}'" for b in brands) + "}", "@attribute large {yes, no}", "@data"]
    price = F.when(c("p_partkey") % 7 != 0, c("p_retailprice").cast("string")).otherwise("?")
    rows = p.select(F.concat_ws(", ", c("p_size").cast("string"), price, c("p_partkey").cast("string"), F.concat(F.lit("'"), c("p_brand"), F.lit("'")), F.when(c("p_size") > 25, "yes").otherwise("no")).alias("value"))
    return _arff(spark, rows, head).select("size", "price", "k", "brand", "large")


def _arff(spark: SparkSession, rows: DataFrame, head: list[str]) -> DataFrame:
    path = f"{shared_folder(spark)}/source-{uuid.uuid4().hex}.arff"
    rows.write.text(path)  # a folder: a file for the header beside those of the rows
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.mode("append").text(path)
    return files.read_arff(spark, path)


@query("SELECT s_acctbal AS balance, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier")
def s05_jdb(spark, sf_dir):
    path = f"{shared_folder(spark)}/source-{uuid.uuid4().hex}.jdb"
    rows = table(spark, sf_dir, "supplier").select(F.lit(1).alias("o"), F.concat_ws(" ", c("s_acctbal").cast("string"), c("s_nationkey").cast("string")).alias("value"))
    rows.unionByName(spark.createDataFrame([(0, "; suppliers\nsuppliers\nbalance numerical nation symbolic")], "o int, value string")).coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    return files.read_jdb(spark, path)


@query("SELECT CAST(l_linenumber AS DOUBLE) AS label, round(l_quantity, 2) AS f1, round(l_tax, 2) AS f3 FROM lineitem")
def s13_libsvm(spark, sf_dir):
    path = f"{shared_folder(spark)}/source-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "lineitem").select(F.concat(c("l_linenumber").cast("string"), F.lit(" 1:"), c("l_quantity").cast("string"), F.lit(" 3:"), c("l_tax").cast("string")).alias("value"))
    rows.write.text(path)
    return files.read_libsvm(spark, path).select("label", F.round(c("features")[1], 2).alias("f1"), F.round(c("features")[3], 2).alias("f3"))


@query("SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS at, p_retailprice AS f1, CAST(p_size AS DOUBLE) AS f2 FROM part")
def s14_front_file(spark, sf_dir):
    path = f"{shared_folder(spark)}/source-{uuid.uuid4().hex}"
    table(spark, sf_dir, "part").orderBy("p_partkey").select(F.concat_ws(" ", c("p_retailprice").cast("string"), c("p_size").cast("string")).alias("value")).coalesce(1).write.text(path)
    return files.read_front(spark, path, 2)




@query("SELECT i AS value, i * 2 AS twice FROM range(200) t(i)")
def k06_random_source(spark, sf_dir):
    """A batch of the endless source."""
    return files.random_batch(spark, 200, {"twice": c("value") * 2})


# samplers



@query("SELECT i AS row_id, CAST(CASE WHEN i = 0 THEN 0 WHEN i = 1 THEN 1 ELSE 0.5 END AS DOUBLE) AS x0, CAST(CASE WHEN i = 2 THEN -1 WHEN i = 3 THEN 3 ELSE 1 END AS DOUBLE) AS x1 FROM range(4) t(i)")
def r11_edge_points(spark, sf_dir):
    return sampling.edge_points(spark, [0.0, -1.0], [1.0, 3.0])



@query("SELECT l_linenumber AS k, round(exp(-power((l_linenumber - 3) / 2.0, 2) / 2) / (2 * sqrt(2 * pi())), 6) AS pdf FROM lineitem GROUP BY 1")
def r06_gaussian_pdf(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(c("l_linenumber").alias("k")).distinct().select("k", F.round(sampling.gaussian_pdf(c("k").cast("double"), 3.0, 2.0), 6).alias("pdf"))


@query("SELECT round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd, round(0.9 * stddev_pop(l_quantity), 6) AS reinforced FROM lineitem")
def r08_diagonal_gaussian(spark, sf_dir):
    g = sampling.DiagonalGaussian.of(table(spark, sf_dir, "lineitem"), ["l_quantity"])
    after = g.reinforced([1.0], 0.1)
    return spark.range(1).select(*(F.lit(round(float(v), 6)).alias(k) for k, v in (("mean", g.mean[0]), ("sd", g.sd[0]), ("reinforced", after.sd[0]))))





# incremental learners


@query()
def i03_perceptron(spark, sf_dir):
    """Learning curves of a perceptron on each ship year's rows."""
    return _curve(spark, sf_dir, lambda: learners.Perceptron(2))


@query()
def i05_least_squares(spark, sf_dir):
    return _curve(spark, sf_dir, lambda: learners.OnlineLeastSquares(2))


@query()
def i08_hoeffding_tree(spark, sf_dir):
    """Learning curves of a model tree split by deviation reduction."""
    return _curve(spark, sf_dir, lambda: learners.HoeffdingTree(2, learners.StandardDeviationReduction()))


@query()
def i13_mauve_tree(spark, sf_dir):
    return _curve(spark, sf_dir, lambda: learners.HoeffdingTree(2, learners.ExtendedMauve(), learners.Perceptron))


@query()
def i06_extra_trees(spark, sf_dir):
    """An ensemble of random trees that all see every row."""
    return _curve(spark, sf_dir, lambda: learners.Ensemble([learners.ExtraTree(2, 5, s) for s in range(5)]))


def _curve(spark, sf_dir, make):
    """Curves of each year's items in order of their keys."""
    x = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("seq"), c("l_quantity").alias("q"), (c("l_discount") * 100).alias("d"), (c("l_extendedprice") / 1000).alias("y"))
    curve = learners.replay(x, make, ["q", "d"], "y", "seq", "year", 500)
    return curve.select("year", "rows", F.round("rmse", 6).alias("rmse"), F.round("rrse", 6).alias("rrse"))


@query("""WITH x AS (SELECT l_quantity AS q, l_discount * 100 AS d, l_extendedprice / 1000 AS y FROM lineitem), s AS (SELECT regr_slope(y, q) AS a, regr_slope(y, d) AS b, avg(y) AS y, avg(q) AS q, avg(d) AS d FROM x)
SELECT round(y - a * q - b * d, 5) AS bias, round(a, 6) AS w_quantity, round(b, 6) AS w_discount FROM s""")
def i04_simple_regressions(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(c("l_quantity").alias("q"), (c("l_discount") * 100).alias("d"), (c("l_extendedprice") / 1000).alias("y"))
    w = learners.simple_regression(x, ["q", "d"], "y").weights
    return spark.range(1).select(F.lit(round(w[0], 5)).alias("bias"), F.lit(round(w[1], 6)).alias("w_quantity"), F.lit(round(w[2], 6)).alias("w_discount"))


@query("SELECT l_linenumber AS n, round(CASE WHEN l_linenumber > 0 THEN sqrt(ln(1 / 0.01) / (2 * l_linenumber)) ELSE 1 END, 6) AS bound FROM lineitem GROUP BY 1")
def i10_hoeffding_bound(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").select(c("l_linenumber").alias("n")).distinct()
    bound = F.when(c("n") > 0, F.sqrt(F.ln(F.lit(1 / 0.01)) / (2 * c("n")))).otherwise(1.0)
    return n.select("n", F.round(bound, 6).alias("bound"))



