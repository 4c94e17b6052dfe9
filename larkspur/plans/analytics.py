"""Queries for aggregates, table operators, splits, metrics, Pareto sets and bandits, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import metrics as m
from larkspur.functions import stats as a
from larkspur.operators import bandit, frame, pareto, split
from larkspur.plans import expr
from larkspur.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    """Registers a function as a query, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, so that sums in another order are equal."""
    return df.select(*(F.round(x, digits).alias(x) if t == "double" else c(x) for x, t in df.dtypes))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by key with a row id; the price of some is null."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.when(c("o_orderkey") % 9 != 0, c("o_totalprice")).alias("price"))
    return frame.with_row_id(o, "o_orderkey")


_ORDERS = "(SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS row_id, o_orderkey, o_custkey, o_orderpriority, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS price FROM orders)"

# flagship


@query("""
WITH s AS (SELECT CASE WHEN l_quantity IS NULL THEN 2 WHEN l_quantity >= 24.5 THEN 1 ELSE 0 END AS branch, count(*) AS n, sum(l_extendedprice) AS s, avg(l_extendedprice) AS mean, var_pop(l_extendedprice) AS variance, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1),
w AS (SELECT var_pop(l_extendedprice) AS v, count(*) AS n FROM lineitem)
SELECT CAST(branch AS INTEGER) AS branch, s.n, round(s, 2) AS total, round(mean, 4) AS mean, round(variance, 2) AS variance, low, high, round((w.v - (SELECT sum(s.n * s.variance) FROM s) / w.n) / w.v, 6) AS score FROM s, w""")
def stump_variance_reduction(spark, sf_dir):
    """Price by the branches of a stump on quantity, and how much of its variance they remove."""
    x = table(spark, sf_dir, "lineitem").select("l_extendedprice", frame.branch(c("l_quantity") >= 24.5).alias("branch"))
    p = c("l_extendedprice")
    each = x.groupBy("branch").agg(F.count(p).alias("n"), F.sum(p).alias("s"), F.avg(p).alias("m"), F.var_pop(p).alias("v"), F.min(p).alias("low"), F.max(p).alias("high"), F.sum(p * p).alias("q"))
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    whole = each.agg((q / n - F.pow(s / n, F.lit(2.0))).alias("w"), (F.sum(c("n") * c("v")) / n).alias("left"))
    return each.join(F.broadcast(whole)).select("branch", "n", F.round("s", 2).alias("total"), F.round("m", 4).alias("mean"), F.round("v", 2).alias("variance"), "low", "high", F.round((c("w") - c("left")) / c("w"), 6).alias("score"))


# across columns


@query("SELECT l_orderkey * 10 + l_linenumber AS k, round((coalesce(CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END, 0) + l_discount + l_tax) / 3, 6) AS mean FROM lineitem")
def a01_row_mean(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    return x.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("k"), F.round(a.row_mean(F.when(c("l_linenumber") % 3 != 0, c("l_quantity")), c("l_discount"), c("l_tax")), 6).alias("mean"))


@query("""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS k, list_filter([CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END, l_discount, l_tax], lambda v: v IS NOT NULL) AS v FROM lineitem)
SELECT k, CAST(len(v) AS INTEGER) AS count, round(list_sum(v), 6) AS sum, round(list_sum(list_transform(v, lambda z: z * z)), 5) AS sumsq, list_min(v) AS min, list_max(v) AS max FROM x""")
def a02_row_stats(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    s = a.row_stats(F.when(c("l_linenumber") % 3 != 0, c("l_quantity")), c("l_discount"), c("l_tax"))
    return x.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("k"), s.alias("s")).select("k", "s.count", F.round("s.sum", 6).alias("sum"), F.round("s.sumsq", 5).alias("sumsq"), "s.min", "s.max")


_V = "list_transform(embedding[{}:{}], lambda x: CAST(x AS DOUBLE))"


@query(f"SELECT vec_id, round(list_sum(list_transform(list_zip({_V.format(1, 8)}, {_V.format(9, 16)}), lambda z: abs((z[1] + z[2]) / 3))), 5) AS l1 FROM embeddings")
def a03_row_vector_mean(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").withColumn("e", F.transform("embedding", lambda v: v.cast("double")))
    mean = a.row_vector_mean(F.slice("e", 1, 8), F.slice("e", 9, 8), F.lit(None).cast("array<double>"))
    return x.select("vec_id", F.round(F.aggregate(mean, F.lit(0.0), lambda s, v: s + F.abs(v)), 5).alias("l1"))


@query(f"""WITH z AS (SELECT vec_id, list_zip({_V.format(1, 8)}, {_V.format(9, 16)}) AS z FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(z, lambda p: (p[1] + p[2]) / 2)), 5) AS means, round(list_sum(list_transform(z, lambda p: abs(p[1] - p[2]) / 2)), 5) AS sds, round(list_sum(list_transform(z, lambda p: greatest(p[1], p[2]))), 5) AS tops FROM z""")
def a04_row_vector_stats(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").withColumn("e", F.transform("embedding", lambda v: v.cast("double")))
    s = x.select("vec_id", a.row_vector_stats(8, F.slice("e", 1, 8), F.slice("e", 9, 8)).alias("s"))
    total = lambda f: F.round(F.aggregate("s", F.lit(0.0), lambda z, v: z + v[f]), 5)
    return s.select("vec_id", total("mean").alias("means"), total("stddev").alias("sds"), total("max").alias("tops"))


# moments


@query("""WITH x AS (SELECT l_returnflag, l_extendedprice AS x, l_quantity AS w FROM lineitem), s AS (SELECT l_returnflag, sum(w) AS w, sum(x * w) AS s, sum(x * x * w) AS q FROM x GROUP BY 1)
SELECT l_returnflag, w AS count, round(s, 2) AS sum, round(s / w, 4) AS mean, round(q / w - (s / w) * (s / w), 2) AS variance, round(sqrt(q / w - (s / w) * (s / w)), 4) AS stddev FROM s""")
def a06_weighted_stats(spark, sf_dir):
    x, w = c("l_extendedprice"), c("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        a.weighted_count(x, w).alias("count"), F.round(a.weighted_sum(x, w), 2).alias("sum"), F.round(a.weighted_mean(x, w), 4).alias("mean"), F.round(a.variance(x, w), 2).alias("variance"), F.round(a.stddev(x, w), 4).alias("stddev")
    )


@query("""SELECT c_mktsegment, count(c_acctbal) AS count, round(sum(c_acctbal), 4) AS sum, round(avg(c_acctbal), 6) AS mean, round(var_pop(c_acctbal), 4) AS variance, round(stddev_pop(c_acctbal), 6) AS stddev, min(c_acctbal) AS min, max(c_acctbal) AS max, round(max(c_acctbal) - min(c_acctbal), 6) AS range FROM customer GROUP BY 1""")
def a10_full_statistics(spark, sf_dir):
    s = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(a.statistics(c("c_acctbal")).alias("s")).select("c_mktsegment", "s.*")
    return s.select("c_mktsegment", "count", F.round("sum", 4).alias("sum"), F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round("stddev", 6).alias("stddev"), "min", "max", F.round("range", 6).alias("range"))


@query("""SELECT c_mktsegment, round(sum(CASE WHEN c_nationkey > 4 THEN c_acctbal ELSE 0 END) / sum(CASE WHEN c_nationkey > 4 THEN 1.0 ELSE 0.0 END), 6) AS mean, sum(CASE WHEN c_nationkey > 4 THEN 1.0 ELSE 0.0 END)::DOUBLE AS count FROM customer GROUP BY 1""")
def a09_subtract(spark, sf_dir):
    """All customers, and those of five nations again with weight -1: as if they had never been added."""
    x = table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal", "c_nationkey", F.lit(1).alias("w"))
    x = x.unionByName(x.where("c_nationkey <= 4").withColumn("w", F.lit(-1)))
    return x.groupBy("c_mktsegment").agg(F.round(a.weighted_mean(c("c_acctbal"), c("w")), 6).alias("mean"), a.weighted_count(c("c_acctbal"), c("w")).alias("count"))


@query("""SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(var_pop(value) OVER w, 2) AS variance FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def a12_recent_mean(spark, sf_dir):
    """Moving mean and variance of each user's last ten values."""
    e, order = table(spark, sf_dir, "events"), ["ts", "event_id"]
    return e.select("event_id", F.round(a.recent_mean(c("value"), order, 10, ["user_id"]), 6).alias("mean"), F.round(a.recent_variance(c("value"), order, 10, ["user_id"]), 2).alias("variance"))


_PAIRS = "(SELECT l_returnflag AS g, count(*)::DOUBLE AS n, sum(x * y) AS xy, sum(x) AS x, sum(x * x) AS xx, sum(y) AS y, sum(y * y) AS yy, corr(x, y) AS textbook FROM (SELECT l_returnflag, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem) GROUP BY 1)"


@query(f"""SELECT g, round((n * xy - x * y) / (sqrt((n - 1) * xx - x * x) * sqrt((n - 1) * yy - y * y)), 6) AS correlation, round(textbook, 6) AS textbook,
round((n * xy - x * y) / (n * xx - x * x), 6) AS slope, round((y - (n * xy - x * y) / (n * xx - x * x) * x) / n, 5) AS intercept,
round((xy - x * y / n) * (xy - x * y / n) / (xx - x * x / n) / (yy - y * y / n), 6) AS r2, round(sqrt((yy - y * y / n - (xy - x * y / n) * (xy - x * y / n) / (xx - x * x / n)) / (n - 1)), 5) AS residual_sd FROM {_PAIRS}""")
def a14_pair_statistics(spark, sf_dir):
    """Correlation (both forms), slope, intercept, R squared and residual deviation from six sums."""
    x, y = c("l_quantity"), c("l_extendedprice") / 1000
    names = ["n", "xy", "x", "xx", "y", "yy"]
    s = table(spark, sf_dir, "lineitem").groupBy(c("l_returnflag").alias("g")).agg(*(v.alias(k) for k, v in a.pair_sums(x, y).items()), a.textbook_correlation(x, y).alias("textbook"))
    z = {k: c(k) for k in names}
    return s.select("g", F.round(a.correlation(z), 6).alias("correlation"), F.round("textbook", 6).alias("textbook"), F.round(a.slope(z), 6).alias("slope"), F.round(a.intercept(z), 5).alias("intercept"), F.round(a.r_squared(z), 6).alias("r2"), F.round(a.residual_sd(z), 5).alias("residual_sd"))


@query("""WITH x AS (SELECT l_quantity AS a, l_discount * 100 AS b, l_extendedprice / 1000 AS y FROM lineitem), s AS (SELECT count(*)::DOUBLE AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(a*a) AS aa, sum(a*b) AS ab, sum(b*b) AS bb, sum(a*y) AS ay, sum(b*y) AS by_, sum(y*y) AS yy FROM x),
z AS (SELECT *, aa - a*a/n AS saa, ab - a*b/n AS sab, bb - b*b/n AS sbb, ay - a*y/n AS say, by_ - b*y/n AS sby, yy - y*y/n AS syy FROM s),
w AS (SELECT *, (say*sbb - sby*sab) / (saa*sbb - sab*sab) AS wa, (sby*saa - say*sab) / (saa*sbb - sab*sab) AS wb FROM z)
SELECT round((y - wa*a - wb*b) / n, 5) AS bias, round(wa, 6) AS w_quantity, round(wb, 6) AS w_discount, round(sqrt((syy - wa*say - wb*sby) / (n - 1)), 5) AS residual_sd, round(say*say/saa/syy + sby*sby/sbb/syy, 6) AS r2_sum FROM w""")
def a19_least_squares(spark, sf_dir):
    """Weights of a linear model of price, its residual deviation, and the inputs' R squared summed."""
    x = table(spark, sf_dir, "lineitem").select(c("l_quantity").alias("a"), (c("l_discount") * 100).alias("b"), (c("l_extendedprice") / 1000).alias("y"))
    fit = a.least_squares(x, ["a", "b"], "y")
    w = fit.weights()
    values = [round(float(w[0]), 5), round(float(w[1]), 6), round(float(w[2]), 6), round(fit.residual_sd(), 5), round(fit.r_squared_sum(), 6)]
    return spark.range(1).select(*(F.lit(v).alias(n) for v, n in zip(values, ["bias", "w_quantity", "w_discount", "residual_sd", "r2_sum"])))


# confusion


@query("""WITH s AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE AS tp, count(*) FILTER (quality = 1 AND toxic = 0)::DOUBLE AS fp, count(*) FILTER (quality = 0 AND toxic = 0)::DOUBLE AS tn, count(*) FILTER (quality = 0 AND toxic = 1)::DOUBLE AS fn FROM labels)
SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round(tp / (tp + (fp + fn) / 2), 6) AS f1,
round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(2 * tp / (tp + fn) * tn / (tn + fp) / (tp / (tp + fn) + tn / (tn + fp)), 6) AS harmonic FROM s""")
def a23_confusion_matrix(spark, sf_dir):
    """Confusion of two labels and all that follows from it."""
    s = table(spark, sf_dir, "labels").agg(*(v.alias(k) for k, v in a.confusion(c("quality") == 1, c("toxic") == 1).items()))
    z = {k: c(k) for k in ("tp", "fp", "tn", "fn")}
    parts = {"accuracy": a.accuracy, "precision": a.precision, "recall": a.recall, "specificity": a.specificity, "f1": a.f1, "mcc": a.matthews, "harmonic": a.sensitivity_and_specificity}
    return s.select(*z, *(F.round(f(z), 6).alias(k) for k, f in parts.items()))


@query("SELECT CAST(CASE WHEN o_totalprice < 50000 THEN -1 WHEN o_totalprice > 400000 THEN 7 ELSE least(floor((o_totalprice - 50000) / 50000), 6) END AS INTEGER) AS bin, count(*) AS n FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1")
def a28_histogram(spark, sf_dir):
    return a.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 50000.0, 400000.0, 50000.0)


@query("SELECT o_orderpriority, sum(o_totalprice)::DOUBLE AS w, 0.0 AS x FROM orders GROUP BY 1".replace("sum(o_totalprice)::DOUBLE AS w, 0.0 AS x", "round(sum(o_totalprice), 2) AS weight, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 6) AS proportion"))
def a29_shares(spark, sf_dir):
    """Weights and proportions of labels."""
    return a.shares(table(spark, sf_dir, "orders"), "o_orderpriority", c("o_totalprice")).select("o_orderpriority", F.round("weight", 2).alias("weight"), F.round("proportion", 6).alias("proportion"))


@query("SELECT label, " + ", ".join(f"round(avg(CAST(embedding[{i + 1}] AS DOUBLE)), 5) AS m{i}" for i in range(64)) + " FROM embeddings GROUP BY 1")
def a31_mean_vector(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").groupBy("label").agg(a.mean_vector(F.transform("embedding", lambda v: v.cast("double")), 64).alias("m"))
    return x.select("label", *(F.round(c("m")[i], 5).alias(f"m{i}") for i in range(64)))


@query("SELECT l_linenumber AS point, round(avg(l_extendedprice), 4) AS value FROM lineitem GROUP BY 1")
def a32_average_curves(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(c("l_linenumber").alias("point"), c("l_extendedprice").alias("value"))
    return a.average_curves(x, "point", "value").select("point", F.round("value", 4).alias("value"))


# tables


@query(f"SELECT row_id, o_orderkey, CAST(NULL AS VARCHAR) AS remark FROM {_ORDERS}")
def t01_add_column(spark, sf_dir):
    return frame.add_column(orders(spark, sf_dir), "remark", "string").select("row_id", "o_orderkey", "remark")


@query("SELECT s_suppkey AS k, s_acctbal AS v FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def t02_append_rows(spark, sf_dir):
    return frame.append_rows(table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("k"), c("s_acctbal").alias("v")), table(spark, sf_dir, "customer").select(c("c_custkey").alias("k"), c("c_acctbal").alias("v")))


@query(f"SELECT i AS row_id, o_orderkey FROM range((SELECT count(*) + 5 FROM orders)) t(i) LEFT JOIN {_ORDERS} o ON o.row_id = i")
def t03_resize(spark, sf_dir):
    o = orders(spark, sf_dir).select("row_id", "o_orderkey")
    n = o.count()
    return frame.resize(o, n + 5, n)


@query(f"SELECT row_id, CASE WHEN row_id = 7 THEN -1 ELSE o_orderkey END AS o_orderkey FROM {_ORDERS} WHERE row_id IN (7, 8)")
def t04_cells(spark, sf_dir):
    o = frame.set_cell(orders(spark, sf_dir).select("row_id", "o_orderkey"), 7, "o_orderkey", -1)
    return frame.row(o, 7).unionByName(frame.row(o, 8))


@query(f"SELECT row_id, price FROM {_ORDERS}")
def t05_column_by_key(spark, sf_dir):
    o = orders(spark, sf_dir)
    return o.select("row_id", o.columns[frame.find_column(o, "price")])




@query(f"SELECT row_id, o_orderkey FROM {_ORDERS} WHERE row_id >= 100 AND row_id < 250")
def t08_slice(spark, sf_dir):
    return frame.between(orders(spark, sf_dir), 100, 250).select("row_id", "o_orderkey")


@query(f"SELECT row_id, o_orderkey FROM {_ORDERS} WHERE row_id < 100 OR row_id >= 250")
def t09_antislice(spark, sf_dir):
    return frame.outside(orders(spark, sf_dir), 100, 250).select("row_id", "o_orderkey")



@query(f"SELECT CAST(f AS INTEGER) AS fold, row_id, (row_id % 5) = f AS test FROM {_ORDERS}, range(5) t(f)")
def t12_kfold(spark, sf_dir):
    return frame.every_fold(orders(spark, sf_dir).select("row_id"), 5).select("fold", "row_id", "test")


@query("SELECT i AS row_id, round(sqrt(power(-4 + 8 * ((i * 37) % 101) / 100, 2) + power(-4 + 8 * ((i * 53) % 103) / 102, 2)), 6) AS y FROM range(1000) t(i)")
def t13_sampled_function(spark, sf_dir):
    """A paraboloid over rows drawn by a rule of the row id."""
    x = {"x1": -4 + 8 * ((c("row_id") * 37) % 101) / 100, "x2": -4 + 8 * ((c("row_id") * 53) % 103) / 102}
    return frame.sampled_function(spark, 1000, x, F.sqrt(F.pow("x1", F.lit(2)) + F.pow("x2", F.lit(2)))).select("row_id", F.round("y", 6).alias("y"))


@query("SELECT i AS row_id FROM range(20, 90) t(i)")
def t15_interval(spark, sf_dir):
    return frame.interval(spark, 20, 90)




@query(f"SELECT CAST(CASE WHEN price IS NULL THEN 2 WHEN price > 150000 THEN 1 ELSE 0 END AS INTEGER) AS branch, count(*) AS n FROM {_ORDERS} GROUP BY 1")
def t19_three_way_partition(spark, sf_dir):
    return orders(spark, sf_dir).groupBy(frame.branch(c("price") > 150000).alias("branch")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, coalesce(max(l_tax) - min(l_tax) <= 1e-9, true) AS constant FROM lineitem GROUP BY 1")
def t20_is_constant(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(frame.is_constant(c("l_tax")).alias("constant"))


@query(f"SELECT o_orderpriority, arg_max(o_orderkey, {{'p': price, 'r': -row_id}}) AS best FROM {_ORDERS} WHERE price IS NOT NULL GROUP BY 1")
def t22_argbest(spark, sf_dir):
    return orders(spark, sf_dir).where("price is not null").groupBy("o_orderpriority").agg(frame.best(c("o_orderkey"), c("price")).alias("best"))


@query("SELECT i AS row_id, r_name FROM range(12) t(i) JOIN region ON r_regionkey = i % 5")
def t23_repeat_to(spark, sf_dir):
    r = frame.with_row_id(table(spark, sf_dir, "region"), "r_regionkey")
    return frame.repeat_to(r, 12, 5).select("row_id", "r_name")


@query("SELECT vec_id, CAST(coalesce(list_position(list_transform(embedding, lambda x: CAST(floor(x * 8) AS INTEGER)), 2), 0) - 1 AS INTEGER) AS at FROM embeddings")
def t24_find_element(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", frame.find_element(F.transform("embedding", lambda x: F.floor(x * 8).cast("int")), 2).alias("at"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_suppkey % 10 = c_custkey % 10)")
def t25_exists(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select("c_custkey", c("c_nationkey").alias("n"), (c("c_custkey") % 10).alias("m"))
    return frame.exists(x, table(spark, sf_dir, "supplier").select(c("s_nationkey").alias("n"), (c("s_suppkey") % 10).alias("m")), ["n", "m"]).select("c_custkey")


@query(f"WITH r AS (SELECT price, row_number() OVER (ORDER BY price, row_id) - 1 AS i, count(*) OVER () AS n FROM {_ORDERS} WHERE price IS NOT NULL) SELECT min(price) AS min, max(CASE WHEN i = n // 4 THEN price END) AS q25, max(CASE WHEN i = n // 2 THEN price END) AS q50, max(CASE WHEN i = 3 * n // 4 THEN price END) AS q75, max(price) AS max FROM r")
def t26_quartiles(spark, sf_dir):
    return frame.quartiles(orders(spark, sf_dir), "price")


@query("SELECT CAST(i AS INTEGER) AS copy, r_regionkey FROM region, range(3) t(i)")
def t28_duplicated(spark, sf_dir):
    return frame.duplicated(table(spark, sf_dir, "region"), 3).select("copy", "r_regionkey")


# expressions

_TREE = expr.Test(expr.Stump((expr.Variable("q"),), 20.0), expr.Constant(1.0), expr.Test(expr.Stump((expr.Variable("d"),), 0.05), expr.Constant(2.0), expr.Constant(3.0), expr.Constant(-3.0)), expr.Constant(-1.0))
_TREE_INPUT = "(SELECT l_orderkey * 10 + l_linenumber AS k, CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity END AS q, CASE WHEN l_suppkey % 3 <> 0 THEN l_discount END AS d, l_tax AS t FROM lineitem)"


def tree_input(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("k"), F.when(c("l_linenumber") % 4 != 0, c("l_quantity")).alias("q"), F.when(c("l_suppkey") % 3 != 0, c("l_discount")).alias("d"), c("l_tax").alias("t"))


@query(f"SELECT k, CAST(CASE WHEN q IS NULL THEN -1 WHEN q >= 20 THEN CASE WHEN d IS NULL THEN -3 WHEN d >= 0.05 THEN 3 ELSE 2 END ELSE 1 END AS DOUBLE) AS y FROM {_TREE_INPUT}")
def e05_test_node(spark, sf_dir):
    """A tree of three-way tests as one column."""
    return tree_input(spark, sf_dir).select("k", _TREE.column().alias("y"))


@query(f"SELECT k, round((coalesce(q, 0) + coalesce(q * q + t, 0) + t) / 3, 6) AS y FROM {_TREE_INPUT}")
def e04_ensemble(spark, sf_dir):
    """The mean of three expressions, one of them held as a column."""
    q, t = expr.Variable("q"), expr.Variable("t")
    square = expr.Apply("*", (q, q))
    memo = expr.Memo(tree_input(spark, sf_dir)).hold(square, "qq")
    return memo.frame.select("k", F.round(a.row_mean(memo.column(q), memo.column(expr.Apply("+", (square, t))), memo.column(t)), 6).alias("y"))


@query(f"SELECT k, round(1.5 + 2 * q - 3 * t, 6) AS linear, round(0.5 + 2 * (q - 25) / 45 - 1 * (t - 0.04) / 0.06, 6) AS normalised FROM {_TREE_INPUT}")
def e09_linear_models(spark, sf_dir):
    """A linear model and one of normalised inputs."""
    lin, norm = expr.Linear(("q", "t"), (1.5, 2.0, -3.0)), expr.NormalisedLinear(("q", "t"), (0.5, 2.0, -1.0), (25.0, 0.04), (15.0, 0.02))
    return tree_input(spark, sf_dir).select("k", F.round(lin.column(), 6).alias("linear"), F.round(norm.column(), 6).alias("normalised"))


@query(f"SELECT k, CAST(CASE WHEN t < 0.03 THEN 1 WHEN t < 0.06 THEN 2 ELSE 3 END AS DOUBLE) AS axis, round(CASE WHEN t > 0.03 THEN 1 + 2 * t ELSE 5 - t END, 6) AS mean, CASE WHEN t > 0.03 THEN 0.5 ELSE 0.25 END::DOUBLE AS variance FROM {_TREE_INPUT}")
def e11_trees(spark, sf_dir):
    """An axis-aligned tree and a tree of linear leaves."""
    axis = expr.AxisTree("t", 0.03, expr.Constant(1.0), expr.AxisTree("t", 0.06, expr.Constant(2.0), expr.Constant(3.0)))
    stream = expr.StreamTree("t", 0.03, expr.StreamLeaf(expr.Linear(("t",), (5.0, -1.0)), 0.25), expr.StreamLeaf(expr.Linear(("t",), (1.0, 2.0)), 0.5))
    x = tree_input(spark, sf_dir).select("k", axis.column().alias("axis"), stream.column().alias("s"))
    return x.select("k", "axis", F.round("s.mean", 6).alias("mean"), "s.variance")


# splits

_H = lambda s: "(" + " + ".join(f"CASE WHEN {w} > 0 THEN -({w}) / ({s}) * log2(({w}) / ({s})) ELSE 0 END" for w in ("{a}", "{n}", "{r}")) + ")"


@query("""WITH x AS (SELECT CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity END AS q, l_returnflag AS f FROM lineitem), b AS (SELECT CASE WHEN q IS NULL THEN 2 WHEN q >= 24.5 THEN 1 ELSE 0 END AS branch, f, count(*)::DOUBLE AS w FROM x GROUP BY 1, 2),
n AS (SELECT sum(w) AS n FROM b), hy AS (SELECT sum(-w / n * log2(w / n)) AS h FROM (SELECT f, sum(w) AS w FROM b GROUP BY f), n), s AS (SELECT branch, sum(w) AS w FROM b GROUP BY branch),
hs AS (SELECT sum(-w / n * log2(w / n)) AS h FROM s, n), hc AS (SELECT sum(-b.w / n * log2(b.w / s.w)) AS h FROM b JOIN s USING (branch), n)
SELECT round(2 * (hy.h - hc.h) / (hy.h + hs.h), 8) AS score FROM hy, hs, hc""")
def d01_information_gain(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.when(c("l_linenumber") % 4 != 0, c("l_quantity")).alias("q"), c("l_returnflag").alias("f"))
    return split.score_condition(x, c("q") >= 24.5, split.InformationGain("f", ("A", "N", "R"))).select(F.round("score", 8).alias("score"))


@query("""WITH x AS (SELECT l_quantity >= 24.5 AS b, l_extendedprice / 1000 AS y, l_tax * 100 AS z FROM lineitem), s AS (SELECT b, count(*) AS n, var_pop(y) + var_pop(z) AS v FROM x GROUP BY b), w AS (SELECT count(*) AS n, var_pop(y) + var_pop(z) AS v FROM x)
SELECT round((w.v - (SELECT sum(n * v) FROM s) / w.n) / w.v, 6) AS score FROM w""")
def d02_vector_variance_reduction(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_quantity", (c("l_extendedprice") / 1000).alias("y"), (c("l_tax") * 100).alias("z"))
    return split.score_condition(x, c("l_quantity") >= 24.5, split.VarianceReduction(("y", "z"))).select(F.round("score", 6).alias("score"))


@query("""WITH g AS (SELECT l_quantity AS x, count(*)::DOUBLE AS n, sum(l_extendedprice / 1000) AS s, sum(l_extendedprice / 1000 * l_extendedprice / 1000) AS q FROM lineitem GROUP BY 1),
p AS (SELECT x, lead(x) OVER w AS nx, sum(n) OVER w AS n1, sum(s) OVER w AS s1, sum(q) OVER w AS q1 FROM g WINDOW w AS (ORDER BY x)), t AS (SELECT sum(n) AS n, sum(s) AS s, sum(q) AS q FROM g),
c AS (SELECT (x + nx) / 2 AS threshold, 1 - (q1 - s1 * s1 / n1 + (q - q1) - (s - s1) * (s - s1) / (n - n1)) / (q - s * s / n) AS score FROM p, t WHERE nx IS NOT NULL)
SELECT threshold, round(score, 6) AS score FROM c ORDER BY c.score DESC LIMIT 1""")
def d03_best_threshold(spark, sf_dir):
    """The quantity at which a split removes most of the variance of the price."""
    x = table(spark, sf_dir, "lineitem").select("l_quantity", (c("l_extendedprice") / 1000).alias("y"))
    return split.best_threshold(x, "l_quantity", split.VarianceReduction(("y",))).select("threshold", F.round("score", 6).alias("score"))



# metrics

_SCORED = "(SELECT l_extendedprice / 1000 AS y, CASE WHEN l_linenumber % 5 <> 0 THEN l_quantity * 1.5 END AS p FROM lineitem)"


@query(f"""WITH x AS (SELECT y, coalesce(p, 0) AS p FROM {_SCORED}), t AS (SELECT avg(y) AS m FROM x), s AS (SELECT sum((y - p) * (y - p)) AS e, count(*) AS n, sum((y - m) * (y - m)) AS d FROM x, t)
SELECT round(e / n, 5) AS mse, round(sqrt(e / n), 6) AS rmse, round(1 / (1 + sqrt(e / n)), 6) AS nrmse, round(sqrt(e / d), 6) AS rrse FROM s""")
def m01_regression_metrics(spark, sf_dir):
    """M1-M4."""
    x = table(spark, sf_dir, "lineitem").select((c("l_extendedprice") / 1000).alias("y"), F.when(c("l_linenumber") % 5 != 0, c("l_quantity") * 1.5).alias("p"))
    x = x.join(F.broadcast(x.agg(F.avg("y").alias("mean"))))
    y, p = c("y"), c("p")
    return x.agg(F.round(m.mse(y, p), 5).alias("mse"), F.round(m.rmse(y, p), 6).alias("rmse"), F.round(m.normalised_rmse(y, p), 6).alias("nrmse"), F.round(m.rrse(y, p, c("mean")), 6).alias("rrse"))


@query("SELECT round(avg(((l_quantity - l_linenumber * 7) * (l_quantity - l_linenumber * 7) + (l_tax * 100 - 4) * (l_tax * 100 - 4)) / 2), 5) AS mse FROM lineitem")
def m05_multi_mse(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    return x.agg(F.round(m.multi_mse(F.array(c("l_quantity"), c("l_tax") * 100), F.array((c("l_linenumber") * 7).cast("double"), F.lit(4.0))), 5).alias("mse"))


@query("""SELECT round(count(*) FILTER ((CASE WHEN l_linenumber % 3 <> 0 THEN l_tax > 0.04 END) IS NOT DISTINCT FROM (CASE WHEN l_linenumber % 4 <> 0 THEN l_discount > 0.04 END)) / count(*), 6) AS binary_accuracy,
round(count(*) FILTER (l_linenumber % 3 = l_suppkey % 3) / count(*), 6) AS label_accuracy, round(count(*) FILTER (l_linenumber % 2 = CASE WHEN l_discount >= l_tax THEN 0 ELSE 1 END) / count(*), 6) AS argmax_accuracy FROM lineitem""")
def m06_accuracy(spark, sf_dir):
    """M6 and M7."""
    x = table(spark, sf_dir, "lineitem")
    b = m.binary_accuracy(F.when(c("l_linenumber") % 3 != 0, c("l_tax") > 0.04), F.when(c("l_linenumber") % 4 != 0, c("l_discount") > 0.04))
    return x.agg(F.round(b, 6).alias("binary_accuracy"), F.round(m.class_accuracy(c("l_linenumber") % 3, c("l_suppkey") % 3), 6).alias("label_accuracy"), F.round(m.class_accuracy(c("l_linenumber") % 2, F.array("l_discount", "l_tax"), True), 6).alias("argmax_accuracy"))


@query("""WITH x AS (SELECT l_returnflag = 'R' AS t, (l_discount - 0.05) * 20 AS s, l_linenumber % 3 AS k, [l_discount * 10, l_tax * 10, 0.3] AS v FROM lineitem), y AS (SELECT *, CASE WHEN t THEN 1.0 ELSE -1.0 END AS g FROM x)
SELECT round(sum((s - g) * (s - g)), 4) AS square, round(sum(greatest(1 - g * s, 0)), 4) AS hinge, round(sum(exp(-g * s)), 4) AS exponential, round(sum(ln(1 + exp(-g * s))), 4) AS log_binomial,
round(sum(list_sum(list_transform([0, 1, 2], lambda i: greatest(1 - CASE WHEN i = k THEN 1 ELSE -1 END * v[i + 1], 0)))), 4) AS one_against_all,
round(sum(greatest(1 - (v[k + 1] - list_max(list_transform(list_filter([0, 1, 2], lambda i: i <> k), lambda i: v[i + 1]))), 0)), 4) AS most_violated FROM y""")
def m11_losses(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select((c("l_returnflag") == "R").alias("t"), ((c("l_discount") - 0.05) * 20).alias("s"), (c("l_linenumber") % 3).alias("k"), F.array(c("l_discount") * 10, c("l_tax") * 10, F.lit(0.3)).alias("v"))
    t, s = c("t"), c("s")
    parts = {"square": m.square_loss(F.when(t, 1.0).otherwise(-1.0), s), "hinge": m.hinge_loss(t, s), "exponential": m.exponential_loss(t, s), "log_binomial": m.log_binomial_loss(t, s), "one_against_all": m.one_against_all(c("k"), c("v")), "most_violated": m.most_violated(c("k"), c("v"))}
    return x.agg(*(F.round(F.sum(v), 4).alias(k) for k, v in parts.items()))


# Pareto sets

PART = [("p_retailprice", -1), ("p_size", 1)]
_FRONT = "(SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice)))"


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")


@query(f"SELECT * FROM {_FRONT}")
def p02_pareto_front_2d(spark, sf_dir):
    """Cheap and large parts."""
    return pareto.front(parts(spark, sf_dir), PART)


@query("SELECT s_suppkey FROM supplier a WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_acctbal >= a.s_acctbal AND b.s_nationkey >= a.s_nationkey AND b.s_suppkey % 17 >= a.s_suppkey % 17 AND (b.s_acctbal > a.s_acctbal OR b.s_nationkey > a.s_nationkey OR b.s_suppkey % 17 > a.s_suppkey % 17))")
def p02_pareto_front_3d(spark, sf_dir):
    x = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey", (c("s_suppkey") % 17).alias("m"))
    return pareto.front(x, [("s_acctbal", 1), ("s_nationkey", 1), ("m", 1)]).select("s_suppkey")


@query("""WITH RECURSIVE pts AS (SELECT n_nationkey AS k, n_regionkey AS x, length(n_name) AS y FROM nation), d AS (SELECT a.k AS worse, b.k AS better FROM pts a JOIN pts b ON b.x >= a.x AND b.y >= a.y AND (b.x > a.x OR b.y > a.y)),
r AS (SELECT k, 0 AS rank FROM pts UNION SELECT d.worse, r.rank + 1 FROM r JOIN d ON d.better = r.k) SELECT k, CAST(max(rank) AS INTEGER) AS rank FROM r GROUP BY k""")
def p03_non_dominated_sort(spark, sf_dir):
    """Ranks of nations by region and length of name."""
    x = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("k"), c("n_regionkey").alias("x"), F.length("n_name").alias("y"))
    return pareto.ranks(x, [("x", 1), ("y", 1)]).select("k", "rank")


@query()
def p03_non_dominated_sort_customers(spark, sf_dir):
    """Ranks of all customers by balance and nation; in SQL, chains of so many points take too long."""
    x = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return pareto.ranks(x, [("c_acctbal", 1), ("c_nationkey", 1)])


@query("""WITH x AS (SELECT p_partkey, p_size, p_retailprice, lag(p_retailprice) OVER a AS a1, lead(p_retailprice) OVER a AS a2, lag(k) OVER b AS b1, lead(k) OVER b AS b2, max(p_retailprice) OVER s - min(p_retailprice) OVER s AS ra, max(k) OVER s - min(k) OVER s AS rb
FROM (SELECT p_partkey, p_size, p_retailprice + p_partkey * 1e-4 AS p_retailprice, p_partkey AS k FROM part) WINDOW s AS (PARTITION BY p_size), a AS (PARTITION BY p_size ORDER BY p_retailprice, p_partkey), b AS (PARTITION BY p_size ORDER BY k))
SELECT p_partkey, CASE WHEN a1 IS NULL OR a2 IS NULL OR b1 IS NULL OR b2 IS NULL THEN -1 ELSE round((a2 - a1) / ra + (b2 - b1) / rb, 6) END AS crowding FROM x""")
def p04_crowding(spark, sf_dir):
    """Crowding of the parts of each size over price and key; -1 for the ends."""
    x = table(spark, sf_dir, "part").withColumn("price", c("p_retailprice") + c("p_partkey") * 1e-4)
    crowd = pareto.crowding(x, [("price", -1), ("p_partkey", 1)], ["p_size"])
    return crowd.select("p_partkey", F.when(c("crowding") == pareto.FAR, -1.0).otherwise(F.round("crowding", 6)).alias("crowding"))


@query(f"""WITH f AS (SELECT DISTINCT p_retailprice AS a, p_size AS b FROM {_FRONT}), d AS (SELECT sqrt(power(a - lag(a) OVER w, 2) + power(b - lag(b) OVER w, 2)) AS d FROM f WINDOW w AS (ORDER BY a, b)), g AS (SELECT d FROM d WHERE d IS NOT NULL)
SELECT round(coalesce(sum(abs(d - (SELECT avg(d) FROM g))) / nullif(sum(d), 0), 0), 6) AS spread FROM g""")
def p05_spread(spark, sf_dir):
    return pareto.spread(pareto.distinct_front(parts(spark, sf_dir), PART), PART).select(F.round("spread", 6).alias("spread"))


@query(f"""WITH f AS (SELECT DISTINCT -p_retailprice AS x, p_size AS y FROM {_FRONT} WHERE p_retailprice < 2000 AND p_size > 1), v AS (SELECT (x + 2000) * (y - coalesce(lag(y) OVER (ORDER BY x DESC), 1)) AS v FROM f) SELECT round(coalesce(sum(v), 0), 4) AS hypervolume FROM v""")
def p06_hypervolume(spark, sf_dir):
    return pareto.hypervolume(parts(spark, sf_dir), PART, (2000.0, 1.0)).select(F.round("hypervolume", 4).alias("hypervolume"))


@query(f"""WITH r AS (SELECT DISTINCT p_size AS s, p_retailprice AS p FROM {_FRONT}), o AS (SELECT DISTINCT a.p_size AS s, a.p_retailprice AS p FROM part a WHERE a.p_size <= 25 AND NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size <= 25 AND b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice)))
SELECT round(max(e), 6) AS epsilon FROM (SELECT r.s, r.p, min(greatest(o.p - r.p, r.s - o.s)) AS e FROM r, o GROUP BY 1, 2)""")
def p07_epsilon(spark, sf_dir):
    """By how much the front of the smaller parts falls short of the front of all."""
    mine = pareto.distinct_front(parts(spark, sf_dir).where("p_size <= 25"), PART)
    return pareto.epsilon(mine, pareto.distinct_front(parts(spark, sf_dir), PART), PART).select(F.round("epsilon", 6).alias("epsilon"))


@query(f"SELECT least(4, (SELECT count(*) FROM (SELECT DISTINCT p_size, p_retailprice FROM {_FRONT}))) AS n")
def p08_archive(spark, sf_dir):
    return pareto.archive(parts(spark, sf_dir), PART, 4).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT s_suppkey AS k, s_acctbal AS x, s_suppkey % 13 AS y FROM supplier), d AS (SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON a.x >= b.x AND a.y >= b.y AND (a.x > b.x OR a.y > b.y)),
s AS (SELECT p.k, count(d.b) AS strength FROM p LEFT JOIN d ON d.a = p.k GROUP BY p.k), r AS (SELECT p.k, coalesce(sum(s.strength), 0) AS raw FROM p LEFT JOIN d ON d.b = p.k LEFT JOIN s ON s.k = d.a GROUP BY p.k),
n AS (SELECT a.k, min(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) AS near FROM p a JOIN p b ON a.k <> b.k GROUP BY a.k) SELECT s.k, strength, CAST(raw AS BIGINT) AS raw, round(raw + coalesce(1 / (2 + near), 0.5), 6) AS fitness FROM s JOIN r USING (k) LEFT JOIN n USING (k)""")
def p09_spea2(spark, sf_dir):
    x = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("k"), c("s_acctbal").alias("x"), (c("s_suppkey") % 13).alias("y"))
    return pareto.spea2(x, [("x", 1), ("y", 1)], "k").select("k", "strength", "raw", F.round("fitness", 6).alias("fitness"))


@query("SELECT min(p_retailprice) AS min_p_retailprice, max(p_retailprice) AS max_p_retailprice, min(p_size) AS min_p_size, max(p_size) AS max_p_size FROM part")
def p10_limits(spark, sf_dir):
    return pareto.limits(parts(spark, sf_dir), PART)


# bandits

_ARMS = "(SELECT event_type AS arm, count(value) AS n, avg(value / 100) AS mean, var_pop(value / 100) AS variance, min(value / 100) AS lo, max(value / 100) AS hi, (SELECT count(value) FROM events)::DOUBLE AS t FROM events GROUP BY 1)"


def arm_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(c("event_type").alias("arm"), (c("value") / 100).alias("r"))
    return bandit.with_total(bandit.arms(e, "arm", "r"))


@query(f"SELECT arm, n, round(mean, 6) AS mean, round(variance, 6) AS variance, round(lo, 6) AS min, round(hi, 6) AS max FROM {_ARMS}")
def b02_arm_stats(spark, sf_dir):
    return arm_stats(spark, sf_dir).select("arm", "n", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), F.round("min", 6).alias("min"), F.round("max", 6).alias("max"))


@query(f"""SELECT arm, round(mean + 2 / n, 6) AS pool, round(mean + 2 * sqrt(ln(t) / n), 6) AS ucb1, round(mean + sqrt(ln(t) / n * least(0.25, variance + sqrt(2 * ln(t) / n))), 6) AS tuned, round(mean + sqrt(16 * variance * n / (n - 1) * ln(t - 1) / n), 6) AS normal,
round(mean + sqrt(2 * variance * ln(t) / n) + 3 * ln(t) / n, 6) AS ucb_v, round(mean + 1 / n, 6) AS over_exploit, round(mean + sqrt(t) / sqrt(n), 6) AS power FROM {_ARMS}""")
def b03_indices(spark, sf_dir):
    """B1, B3 and B4."""
    i = {"pool": bandit.pool_index(), "ucb1": bandit.ucb1(), "tuned": bandit.ucb1_tuned(), "normal": bandit.ucb1_normal(), "ucb_v": bandit.ucb_v(), "over_exploit": bandit.over_exploit(), "power": bandit.power_index()}
    return arm_stats(spark, sf_dir).select("arm", *(F.round(v, 6).alias(k) for k, v in i.items()))


@query(f"SELECT arm, round(mean + 2 * sqrt(ln(t) / n), 6) AS index FROM {_ARMS} ORDER BY mean + 2 * sqrt(ln(t) / n) DESC, arm LIMIT 1")
def b06_choose(spark, sf_dir):
    return bandit.choose(arm_stats(spark, sf_dir), bandit.ucb1(), "arm").select("arm", F.round("index", 6).alias("index"))


@query("SELECT event_id, round(2.0 * 50 / (50 + event_id), 6) AS rate, CAST((user_id % 16) + ((event_id % 32) * 16) AS BIGINT) AS key FROM events")
def b07_schedules_and_keys(spark, sf_dir):
    """B7 and B8."""
    return table(spark, sf_dir, "events").select("event_id", F.round(bandit.hyperbolic(2.0, 50, c("event_id")), 6).alias("rate"), bandit.pack((c("user_id") % 16, 4), (c("event_id") % 32, 5)).alias("key"))
