"""Every core query with SQL equals DuckDB's result on the smallest tables."""

import importlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MODULES = [importlib.import_module(m) for m in entry.PARTS]
#: Queries that SQL cannot express, and the test that holds each one's operator against a plain version.
PLAIN = {
    "d06_tree": "test_d06_tree_is_the_plain_one", "e08_importance": "test_d06_tree_is_the_plain_one", "d09_forest": "test_d09_forest_is_the_plain_one", "i03_perceptron": "test_i03_perceptron_is_the_plain_one", "i05_least_squares": "test_i05_least_squares_is_a_fit_of_the_rows_so_far",
    "i06_extra_trees": "test_i06_extra_tree_is_the_plain_one", "i08_hoeffding_tree": "test_i08_hoeffding_tree_is_the_plain_one", "i13_mauve_tree": "test_i12_to_i14_qualities_are_the_plain_ones", "i15_total_mauve_tree": "test_i15_total_mauve_is_about_least_squares", "p03_non_dominated_sort_customers": "test_ranks_are_those_of_chains",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(x):
    return None if x is None or isinstance(x, float) and math.isnan(x) else 0.0 if x == 0 and isinstance(x, float) else x


@pytest.mark.parametrize("name", [n for m in MODULES for n in m.ORACLE_SQL])
def test_query(spark, duck, name):
    module = next(m for m in MODULES if name in m.QUERIES)
    df = module.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    done = duck.execute(module.ORACLE_SQL[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in done.fetchall()), key=str)
    assert got == want


def test_queries_without_sql_have_a_plain_version():
    without = {n for m in MODULES for n in m.QUERIES if n not in m.ORACLE_SQL}
    here = os.path.dirname(__file__)
    tests = "".join(open(os.path.join(here, f)).read() for f in ("test_plain_models.py", "test_operators.py"))
    assert without == set(PLAIN) and all(f"def {t}(" in tests for t in PLAIN.values())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
