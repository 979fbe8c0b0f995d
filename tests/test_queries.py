"""Every registered query of the library against its SQL in DuckDB, at the smallest scale."""

import math
from random import Random

import duckdb
import pytest

import __spark_entry__
from plumbline.plans import file_queries, run_queries
from plumbline.plans.oracle import ORACLE_SQL, SETTINGS_SQL
from plumbline.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, abs_tol=2e-6)
    return a == b


def key(row):
    return tuple((x is not None, str(x)) if not isinstance(x, float) else (True, f"{x:.4f}") for x in row)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    compare(QUERIES[name](spark, SF), duck.execute(ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(SETTINGS_SQL))
def test_settings_and_texts(spark, duck, name):
    assert name not in __spark_entry__.queries() and name not in __spark_entry__.oracle_sql()
    compare((file_queries.SETTINGS | run_queries.SETTINGS)[name](spark, SF), duck.execute(SETTINGS_SQL[name]))


def compare(df, found):
    columns = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    order = [d[0] for d in found.description]
    assert sorted(order) == columns
    at = [order.index(c) for c in columns]
    theirs = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=key)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert all(map(same, a, b)), (a, b)


def test_queries_without_sql(spark):
    assert set(QUERIES) - set(ORACLE_SQL) == {"select_sampled"}
    rows = sorted((r.ord, r.id) for r in QUERIES["select_sampled"](spark, SF).collect())
    ids = sorted(r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect())
    assert rows == [(k, str(ids[i])) for k, i in enumerate(sorted(Random(42).sample(range(len(ids)), 200)))]


def test_entry(spark):
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).first().num_samples == 1500
