"""Queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from sievelight.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that find nothing in tables as small as these.
NOTHING_HERE = {"rules_pages", "entropy_tokens_documents", "own_rules_documents"}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_registry():
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries) and set(catalogue.QUERIES) <= set(queries)
    assert all(callable(q) for q in queries.values()) and all(isinstance(s, str) for s in oracle.values())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows(spark, tables, name):
    want = tables.sql(catalogue.ORACLE[name])
    df = catalogue.QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    at = [want.columns.index(c) for c in order]
    got = [tuple(r[c] for c in order) for r in df.collect()]
    assert sorted(got, key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
    assert got or name in NOTHING_HERE


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
