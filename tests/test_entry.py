"""Every core query against its SQL on the smallest tables, where they are there."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from marginalia import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if pd.isna(value) else round(value, 5)
    return None if value is None or value is pd.NA else value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in core.QUERIES.items() if sql))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    relation = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in relation.description]
    want = rows(names, relation.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert got == want


def test_queries_without_sql_run(spark):
    for name in ("chunk_vocabulary",):
        assert entry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["entity_id", "distance", "score", "chunk_index"]
