"""Every query with SQL gives the same rows in another engine, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from stratalode.plans import detection_sql, oracle, queries

DATA = "/root/testdata/sf0.001"
SQL = oracle.SQL | detection_sql.SQL
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = queries.QUERIES[name](spark, DATA)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(con.sql(f"SELECT {columns} FROM ({SQL[name]})").fetchall(), key=repr)


def test_all_queries_are_known():
    import __spark_entry__

    assert set(SQL) == set(queries.QUERIES) and set(SQL) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
