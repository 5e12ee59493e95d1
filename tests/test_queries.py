"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

from workload.registry import QUERIES, SQL

import __spark_entry__  # noqa: F401  (registers the queries)

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: 0.0 if isinstance(v, float) and v == 0 else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = _rows(df.columns, df.collect())
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert found == _rows(columns, result.fetchall())


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(SQL)
