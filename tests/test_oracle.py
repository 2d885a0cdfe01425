"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lodestone.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{FOLDER}/{f}')")
    return c


def canonical(rows):
    return sorted(repr(tuple(x)) for x in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = duck.execute(ORACLE_SQL[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    want = [[r[order.index(c)] for c in columns] for r in result.fetchall()]
    assert canonical([[r[c] for c in columns] for r in df.collect()]) == canonical(want)


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLE_SQL) == {"entity_activation", "retrieve_linear", "retrieve_linear_local", "vector_topk_candidates"}
