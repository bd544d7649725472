"""Every engine query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallyforge.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted(map(repr, map(tuple, found.select(*columns).collect())))
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())
    assert sorted(names) == columns
    assert got == want


def test_registry():
    names = entry.queries()
    assert set(QUERIES) <= set(names) and set(ORACLE_SQL) <= set(entry.oracle_sql()) <= set(names)
