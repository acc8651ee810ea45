"""The queries that SQL can state, over whole tables."""

import pathlib

import duckdb
import pytest

from agentmeter.llm import queries
from scripts.compare import plain

DIRECTORY = "/root/testdata/sf0.01"
CHECKS = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in pathlib.Path(DIRECTORY).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, DIRECTORY)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    cursor = duck.execute(CHECKS[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
