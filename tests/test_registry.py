"""Every registered query beside its SQL on the smallest tables."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from scripts.compare import plain

DIRECTORY = "/root/testdata/sf0.001"
CHECKS = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in pathlib.Path(DIRECTORY).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def test_every_check_belongs_to_a_query():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIRECTORY)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    if name not in CHECKS:
        assert got
        return
    cursor = duck.execute(CHECKS[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_flagship(spark):
    assert entry.entry(spark).columns[0] == "tool"


@pytest.mark.parametrize("name", ["retry_loops", "cost_by_dimension", "attachments_by_key"])
def test_results_do_not_depend_on_partitioning(spark, name):
    seen = []
    for partitions in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        df = QUERIES[name](spark, DIRECTORY)
        seen.append(sorted(map(tuple, df.collect()), key=repr))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]
