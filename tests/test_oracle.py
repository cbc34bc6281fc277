"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    expected = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    ordered = lambda rows, names: sorted(tuple(plain(r[i]) for i in sorted(range(len(names)), key=lambda i: names[i])) for r in rows)
    assert ordered(rows, df.columns) == ordered(expected, names)


def test_entry(spark, sf):
    assert entry.entry(spark).where("rank = 1").count() == 5


def test_queries_without_sql_run(spark, sf):
    """Those that test_brute_force.py and the tests of their subpackage hold against plain loops; here they have rows."""
    for name in sorted({*QUERIES} - {*SQL}):
        if not name.startswith(("op", "pipeline")):
            assert QUERIES[name](spark, sf).count() > 0, name
