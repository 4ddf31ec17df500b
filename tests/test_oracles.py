"""Every query against its SQL in DuckDB."""

import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if n != "pipeline" and not re.match(r"op\d+_", n)]


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return str(v) if hasattr(v, "isoformat") else v


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.collect(), df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    ran = duck.execute(sql)
    names = [d[0] for d in ran.description]
    assert sorted(names) == sorted(df.columns)
    want = rows_of(ran.fetchall(), names)
    assert len(got) == len(want)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
