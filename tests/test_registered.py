"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from catalore.registry import registered

ALL = registered()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(ALL))
def test_same_rows(spark, duck, small, name):
    run, sql = ALL[name]
    df = run(spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert sql, "a core query has its SQL"
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want
