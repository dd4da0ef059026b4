"""Every query with SQL gives DuckDB's rows on the small tables."""

import os

import duckdb
import pytest

from strandline.plans import queries as q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def _plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    return round(float(v), 9)


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, duck, name):
    df = q.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = q.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(_plain(r[k]) for k in at) for r in result.fetchall()), key=repr)
    assert rows == want
