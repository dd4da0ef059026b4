"""The queries of the corpus operators: against DuckDB where SQL says them, else against brute force on the tables."""

import os

import duckdb
import numpy as np
import pytest

from strandline.llm import ann, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_duckdb(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{SF}/{table}'")
    plain = lambda v: v if v is None or isinstance(v, (bool, str)) else round(float(v), 9)
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_nearest_neighbours_recall_on_the_table(spark, sf):
    found = queries.op10_nearest_neighbours(spark, sf).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    hits = asked = 0
    by_query = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append(r)
    assert set(by_query) == {int(i) for i in ids if i % ann.EVERY == 0}
    for at in np.flatnonzero(ids % ann.EVERY == 0):
        score = x @ x[at]
        order = [k for k in np.lexsort((ids, -score)) if k != at][: ann.K]
        mine = sorted(by_query[ids[at]], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(order) + 1))
        assert all(a.score > b.score or (a.score == b.score and a.vec_id < b.vec_id) for a, b in zip(mine, mine[1:], strict=False))
        hits += len({int(ids[k]) for k in order} & {r.vec_id for r in mine})
        asked += len(order)
    print(f"recall of {ann.K} nearest on {sf}: {hits / asked:.4f} over {len(by_query)} queries")
    assert hits / asked >= 0.9
