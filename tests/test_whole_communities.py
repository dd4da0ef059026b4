"""Communities: one algorithm at every size, over a graph that grows with the tables."""

import os
import tracemalloc

import duckdb
import numpy as np
import pytest

from strandline.operators import communities
from strandline.plans import queries as q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_size_does_not_choose_the_algorithm(spark, monkeypatch):
    monkeypatch.setattr(communities, "MAX_LOCAL_EDGES", 1, raising=False)
    rng = np.random.default_rng(3)
    pairs = {tuple(sorted(map(int, rng.integers(0, 40, 2)))) for _ in range(120)}
    edges = [(f"n{a:02}", f"n{b:02}", 1.0) for a, b in sorted(pairs) if a != b]
    found = communities.detect(spark.createDataFrame(edges, "a string, b string, w double"))
    assert {r.node: r.community for r in found.collect()} == communities.leiden(edges)


def _modularity(edges, label):
    m = sum(w for _, _, w in edges)
    inner = sum(w for a, b, w in edges if label[a] == label[b])
    degree = {}
    for a, b, w in edges:
        for x in (a, b):
            degree[label[x]] = degree.get(label[x], 0) + w
    return inner / m - sum((d / (2 * m)) ** 2 for d in degree.values())


def test_leiden_by_joins_is_as_good_and_connected(spark):
    rng = np.random.default_rng(5)
    pairs = set()
    for _ in range(2600):
        a = int(rng.integers(0, 240))
        b = int(rng.integers(0, 240)) if rng.random() < 0.15 else a // 30 * 30 + int(rng.integers(0, 30))
        if a != b:
            pairs.add((min(a, b), max(a, b)))
    edges = [(f"n{a:03}", f"n{b:03}", 1.0 + (a + b) % 3) for a, b in sorted(pairs)]
    df = spark.createDataFrame(edges, "a string, b string, w double")
    spread = {r.node: r.community for r in communities.detect(df, "spread leiden").collect()}
    alone = communities.leiden(edges)
    assert set(spread) == set(alone)
    assert _modularity(edges, spread) >= 0.97 * _modularity(edges, alone)
    for c in set(spread.values()):
        members = {n for n, x in spread.items() if x == c}
        seen, stack = set(), [min(members)]
        while stack:
            n = stack.pop()
            if n not in seen:
                seen.add(n)
                stack += [b if a == n else a for a, b, _ in edges if n in (a, b) and (b if a == n else a) in members]
        assert seen == members
    empty = communities.detect(spark.createDataFrame([], "a string, b string, w double"), "spread leiden")
    assert empty.count() == 0


def test_query_covers_all_customers_and_suppliers(spark):
    nodes = {r.node for r in q.queries()["leiden_communities"](spark, SF).collect()}
    con = duckdb.connect()
    sold = f"'{SF}/lineitem.parquet' JOIN '{SF}/orders.parquet' ON l_orderkey = o_orderkey"
    want = con.execute(f"SELECT 'c' || o_custkey FROM {sold} UNION SELECT 's' || l_suppkey FROM {sold}").fetchall()
    assert nodes == {n for (n,) in want}


def test_leiden_by_components_is_that_of_the_whole(spark):
    rng = np.random.default_rng(7)
    edges = []
    for part, size in enumerate((3, 40, 30, 60, 2, 1, 25)):
        pairs = {tuple(sorted(map(int, rng.integers(0, size, 2)))) for _ in range(3 * size)}
        edges += [(f"n{a:02}.{part}", f"n{b:02}.{part}", 1.0 + (a * b) % 3) for a, b in sorted(pairs)]
    df = spark.createDataFrame(edges, "a string, b string, w double").repartition(3)
    want = communities.leiden(edges)
    for sizes in ({"part_edges": 1}, {"part_edges": 70}, {"part_edges": 70, "local_edges": 20}):
        assert {r.node: r.community for r in communities.leiden_by_parts(df, **sizes).collect()} == want
    assert communities.detect(df.limit(0)).count() == 0



def _bipartite(rng, left, right, m):
    pair = np.unique(rng.integers(0, left, m) * right + rng.integers(0, right, m))
    return pair // right, left + pair % right, rng.integers(1, 4, len(pair)).astype(float)


def _plain_move(a, b, w, n, label, part, mass):
    """The moves of a level as the reference has them, a dictionary for each node."""
    near = [{} for _ in range(n)]
    for x, y, z in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
        near[x][y] = near[y][x] = z
    degree = [sum(x.values()) for x in near]
    label, moved = list(label), True
    total = [0.0] * n
    for v in range(n):
        total[label[v]] += degree[v]
    while moved:
        moved = False
        for v in range(n):
            to = {}
            for u, z in near[v].items():
                if part is None or part[u] == part[v]:
                    to[label[u]] = to.get(label[u], 0.0) + z
            own = label[v]
            total[own] -= degree[v]
            best, gain = own, to.get(own, 0.0) - total[own] * degree[v] / mass
            for c in sorted(to):
                g = to[c] - total[c] * degree[v] / mass
                if g > gain + 1e-12 or (abs(g - gain) <= 1e-12 and c < best):
                    best, gain = c, g
            total[best] += degree[v]
            moved, label[v] = moved or best != own, best
    return label


@pytest.mark.parametrize(("piece", "many"), [(1 << 22, 128), (100, 1), (1, 10**9)])
def test_moves_over_arrays_are_those_of_the_reference(monkeypatch, piece, many):
    monkeypatch.setattr(communities, "PIECE", piece)
    monkeypatch.setattr(communities, "MANY", many)
    rng = np.random.default_rng(11)
    a, b, w = _bipartite(rng, 120, 30, 900)
    level = communities._Level([(a[:300], b[:300], w[:300]), (b[300:], a[300:], w[300:])], 150)
    mass = 2 * w.sum()
    label = np.arange(150)
    communities._move(level, label, None, mass)
    assert label.tolist() == _plain_move(a, b, w, 150, range(150), None, mass)
    fine = np.arange(150)
    communities._move(level, fine, label, mass)
    assert fine.tolist() == _plain_move(a, b, w, 150, range(150), label, mass)


def test_a_component_takes_few_bytes_an_edge(monkeypatch):
    monkeypatch.setattr(communities, "PIECE", 1 << 14)
    a, b, w = _bipartite(np.random.default_rng(13), 4000, 100, 150_000)
    assert len(a) > 120_000
    blocks = [(a[k : k + 8192].astype(np.int32), b[k : k + 8192].astype(np.int32), w[k : k + 8192].astype(np.uint8)) for k in range(0, len(a), 8192)]
    tracemalloc.start()
    list(communities._levels(blocks, 4100))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(a), peak / len(a)
