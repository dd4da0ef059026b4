"""Graph queries over all links of the lineitem table against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from strandline.operators import graph
from strandline.plans import queries as q


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("links")
    rng = np.random.default_rng(11)
    rows = [(o, n, int(rng.integers(1, 40)), "RAN"[int(rng.integers(0, 3))]) for o in range(16) for n in range(1, 5)]
    rows += [(20, 1, 3, "A"), (20, 2, 7, "R"), (20, 3, 8, "R"), (20, 4, 9, "A"), (21, 1, 3, "N"), (21, 2, 11, "N"), (22, 1, 3, "R"), (22, 2, 12, "R")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(p, f"b{p % 3}") for p in range(41)], "p_partkey long, p_brand string").write.parquet(f"{path}/part.parquet")
    links = defaultdict(set)
    for a, b in zip(rows, rows[1:], strict=False):
        if a[0] == b[0] and a[2] != b[2]:
            links[str(a[2]), str(b[2])].add(a[3])
    return str(path), {k: "ambiguous" if v == {"R"} else "resolved" for k, v in links.items()}


def _reach(edges, start, most):
    depth, front = {start: 0}, [start]
    for d in range(1, most + 1):
        front = sorted({b for a, b in edges if a in front} - set(depth))
        depth |= dict.fromkeys(front, d)
    return depth


def test_all_links_are_used(spark, fixture):
    path, links = fixture
    run = lambda name: q.queries()[name](spark, path).collect()
    assert max(Counter(a for a, _ in links).values()) > 2
    assert {r.node: r.degree for r in run("degree")} == Counter(x for e in links for x in e)
    assert {r.node: r.depth for r in run("impact")} == {n: d for n, d in _reach(links, "3", 3).items() if d}
    both = {*links, *((b, a) for a, b in links)}
    assert {r.node: r.depth for r in run("ego_graph")} == _reach(both, "7", 2)
    far = _reach(links, "3", 8).get(max(b for _, b in links))
    found = run("shortest_path")
    assert [r.hops for r in found] == ([] if far is None else [far])
    for r in found:
        steps = r.path.split(">")
        assert all(e in links for e in zip(steps, steps[1:], strict=False))
    every = {n: set(_reach(links, n, 99)) for e in links for n in e}
    want = {n: frozenset(m for m in every[n] if n in every[m]) for n in every}
    for found in (graph.strong_components(q._links(spark, path)), graph.strong_components(q._links(spark, path), 0)):
        parts = defaultdict(set)
        for r in found.collect():
            parts[r.component].add(r.node)
        assert {frozenset(p) for p in parts.values()} == set(want.values()) and all(min(p) == c for c, p in parts.items())
    brand = lambda n: f"b{int(n) % 3}"
    count, worst = Counter(), defaultdict(bool)
    for (a, b), conf in links.items():
        if brand(a) != brand(b):
            count[brand(a), brand(b)] += 1
            worst[brand(a), brand(b)] |= conf == "ambiguous"
    assert {((r.source, r.target), r["count"], r.worst_is_ambiguous) for r in run("rollup_brands")} == {(k, n, worst[k]) for k, n in count.items()}


def test_rounds_leave_no_tables_behind(spark, fixture):
    import os

    from strandline.sources import tables

    folder = tables.shared_folder(spark).removeprefix("file://")
    links = q._links(spark, fixture[0])
    before = set(os.listdir(folder))
    found = graph.bfs(links, spark.createDataFrame([("3",)], "node string"), 3)
    left = [n for n in set(os.listdir(folder)) - before if n.startswith("cut-")]
    assert len(left) == 1 and found.count() > 1


@pytest.mark.parametrize("most", [graph.LOCAL_EDGES, 0])
def test_a_node_linked_to_itself_only_is_a_component(spark, most):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), ("d", None), ("e", "a")], "src string, dst string")
    found = {(r.node, r.component) for r in graph.strong_components(links, most).collect()}
    assert found == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d"), ("e", "e"), (None, None)}


def test_a_ring_of_more_than_a_million_links_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(graph, "spread_components", lambda links: pytest.fail("by joins, a round for each link"))
    links = spark.range(1_200_000).selectExpr("cast(id AS string) AS src", "cast((id + 1) % 1200000 AS string) AS dst")
    found = graph.strong_components(links).groupBy("component").count().collect()
    assert [tuple(r) for r in found] == [("0", 1_200_000)]


def test_a_long_cycle_is_walked_without_copies_of_its_path(spark):
    import time

    n = 200_000
    links = spark.range(n).selectExpr("cast(id AS string) AS src", f"cast((id + 1) % {n} AS string) AS dst")
    began = time.monotonic()
    found = graph.example_cycle(links, [str(k) for k in range(n)]).first()
    assert found.hops == n and found.path == [*map(str, range(n)), "0"] and time.monotonic() - began < 40
