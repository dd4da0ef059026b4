"""Near-duplicate links and classes against all pairs, on groups of copies with a few words changed."""

import re
from collections import Counter

import numpy as np

from strandline.llm import dedup


def _texts(rng, groups):
    out = []
    for size, words, most in groups:
        base = [f"w{k}" for k in rng.integers(0, 4000, words)]
        for _ in range(size):
            copy = list(base)
            for at in rng.integers(0, words, rng.integers(0, most + 1)):
                copy[at] = f"x{rng.integers(0, 10**9)}"
            out.append(" ".join(copy))
    return [out[k] for k in rng.permutation(len(out))]


def _links(texts):
    """All pairs of at least 0.8 by counts over an inverted index of (shingle, which occurrence)."""
    holders, size = {}, []
    for k, t in enumerate(texts):
        w = re.findall(r"[a-z0-9]+", t)
        bag = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        size.append(sum(bag.values()))
        for shingle, n in bag.items():
            for nth in range(n):
                holders.setdefault((shingle, nth), []).append(k)
    by_text = [[] for _ in texts]
    for members in holders.values():
        for k in members:
            by_text[k].append(members)
    size = np.array(size)
    for k, lists in enumerate(by_text):
        common = np.bincount(np.concatenate(lists), minlength=len(texts))
        for j in np.flatnonzero(common >= 0.8 * (size[k] + size - common) - 1e-9):
            if j > k:
                yield k, int(j)


def test_recall_against_all_pairs(spark):
    rng = np.random.default_rng(12)
    groups = [(700, 200, 4), (300, 120, 3), (60, 90, 2), *[(3, 150, 2)] * 200, *[(1, 150, 0)] * 400]
    texts = _texts(rng, groups)
    assert len(texts) >= 2000
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in dedup.near_duplicates(rows).select("doc_id", "class_id").collect()}
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    links = list(_links(texts))
    for a, b in links:
        root[find(a)] = find(b)
    caught = sum(got[a] == got[b] for a, b in links) / len(links)
    assert len(links) > 50_000 and caught >= 0.99
    # Nothing is joined that all pairs keep apart.
    least = {}
    for k in range(len(texts)):
        least.setdefault(got[k], set()).add(find(k))
    assert all(len(s) == 1 for s in least.values())
    assert len(least) <= len({find(k) for k in range(len(texts))}) * 1.01


def test_sets_of_a_large_group_meet_once(spark):
    rng = np.random.default_rng(8)
    sets = {k + 1: [*map(int, np.flatnonzero(rng.random(100) < 0.95))] for k in range(60)}
    bags = spark.createDataFrame(list(sets.items()), "fp long, bag array<long>")
    placed = spark.createDataFrame([(k, len(v), k) for k, v in sets.items()], "fp long, n long, root long")
    met = [(r.a, r.b) for r in dedup.met_pairs(dedup.rare_prefixes(bags, placed, 0.8), 0.8).collect()]
    near = {(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})}
    assert near and near <= set(met) and len(met) <= 1.1 * len(set(met))
