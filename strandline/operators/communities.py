"""Communities of a weighted undirected graph: Leiden, refinement, modularity, report.

Leiden moves nodes one at a time and each move sees the ones before, so ``leiden`` runs in one task for each
connected component of the graph of *files or symbols* (aggregated by Spark first).  ``spread_leiden`` moves
halves of the nodes at a time by joins, for components that no task holds.  The caller names the method; size chooses none.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import floor_to
from strandline.operators.graph import LOCAL_EDGES, file_of
from strandline.sources.tables import broadcast_if_small, cut, scoped, stored

MAX_LEVELS = 20
STILL = 200
_EPS = 1e-12


def adjacency(links: DataFrame, by_file: bool = False) -> DataFrame:
    """(a, b, w): undirected weights with a < b, without self loops."""
    src, dst = (file_of(F.col("src")), file_of(F.col("dst"))) if by_file else (F.col("src"), F.col("dst"))
    pairs = links.filter("kind = 'calls'").select(src.alias("s"), dst.alias("t")).filter("s <> t")
    return pairs.groupBy(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(F.count("*").cast("double").alias("w"))


def modularity(adj: DataFrame, members: DataFrame) -> DataFrame:
    """(q): sum over communities of inner weight / m minus (total degree / 2m) squared; 0 for no edges."""
    placed = adj.join(members.withColumnsRenamed({"node": "a", "community": "ca"}), "a").join(members.withColumnsRenamed({"node": "b", "community": "cb"}), "b")
    inner = placed.filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("w").alias("inner"))
    ends = placed.select(F.col("ca").alias("community"), "w").union(placed.select("cb", "w"))
    total = ends.groupBy("community").agg(F.sum("w").alias("total"))
    m = adj.agg(F.sum("w").alias("m"))
    joined = total.join(inner, "community", "left").join(m)
    part = F.coalesce("inner", F.lit(0.0)) / F.col("m") - F.pow(F.col("total") / (2 * F.col("m")), 2)
    return joined.agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("q"))


#: Neighbours that stand in one piece of a level's arrays; neighbours from which a node's are summed as arrays.
PIECE, MANY = 1 << 22, 128
#: Gains that differ by more than this are in a clear order; others are compared one after the other.
_CLEAR = 1e-9

Blocks = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _packed(w: np.ndarray) -> np.ndarray:
    """Weights in the least type that holds them: most are counts."""
    if len(w) and w.min() >= 0 and (w == np.floor(w)).all():
        for kind in (np.uint8, np.uint16, np.uint32):
            if w.max() <= np.iinfo(kind).max:
                return w.astype(kind)
    return w


class _Level:
    """One level of the hierarchy: neighbours in order and their weights as arrays, in pieces of some nodes each."""

    def __init__(self, blocks: Blocks, n: int, degree: np.ndarray | None = None):
        ends = np.zeros(n + 1, np.int64)
        for a, b, _ in blocks:
            ends[1:] += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        ends = np.cumsum(ends)
        self.degree = np.zeros(n) if degree is None else degree
        self.pieces: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        v = 0
        while v < n:
            end = max(v + 1, int(np.searchsorted(ends, ends[v] + PIECE, "right")) - 1)
            rows, near, weight = self._sorted(blocks, v, end, n)
            if degree is None:
                self.degree[v:end] = np.bincount(rows, weight, end - v)
            self.pieces.append((v, np.searchsorted(rows, np.arange(end - v + 1)), near, _packed(weight)))
            v = end

    @staticmethod
    def _sorted(blocks: Blocks, v: int, end: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node from v on, neighbour, weight) of nodes up to ``end``, in order, a row for each pair."""
        keys, weights = [np.empty(0, np.int64)], [np.empty(0)]
        for a, b, w in blocks:
            for x, y in ((a, b), (b, a)):
                at = np.flatnonzero((x >= v) & (x < end) & (x != y))
                keys.append((x[at].astype(np.int64) - v) * n + y[at])
                weights.append(w[at])
        key, w = np.concatenate(keys), np.concatenate(weights)
        del keys, weights
        order = np.argsort(key, kind="stable")
        key, w = key[order], w[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        if len(first) < len(key):
            key, w = key[first], np.add.reduceat(w, first)
        return key // n, (key % n).astype(np.int32 if n < 2**31 else np.int64), w

    def edges(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, w) of each piece, a < b."""
        for first, at, near, weight in self.pieces:
            rows = np.repeat(np.arange(first, first + len(at) - 1), np.diff(at))
            half = np.flatnonzero(rows < near)
            yield rows[half], near[half], weight[half]

    def inside(self, part: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """The pieces with the neighbours of a node's own part only."""
        out = []
        for first, at, near, weight in self.pieces:
            same = np.repeat(part[first : first + len(at) - 1], np.diff(at)) == part[near]
            kept = np.concatenate(([0], np.cumsum(same)))[at]
            out.append((first, kept, near[same], weight[same]))
        return out

    def merged(self, ids: np.ndarray, n: int) -> Blocks:
        """Edges between merged nodes; what is inside one stands in its degree only."""
        out: Blocks = []
        for a, b, w in self.edges():
            x, y = ids[a], ids[b]
            apart = x != y
            pair, at = np.unique(np.minimum(x, y)[apart] * n + np.maximum(x, y)[apart], return_inverse=True)
            kind = np.int32 if n < 2**31 else np.int64
            out.append(((pair // n).astype(kind), (pair % n).astype(kind), _packed(np.bincount(at, w[apart], len(pair)))))
        return out


def _move(level: _Level, label: np.ndarray, part: np.ndarray | None, mass: float) -> bool:
    """Sweep nodes in order to the best neighbouring community until nothing changes; ``part`` bounds the choice."""
    pieces = level.pieces if part is None else level.inside(part)
    degrees = level.degree.tolist()
    moved_ever, moved = False, True
    while moved:
        moved = False
        names, held = np.unique(label, return_inverse=True)
        total = np.bincount(held, level.degree).tolist()
        for first, ends, near, weight in pieces:
            lo = 0
            for v, hi in enumerate(ends[1:].tolist(), first):
                begin, lo = lo, hi
                if begin == hi:
                    continue
                found = held[near[begin:hi]]
                to: dict[int, float] = {}
                if hi - begin < MANY:
                    for c, w in zip(found.tolist(), weight[begin:hi].tolist(), strict=True):
                        to[c] = to[c] + w if c in to else w
                elif len(total) <= 4 * (hi - begin):
                    sums, there = np.bincount(found, weight[begin:hi], len(total)), np.flatnonzero(np.bincount(found, minlength=len(total)))
                    to = dict(zip(there.tolist(), sums[there].tolist(), strict=True))
                else:
                    there, at = np.unique(found, return_inverse=True)
                    to = dict(zip(there.tolist(), np.bincount(at, weight[begin:hi]).tolist(), strict=True))
                own, degree = int(held[v]), degrees[v]
                total[own] -= degree
                best, gain = own, to.pop(own, 0.0) - total[own] * degree / mass
                top, second, c_top = gain - 1.0, gain, own
                for c, w in to.items():
                    g = w - total[c] * degree / mass
                    if g > top:
                        top, second, c_top = g, max(top, second), c
                    elif g > second:
                        second = g
                if top > second + _CLEAR:
                    best = c_top
                elif top >= gain - _CLEAR:
                    for c in sorted(to):
                        g = to[c] - total[c] * degree / mass
                        if g > gain + _EPS or (abs(g - gain) <= _EPS and c < best):
                            best, gain = c, g
                total[best] += degree
                if best != own:
                    held[v] = best
                    moved = moved_ever = True
        label[:] = names[held]
    return moved_ever


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins edges to a forest in which each node has the least node that it is connected with."""
    a, b = root[a], root[b]
    while len(a):
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]
        a, b = root[a], root[b]


def _connected(level: _Level, label: np.ndarray) -> np.ndarray:
    """Each label split into its connected parts, named by their least node."""
    root = np.arange(len(label))
    for a, b, _ in level.edges():
        same = label[a] == label[b]
        _join(root, a[same], b[same])
    return root


def _levels(blocks: Blocks, n: int, mass: float | None = None) -> Iterator[tuple[np.ndarray, bool, bool]]:
    """Level by level: each node's community (its least member), whether a node moved, and whether nodes were merged.

    With the ``mass`` of a larger graph the edges are whole components of it.  What they do there does not
    depend on the others, except for the level at which all end; so levels go on until they repeat.
    ``blocks`` are emptied.
    """
    level = _Level(blocks, n)
    blocks.clear()
    alone, mass = mass is None, float(level.degree.sum()) if mass is None else mass
    where, least, label = np.arange(n), np.arange(n), np.arange(n)
    for _ in range(MAX_LEVELS):
        before = label.copy()
        moved = bool(mass) and _move(level, label, None, mass)
        found = least[_connected(level, label)][where]  # merged nodes are connected, so their graph tells what is
        if not mass or (alone and not moved):
            yield found, False, False
            return
        fine = np.arange(len(label))
        _move(level, fine, label, mass)
        kept, ids = np.unique(_connected(level, fine), return_inverse=True)
        merged = len(kept) < len(label)
        yield found, moved, merged
        _, seat, at = np.unique(label[kept], return_index=True, return_inverse=True)
        label = seat[at]
        if not merged and (alone or (label == before).all()):
            return
        if merged:
            where, least = ids[where], least[kept]
            blocks, degree = level.merged(ids, len(kept)), np.bincount(ids, level.degree)
            del level
            level = _Level(blocks, len(kept), degree)
            blocks.clear()


def _last(levels: Iterable[tuple[bool, bool]]) -> int:
    """The level at which a whole graph ends: the first at which nothing moved or nothing was merged, else the last."""
    k = -1
    for k, (moved, merged) in enumerate(levels):
        if not (moved and merged):
            break
    return k


def leiden(edges: list[tuple[str, str, float]]) -> dict[str, int]:
    """Community of each node; ids by size, then by least node."""
    if not edges:
        return {}
    names, number = np.unique(np.array([x for a, b, _ in edges for x in (a, b)], object), return_inverse=True)
    found = list(_levels([(number[::2], number[1::2], np.array([w for _, _, w in edges], float))], len(names)))
    groups: dict[int, list[str]] = defaultdict(list)
    for n, c in zip(names.tolist(), found[_last(x[1:] for x in found)][0].tolist(), strict=True):
        groups[c].append(n)
    ordered = sorted(groups.values(), key=lambda g: (-len(g), g[0]))
    return {n: k for k, g in enumerate(ordered) for n in g}


def detect(adj: DataFrame, method: str = "leiden") -> DataFrame:
    """(node, community), by the method that the caller names: none is chosen by size.

    ``leiden`` moves one node at a time in a task for each component, ``spread leiden`` halves of the nodes at a time by
    joins, ``propagation`` spreads labels without a gain.
    """
    if method == "spread leiden":
        return spread_leiden(adj)
    if method == "propagation":
        return propagate(adj)
    if method != "leiden":
        raise ValueError(method)

    return leiden_by_parts(adj)


#: Edges of the components that one task takes; a larger component is a task of its own.
PART_EDGES = 500_000
#: Edges that a task holds as arrays before it passes them on; edges in one row of those that are sent to the moves.
HELD, RUN = 1_000_000, 256


def _batches(columns: dict[str, np.ndarray], rows: int = 65536) -> Iterator[pa.RecordBatch]:
    yield from pa.table(columns).to_batches(max_chunksize=rows)


def _held(batches: Iterable[pa.RecordBatch], rows: int = HELD) -> Iterator[list[np.ndarray]]:
    """The columns of so many rows, or a batch more, at a time."""
    held, n = [], 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n >= rows:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _ids(edges: DataFrame) -> DataFrame:
    """(node, id): the nodes of edges (a, b) numbered from 0 in their order, in ranges of their own."""
    nodes = edges.select(F.col("a").alias("node")).distinct().union(edges.select("b").distinct()).distinct()
    ranged = cut(nodes.repartitionByRange("node").select("node", F.spark_partition_id().alias("range")))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    starts = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("start"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("node"))
    return cut(ranged.join(F.broadcast(starts), "range").select("node", (F.col("start") + rank - 1).alias("id")))


def _parts(edges: DataFrame, n: int, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, part): those of ``n`` nodes that are not the least of their connected component, by that one.

    Tasks reduce their edges to a row for each node; for up to ``local_edges`` nodes these meet in one task, for more in joins.
    """

    def reduced(batches):
        for a, b in _held(batches):
            names, number = np.unique(np.concatenate((a, b)), return_inverse=True)
            root = np.arange(len(names))
            _join(root, number[: len(a)], number[len(a) :])
            at = np.flatnonzero(root != np.arange(len(names)))
            yield from _batches({"id": names[at], "part": names[root[at]]})

    def whole(batches):
        root = np.arange(n)
        for a, b in _held(batches):
            _join(root, a, b)
        at = np.flatnonzero(root != np.arange(n))
        yield from _batches({"id": at, "part": root[at]})

    links = "id long, part long"
    near = cut(edges.select("a", "b").mapInArrow(reduced, links))
    if n <= local_edges:
        return near.repartition(1).mapInArrow(whole, links)
    both = cut(near.toDF("a", "b").union(near.select("part", "id")).distinct())
    return _connected_parts(both, cut(both.select(F.col("a").alias("node"), F.lit(0).alias("label")).distinct())).toDF("id", "part")


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bin, a, b, w): edges of a bin in rows of up to ``RUN``, as bytes: a task gets few rows, each batch of them small."""
    for home, *columns in _held(batches):
        order = np.argsort(home, kind="stable")
        home = home[order]
        begin = np.flatnonzero(np.diff(home, prepend=-1))
        place = np.arange(len(home)) - np.repeat(begin, np.diff(begin, append=len(home)))
        ends = np.append(np.flatnonzero(place % RUN == 0), len(home))
        packed = [pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(c[order])]) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(home[ends[:-1]]), *packed], ["bin", "a", "b", "w"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Each bin of a batch with its edges."""
    columns, home = [], batch.column(0).to_numpy()
    for c, kind in zip(batch.columns[1:], (np.int64, np.int64, np.float64), strict=True):
        c = c.cast(pa.binary())
        ends = np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, 4 * c.offset) // 8
        columns.append(np.frombuffer(c.buffers()[2], kind)[ends[0] : ends[-1]])
    home = np.repeat(home, np.diff(ends))
    for k in np.unique(home).tolist():
        at = np.flatnonzero(home == k)
        yield k, tuple(c[at] for c in columns)


def _renumbered(blocks: Blocks) -> tuple[np.ndarray, Blocks]:
    """(ids in order, blocks in which nodes go by their place among these)."""
    ids = np.unique(np.concatenate([np.unique(np.concatenate(x[:2])) for x in blocks])).astype(np.int64)
    low, kind = int(ids[0]), np.int32 if len(ids) < 2**31 else np.int64
    if ids[-1] - low < 2 * sum(len(x[0]) for x in blocks):
        place = np.empty(int(ids[-1]) - low + 1, kind)
        place[ids - low] = np.arange(len(ids))
        find = lambda x: place[x - low]
    else:
        find = lambda x: np.searchsorted(ids, x).astype(kind)
    for k, (a, b, w) in enumerate(blocks):
        blocks[k] = find(a), find(b), w
    return ids, blocks


def _communities(home: int, blocks: Blocks, mass: float | None) -> Iterator[pa.RecordBatch]:
    """(bin, id, labels, moved, merged): each node's community at every level, named by its least node."""
    ids, blocks = _renumbered(blocks)
    found, moved, merged = zip(*_levels(blocks, len(ids), mass), strict=True)
    for k in range(0, len(ids), 65536):
        labels = np.stack([ids[x[k : k + 65536]] for x in found], axis=1)
        m = len(labels)
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * len(found), pa.int32()), pa.array(x)) for x in (labels.ravel(), np.tile(moved, m), np.tile(merged, m))]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, home)), pa.array(ids[k : k + 65536]), *lists], ["bin", "id", "labels", "moved", "merged"])


@scoped
def leiden_by_parts(adj: DataFrame, part_edges: int = PART_EDGES, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, community): what ``leiden`` finds in the whole graph, with a task for some connected components.

    Moves stay inside a component and need but the weight of the whole graph; tasks keep the communities of
    every level, and the level at which the whole graph would end is taken.  A task holds its largest component,
    as arrays of numbers: some 30 bytes an edge where weights are small counts, and some hundreds a node.
    """
    end = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c)
    named = stored(adj).select(end("a"), end("b"), F.col("w").cast("double").alias("w"))
    names = _ids(named)
    n = names.count()
    near = broadcast_if_small(names)
    ends = named.join(near.alias("x"), F.col("a") == F.col("x.node")).join(near.alias("y"), F.col("b") == F.col("y.node"))
    edges = cut(ends.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), "w"))
    parts = cut(names.select("id").join(_parts(edges, n, local_edges), "id", "left").select("id", F.coalesce("part", "id").alias("part")))
    sizes = edges.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n")).join(parts, "id").groupBy("part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy(F.desc("n"), "part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    bins = cut(sizes.select("part", F.floor(before / part_edges).alias("bin")))
    bins = bins.select("part", (F.dense_rank().over(Window.orderBy("bin")) - 1).alias("bin"))
    homes = cut(parts.join(bins, "part").select(F.col("id").alias("a"), "bin"))
    most = homes.agg(F.max("bin")).first()[0] or 0
    mass = 2 * (edges.filter("a <> b").agg(F.sum("w")).first()[0] or 0.0) if most else None

    def run(batches):
        found: dict[int, Blocks] = defaultdict(list)
        for batch in (x for x in batches if x.num_rows):
            for home, (a, b, w) in _unpacked(batch):
                found[home].append((a.astype(np.int32), b.astype(np.int32), _packed(w)) if n < 2**31 else (a, b, _packed(w)))
        for home in sorted(found):
            yield from _communities(home, found.pop(home), mass)

    placed = edges.join(broadcast_if_small(homes), "a") if most else edges.withColumn("bin", F.lit(0))
    runs = placed.select(F.col("bin").cast("int"), "a", "b", "w").mapInArrow(_runs, "bin int, a binary, b binary, w binary").repartitionById(most + 1, "bin")
    done = cut(runs.mapInArrow(run, "bin long, id long, labels array<long>, moved array<boolean>, merged array<boolean>"))
    flags = done.select("bin", "moved", "merged").distinct().collect()
    steps = [[any(r[c][k : k + 1] == [True] for r in flags) for c in ("moved", "merged")] for k in range(max((len(r.moved) for r in flags), default=0))]
    level = F.least(F.lit(_last(steps)), F.size("labels") - 1)
    members = _numbered(done.select(F.col("id").alias("node"), F.get("labels", level).alias("label")), [F.desc("n"), "least"])
    return members.withColumnRenamed("node", "id").join(names, "id").select("node", "community")


def _numbered(nodes: DataFrame, order: list) -> DataFrame:
    """Communities (label) numbered from 0 by size, then by least node; a row each, windowed over the communities."""
    sizes = nodes.groupBy("label").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    ids = sizes.withColumn("community", F.row_number().over(Window.orderBy(*order)) - 1)
    return nodes.join(ids, "label").select("node", "community")


def _move_rounds(both: DataFrame, nodes: DataFrame, label: DataFrame, mass: float, rounds: int, inside: bool = False) -> tuple[DataFrame, int]:
    """(labels, moves): rounds in which a hashed half of the nodes goes to the neighbouring community of most gain.

    ``label`` has (node, label) and, for moves that stay ``inside``, (node, label, block).  A node alone goes
    to another node alone only if that has the lesser label, so two do not swap.  Ends after two rounds in
    which at most a ``STILL``-th of the nodes moved.
    """
    moves = quiet = 0
    few = nodes.count() // STILL
    for step in range(rounds):
        placed = label.join(nodes, "node")
        total = placed.groupBy("label").agg(F.sum("k").alias("total"), F.count("*").alias("n"))
        near = both.join(label.withColumnsRenamed({"node": "b", "label": "to", **({"block": "to_block"} if inside else {})}), "b")
        if inside:
            near = near.join(label.select(F.col("node").alias("a"), "block"), "a").filter("block = to_block")
        votes = near.groupBy(F.col("a").alias("node"), "to").agg(F.sum("w").alias("w"))
        own = placed.join(total.withColumnsRenamed({"total": "own_total", "n": "own_n"}), "label")
        rows = votes.join(own, "node").join(total.withColumnsRenamed({"label": "to", "total": "to_total", "n": "to_n"}), "to")
        same = F.col("to") == F.col("label")
        gain = F.col("w") - F.when(same, F.col("to_total") - F.col("k")).otherwise(F.col("to_total")) * F.col("k") / mass
        allowed = same | ~((F.col("own_n") == 1) & (F.col("to_n") == 1) & (F.col("to") > F.col("label")))
        rows = rows.filter(allowed).withColumn("gain", gain)
        best = rows.groupBy("node").agg(
            F.min(F.struct((-F.floor(F.col("gain") * 1e9 + 0.5)).alias("less"), "to")).alias("best"),
            F.max(F.when(same, F.col("gain"))).alias("stay"), F.first("label").alias("label"),
            F.first(-(F.col("own_total") - F.col("k")) * F.col("k") / mass).alias("alone"),
        )
        better = -F.col("best.less") / 1e9 > F.coalesce("stay", "alone") + 1e-8
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == step % 2
        chosen = best.select("node", F.when(better & turn, F.col("best.to")).otherwise(F.col("label")).alias("new"))
        columns = ["block"] if inside else []
        now = label.join(chosen, "node", "left").select("node", F.coalesce("new", "label").alias("label"), F.col("label").alias("was"), *columns)
        now = cut(now)
        moved = now.filter("label <> was").count()
        label, moves = now.drop("was"), moves + moved
        quiet = quiet + 1 if moved <= few else 0
        if quiet == 2:
            break
    return label, moves


def _connected_parts(both: DataFrame, label: DataFrame) -> DataFrame:
    """(node, label): each label split into its connected parts, named by their least node."""
    mine = label.select(F.col("node").alias("a"), F.col("label").alias("x"))
    other = label.select(F.col("node").alias("b"), F.col("label").alias("y"))
    inner = cut(both.join(mine, "a").join(other, "b").filter("x = y").select("a", "b"))
    part = cut(label.select("node", F.col("node").alias("label")))
    while True:
        near = inner.join(part.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        jump = part.select(F.col("node").alias("label"), F.col("label").alias("far"))
        now = part.join(near, "node", "left").join(jump, "label").select("node", F.least("label", "near", "far").alias("label"), F.col("label").alias("was"))
        now = cut(now)
        changed = now.filter("label <> was").limit(1).count()
        part = now.drop("was")
        if not changed:
            return part


@scoped
def spread_leiden(adj: DataFrame, levels: int = MAX_LEVELS, rounds: int = 16) -> DataFrame:
    """(node, community): Leiden by joins, the same at every size; no task holds the graph.

    A level moves nodes in rounds, refines every community from single nodes by moves that stay inside it,
    splits what is not connected, and makes the parts the nodes of the next level, which starts from the
    communities found.  Levels end when nothing moves or no part joins another.
    """
    plain = adj.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "w").filter("a <> b")
    edges = cut(plain.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")))
    whole = cut(edges.select("a", "b", "w").union(edges.select("b", "a", "w")))
    mass = whole.agg(F.sum("w").alias("m")).first().m
    if not mass:
        return edges.select(F.col("a").alias("node"), F.lit(0).alias("community"))
    both, nodes = whole, cut(whole.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")))
    label = nodes.select("node", F.col("node").alias("label"))
    member = cut(label.select("node", F.col("node").alias("seat")))
    for _ in range(levels):
        label, moves = _move_rounds(both, nodes, label, mass, rounds)
        fine = cut(nodes.select("node", F.col("node").alias("label")).join(label.withColumnRenamed("label", "block"), "node"))
        fine, _ = _move_rounds(both, nodes, fine, mass, 4, inside=True)
        parts = _connected_parts(both, fine.select("node", "label"))
        if not moves or parts.select("label").distinct().count() == parts.count():
            break
        member = cut(member.join(parts.withColumnsRenamed({"node": "seat", "label": "part"}), "seat").select("node", F.col("part").alias("seat")))
        label = cut(parts.join(label.withColumnRenamed("label", "block"), "node").groupBy(F.col("label").alias("node")).agg(F.min("block").alias("label")))
        mine, other = parts.withColumnsRenamed({"node": "a", "label": "x"}), parts.withColumnsRenamed({"node": "b", "label": "y"})
        both = cut(both.join(mine, "a").join(other, "b").filter("x <> y").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")))
        nodes = cut(parts.join(nodes, "node").groupBy(F.col("label").alias("node")).agg(F.sum("k").alias("k")))
    placed = member.join(label.withColumnsRenamed({"node": "seat"}), "seat").select("node", "label")
    return _numbered(_connected_parts(whole, cut(placed)), [F.desc("n"), "least"])


@scoped
def propagate(adj: DataFrame, rounds: int = 20) -> DataFrame:
    """Label propagation by joins: the heaviest neighbouring label, the least of equal ones; alternating halves move."""
    both = cut(adj.select("a", "b", "w").union(adj.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    label = cut(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    for k in range(rounds):
        votes = both.join(label.withColumnsRenamed({"node": "b"}), "b").groupBy("a", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy(F.col("a").alias("node")).agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("new"))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == k % 2
        moved = cut(label.join(best, "node").select("node", F.when(turn, F.col("new")).otherwise(F.col("label")).alias("label"), (turn & (F.col("new") != F.col("label"))).alias("changed")))
        label = moved.drop("changed")
        if k % 2 and not moved.filter("changed").limit(1).count():
            break
    return _numbered(label, [F.desc("n"), "least"])


def report(adj: DataFrame, members: DataFrame, min_size: int = 1, bridges: int = 25, gods: int = 15) -> dict[str, DataFrame]:
    """communities, bridges, god nodes and modularity."""
    directory = F.when(F.instr(file_of(F.col("node")), "/") > 0, F.regexp_replace(file_of(F.col("node")), "/[^/]*$", "")).otherwise(F.lit("(root)"))
    test = F.col("dir").rlike(r"(?i)(^|/)(tests?|__tests__|specs?)(/|$)")
    placed = members.withColumn("dir", directory)
    votes = placed.groupBy("community", "dir").agg(F.count("*").alias("n")).withColumn("is_test", test.cast("int"))
    label = votes.groupBy("community").agg(F.min_by("dir", F.struct("is_test", -F.col("n"), "dir")).alias("label"))
    sizes = members.groupBy("community").agg(F.count("*").alias("size")).filter(F.col("size") >= min_size)
    ends = adj.join(members.withColumnsRenamed({"node": "a", "community": "ca"}), "a").join(members.withColumnsRenamed({"node": "b", "community": "cb"}), "b")
    across = ends.filter("ca <> cb")
    top = across.select("a", "b", "w", "ca", "cb").orderBy(F.desc("w"), "a", "b").limit(bridges)
    reach = across.select(F.col("a").alias("node"), F.col("cb").alias("other")).union(across.select("b", "ca"))
    god = reach.groupBy("node").agg(F.count_distinct("other").alias("communities")).orderBy(F.desc("communities"), "node").limit(gods)
    return {
        "communities": sizes.join(label, "community").orderBy("community"),
        "bridges": top,
        "god_nodes": god,
        "modularity": modularity(adj, members).select(floor_to("q", 3).alias("q")),
    }
