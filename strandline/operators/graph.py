"""Graph operators over (src, dst, kind, conf) links."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.predicates import entrypoint_reason
from strandline.functions.text import cluster_of
from strandline.sources.tables import cut, first_by, scoped, stored

TRIM_LAYERS = 4
LOCAL_EDGES = 3_000_000
FILE_KINDS = ("imports", "links", "embeds")


def node_key(path: Column, symbol: Column) -> Column:
    """``path#symbol``, or the path of a file node."""
    return F.when(symbol.isNull() | (symbol == ""), path).otherwise(F.concat(path, F.lit("#"), symbol))


def build_links(edges: DataFrame, include_ambiguous: bool = False) -> DataFrame:
    """Edges as (src, dst, kind, conf) links.

    Resolved and inferred calls need a target path and symbol; dispatch calls, and ambiguous ones on
    demand, fan out to all candidates; external calls give no link; other kinds join files.
    """
    src = node_key(F.col("from_path"), F.col("from_symbol"))
    direct = F.col("conf").isin("resolved", "inferred") & F.col("to_path").isNotNull() & F.col("to_symbol").isNotNull()
    fans = ["dispatch", "ambiguous"] if include_ambiguous else ["dispatch"]
    fanned = F.transform(F.coalesce("candidates", F.array().cast("array<string>")), lambda c: node_key(c, F.col("ref_name")))
    targets = (
        F.when((F.col("kind") == "calls") & direct, F.array(node_key(F.col("to_path"), F.col("to_symbol"))))
        .when((F.col("kind") == "calls") & F.col("conf").isin(*fans), fanned)
        .when((F.col("kind") != "calls") & F.col("to_path").isNotNull(), F.array(F.col("to_path")))
    )
    start = F.when(F.col("kind") == "calls", src).otherwise(F.col("from_path"))
    return edges.select(start.alias("src"), F.explode(targets).alias("dst"), "kind", "conf")


def external_sources(edges: DataFrame) -> DataFrame:
    """(node): callers of something outside the collection."""
    return edges.filter("kind = 'calls' AND conf = 'external'").select(
        node_key(F.col("from_path"), F.col("from_symbol")).alias("node")
    ).distinct()


def resolve_stems(links: DataFrame, paths: DataFrame) -> DataFrame:
    """Import targets without extension become the file of that stem where it is the only one."""
    stem = F.regexp_replace("path", r"\.[A-Za-z0-9]+$", "")
    unique = paths.select(stem.alias("dst"), "path").groupBy("dst").agg(F.count("*").alias("n"), F.min("path").alias("file")).filter("n = 1")
    return links.join(unique.select("dst", "file"), "dst", "left").select("src", F.coalesce("file", "dst").alias("dst"), "kind", "conf")


@scoped
def bfs(links: DataFrame, starts: DataFrame, depth: int, directed: bool = True, forward: bool = True) -> DataFrame:
    """(node, depth): least hop count from any start (node), starts included; one frontier join a level.

    Visited nodes leave the frontier by an anti join; each level is written to the shared folder.
    """
    links = stored(links.select("src", "dst"))
    step = links.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    back = links.select(F.col("dst").alias("node"), F.col("src").alias("next"))
    step = step.union(back) if not directed else step if forward else back
    step = step.filter("node <> next")
    frontier = cut(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for level in range(1, depth + 1):
        reached = step.join(frontier.select("node"), "node", "left_semi").select(F.col("next").alias("node")).distinct()
        frontier = cut(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def impact(links: DataFrame, starts: DataFrame, direction: str = "callers", depth: int = 3, limit: int = 500) -> DataFrame:
    """(node, depth, truncated): reached nodes without the starts, by depth and key."""
    found = bfs(links, starts, depth, forward=direction != "callers").filter("depth > 0")
    order = Window.orderBy("depth", "node")
    ranked = found.orderBy("depth", "node").limit(limit + 1).withColumn("n", F.row_number().over(order))
    over = F.max("n").over(Window.partitionBy()) > limit
    return ranked.withColumn("truncated", over).filter(F.col("n") <= limit).select("node", "depth", "truncated")


@scoped
def shortest_path(links: DataFrame, starts: DataFrame, ends: DataFrame, max_depth: int = 10) -> DataFrame:
    """(path, hops): one row, the least array of nodes among the shortest; none if unreachable."""
    step = stored(links.select("src", "dst")).select(F.col("src").alias("node"), F.col("dst").alias("next"))
    goals = ends.select(F.col("node").alias("goal")).distinct()
    frontier = cut(starts.select("node").distinct().withColumn("path", F.array("node")))
    seen = frontier.select("node")
    for level in range(max_depth + 1):
        hit = frontier.join(goals, F.col("node") == F.col("goal"), "left_semi")
        best = hit.agg(F.min("path").alias("path")).filter("path IS NOT NULL")
        if level == max_depth or hit.limit(1).count():
            return best.withColumn("hops", F.size("path") - 1)
        grown = frontier.join(step, "node").select(F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        grown = grown.groupBy("node").agg(F.min("path").alias("path"))
        frontier = cut(grown.join(seen, "node", "left_anti"))
        seen = seen.union(frontier.select("node"))
        if not frontier.limit(1).count():
            break
    return frontier.filter("false").select("path", F.lit(0).alias("hops"))


def degrees(links: DataFrame, kinds: tuple[str, ...] | None = None, direction: str = "both") -> DataFrame:
    """(node, degree): edges at a node, not distinct neighbours."""
    rows = links.filter(F.col("kind").isin(*kinds)) if kinds else links
    out, into = rows.select(F.col("src").alias("node")), rows.select(F.col("dst").alias("node"))
    ends = out.union(into) if direction == "both" else out if direction == "out" else into
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


_EDGE = pa.schema([("src", pa.string()), ("dst", pa.string())])


def _numbered(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(names in order, number of each source, number of each target): edges as arrays of numbers."""
    ends = pa.chunked_array([*table["src"].chunks, *table["dst"].chunks], pa.string()).dictionary_encode(null_encoding="encode").combine_chunks()
    ends = ends.chunk(0) if isinstance(ends, pa.ChunkedArray) else ends
    order = pc.sort_indices(ends.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    number = place[ends.indices.to_numpy()] if len(order) else place
    return ends.dictionary.take(pa.array(order)), number[: table.num_rows], number[table.num_rows :]


def _after(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, target): the targets of node k, ascending, stand at first[k] to first[k + 1]."""
    order = np.lexsort((b, a))
    return np.searchsorted(a[order], np.arange(n + 1)), b[order]


def _peeled(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which nodes are left when nodes without both an inbound and an outbound edge go, one after the other."""
    left = np.ones(n, bool)
    for x, y in ((a, b), (b, a)):
        first, to = _after(x, y, n)
        missing = np.bincount(y, minlength=n)
        front = np.flatnonzero(missing == 0)
        while len(front):
            left[front] = False
            size = first[front + 1] - first[front]
            at = np.repeat(first[front] - np.cumsum(size) + size, size) + np.arange(size.sum())
            np.subtract.at(missing, to[at], 1)
            front = np.unique(to[at])
            front = front[(missing[front] == 0) & left[front]]
    return left


def _components_of(table: pa.Table) -> pa.Table:
    """(node, component): the least node of each strongly connected component, by Tarjan's pass without recursion."""
    names, a, b = _numbered(table)
    n = len(names)
    root = np.arange(n)
    apart = (a != b) & pc.and_(table["src"].is_valid(), table["dst"].is_valid()).to_numpy()
    left = _peeled(a[apart], b[apart], n)
    inside = left[a] & left[b] & apart
    first, to = (x.tolist() for x in _after(a[inside], b[inside], n))
    low, index = [0] * n, [0] * n
    held, count = [], 0
    for start in np.flatnonzero(left).tolist():
        if index[start]:
            continue
        count += 1
        low[start] = index[start] = count
        held.append(start)
        walk = [(start, first[start])]
        while walk:
            v, k = walk.pop()
            while k < first[v + 1]:
                x = to[k]
                k += 1
                if not index[x]:
                    count += 1
                    low[x] = index[x] = count
                    held.append(x)
                    walk.append((v, k))
                    v, k = x, first[x]
                elif low[x] < low[v]:
                    low[v] = low[x]
            if low[v] == index[v]:
                at = len(held) - 1
                while held[at] != v:
                    at -= 1
                members = held[at:]
                del held[at:]
                root[members] = min(members)
                for m in members:
                    low[m] = n + 1
            if walk and low[v] < low[walk[-1][0]]:
                low[walk[-1][0]] = low[v]
    return pa.table({"node": names, "component": names.take(pa.array(root))})


def strong_components(links: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component): the least node of each strongly connected component; a node with no link but to itself is one.

    Up to ``local_edges`` distinct edges one task finds them; beyond, joins do (the same components, see
    ``spread_components``).
    """
    edges = cut(links.select("src", "dst").distinct())
    if edges.count() > local_edges:
        return spread_components(edges)

    def run(batches):
        found = _components_of(pa.Table.from_batches(batches, _EDGE))
        yield from found.to_batches(max_chunksize=65536)

    return edges.repartition(1).mapInArrow(run, "node string, component string")


@scoped
def spread_components(links: DataFrame) -> DataFrame:
    """Strongly connected components by colouring, without a task that holds the graph.

    Repeatedly: the least label is spread forward; inside a colour, what reaches back to the colour's
    root is a component and leaves the graph.  Every round settles at least one component of each
    colour; each step is a join.
    """
    nodes = cut(links.select(F.col("src").alias("node")).union(links.select(F.col("dst").alias("node"))).distinct())
    edges = cut(links.select("src", "dst").filter("src <> dst").distinct())
    settled = None
    while True:
        # Nodes without both an inbound and an outbound edge are components of their own: several layers a job.
        trimmed = edges
        for _ in range(TRIM_LAYERS):
            trimmed = trimmed.join(trimmed.select(F.col("dst").alias("src")), "src", "left_semi").join(trimmed.select(F.col("src").alias("dst")), "dst", "left_semi")
        trimmed = cut(trimmed)
        if trimmed.count() != edges.count():
            edges = trimmed
            continue
        if not edges.limit(1).count():
            break
        colour = cut(edges.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            spread = edges.join(colour.withColumnsRenamed({"node": "src", "colour": "c"}), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("c"))
            new = cut(colour.join(spread, "node", "left").select("node", F.least("colour", F.coalesce("c", "colour")).alias("colour"), F.col("colour").alias("was")))
            moved = new.filter("colour <> was").limit(1).count()
            colour = new.drop("was")
            if not moved:
                break
        inside = edges.join(colour.withColumnsRenamed({"node": "src", "colour": "a"}), "src").join(colour.withColumnsRenamed({"node": "dst", "colour": "b"}), "dst").filter("a = b")
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        reach = bfs(back, colour.filter("node = colour").select("node"), 1 << 30).select("node")
        done = cut(colour.join(reach, "node", "left_semi").select("node", F.col("colour").alias("component")))
        settled = done if settled is None else settled.union(done)
        edges = cut(edges.join(done.select(F.col("node").alias("src")), "src", "left_anti").join(done.select(F.col("node").alias("dst")), "dst", "left_anti"))
    if settled is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(settled, "node", "left").withColumn("component", F.coalesce("component", "node"))


def cycles(links: DataFrame) -> DataFrame:
    """(component, size, members): components of two nodes or more, members sorted; self loops are not cycles."""
    grouped = strong_components(links).groupBy("component").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("node")).alias("members"))
    return grouped.filter("size > 1")


def self_loops(links: DataFrame) -> DataFrame:
    return links.filter("src = dst").groupBy("kind").agg(F.count("*").alias("self_loops"))


def example_cycle(links: DataFrame, members: list[str], local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(path, hops): the shortest closed walk through the least member of one component, the least array among those.

    Up to ``local_edges`` edges one task walks them, as a cycle takes as many steps as it is long; beyond,
    a join a step does.
    """
    spark, first = links.sparkSession, min(members)
    named = spark.createDataFrame([(m,) for m in members], "node string")
    inside = links.filter("src <> dst").join(named.withColumnRenamed("node", "src"), "src", "left_semi")
    inside = cut(inside.join(named.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst").distinct())
    if inside.count() > local_edges:
        nexts = inside.filter(F.col("src") == first).select(F.col("dst").alias("node"))
        walk = shortest_path(inside, nexts, spark.createDataFrame([(first,)], "node string"), len(members))
        return walk.select(F.concat(F.array(F.lit(first)), "path").alias("path"), (F.col("hops") + 1).alias("hops"))

    def run(batches):
        edges = pd.concat([pd.DataFrame({"src": [], "dst": []}), *batches])
        after: dict[str, list[str]] = defaultdict(list)
        for a, b in sorted(zip(edges["src"], edges["dst"], strict=True)):
            after[a].append(b)
        # A level lists its nodes in the order of their least paths, so the first way to a node is its least.
        front, came = [first], {}
        while front:
            grown = []
            for node in front:
                for x in after.get(node, ()):
                    if x not in came:
                        came[x] = node
                        grown.append(x)
            if first in came:
                path = [first, came[first]]
                while path[-1] != first:
                    path.append(came[path[-1]])
                yield pd.DataFrame({"path": [path[::-1]], "hops": [len(path) - 1]})
                return
            front = grown

    return inside.repartition(1).mapInPandas(run, "path array<string>, hops int")


@scoped
def transitive_bases(bases: DataFrame, depth: int = 100) -> DataFrame:
    """(name, base, depth) for all ancestors of (name, base); classes on a cycle are not their own ancestors."""
    step = cut(bases.select("name", "base").distinct())
    level = step.withColumn("depth", F.lit(1)).filter("name <> base")
    out = level
    for d in range(2, depth + 1):
        grown = level.select("name", F.col("base").alias("mid")).join(step.select(F.col("name").alias("mid"), "base"), "mid")
        level = cut(grown.filter("name <> base").select("name", "base").distinct().join(out.select("name", "base"), ["name", "base"], "left_anti").withColumn("depth", F.lit(d)))
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    return out


def orphans(inventory: DataFrame, links: DataFrame, external: DataFrame) -> DataFrame:
    """Symbols (name, path, line_start, line_end, text) that nothing reaches, with class and reason."""
    keyed = inventory.withColumn("node", node_key(F.col("path"), F.col("name")))
    inbound = links.filter("src <> dst").select(F.col("dst").alias("node")).distinct()
    alone = keyed.join(inbound, "node", "left_anti").join(external.withColumn("facing", F.lit(True)), "node", "left")
    reason = F.coalesce(entrypoint_reason(F.col("path"), F.col("name"), F.col("text")), F.when(F.col("facing"), "external-facing"))
    return alone.withColumn("reason", reason).select(
        "name", "path", "line_start", "line_end", F.when(F.col("reason").isNull(), "likely_dead").otherwise("possible_entrypoint").alias("class"), "reason",
    )


def by_name(edges: DataFrame, name: str, side: str, limit: int = 200) -> DataFrame:
    """Callers or callees by bare symbol name, whatever the file."""
    column = "to_symbol" if side == "callers" else "from_symbol"
    return edges.filter((F.col(column) == name) & (F.col("kind") == "calls")).orderBy("from_path", "from_lines", "ref_name").limit(limit)


def neighbours(edges: DataFrame, chunks: DataFrame, name: str, path: str, line_start: int, limit: int = 200) -> DataFrame:
    """(relation, path, lines, symbol): callers, callees and the other chunks of the file."""
    callers = by_name(edges, name, "callers", limit).select(F.lit("caller").alias("relation"), F.col("from_path").alias("path"), F.col("from_lines").alias("lines"), F.col("from_symbol").alias("symbol"))
    callees = by_name(edges, name, "callees", limit).select(F.lit("callee").alias("relation"), F.col("to_path").alias("path"), F.col("to_lines").alias("lines"), F.coalesce("to_symbol", "ref_name").alias("symbol"))
    others = chunks.filter((F.col("path") == path) & (F.col("line_start") != line_start)).select(
        F.lit("sibling").alias("relation"), "path", F.concat_ws("-", F.col("line_start").cast("string"), F.col("line_end").cast("string")).alias("lines"), F.lit(None).cast("string").alias("symbol"))
    return callers.union(callees).union(others)


def chunk_centrality(chunks: DataFrame, links: DataFrame) -> DataFrame:
    """(id, degree): the greatest call degree of a chunk's symbols, or its file's inbound imports if more."""
    calls = degrees(links, ("calls",))
    imports = degrees(links, ("imports",), "in").withColumnsRenamed({"node": "path", "degree": "into"})
    symbols = chunks.select("id", "path", F.explode_outer("symbols").alias("symbol"))
    keyed = symbols.withColumn("node", node_key(F.col("path"), F.col("symbol"))).join(calls, "node", "left").join(imports, "path", "left")
    return keyed.groupBy("id").agg(F.greatest(F.coalesce(F.max("degree"), F.lit(0)), F.coalesce(F.max("into"), F.lit(0))).alias("degree"))


def context_for(chunks: DataFrame, links: DataFrame, cap: int = 5) -> DataFrame:
    """(id, callers, callees): the first ``cap`` neighbours of a chunk's declared symbols."""
    symbols = chunks.select("id", "path", F.explode("symbols").alias("symbol")).withColumn("node", node_key(F.col("path"), F.col("symbol")))
    calls = links.filter("kind = 'calls'")
    def side(mine: str, other: str, name: str) -> DataFrame:
        asked = symbols.select("id", F.col("node").alias(mine)).distinct()
        near = calls.join(asked.select(mine).distinct(), mine, "left_semi").select(mine, other).distinct()
        # The first of a chunk are among the first of its symbols.
        near = near.withColumn("n", F.row_number().over(Window.partitionBy(mine).orderBy(other))).filter(F.col("n") <= cap)
        pairs = asked.join(near, mine).select("id", other).distinct()
        top = pairs.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(other))).filter(F.col("n") <= cap)
        return top.groupBy("id").agg(F.sort_array(F.collect_list(other)).alias(name))
    return side("dst", "src", "callers").join(side("src", "dst", "callees"), "id", "full")


def roll_up(links: DataFrame, source: Column, target: Column) -> DataFrame:
    """(source, target, kind, count, conf): merged edges without self loops, the worst confidence kept."""
    rank = F.create_map(*[F.lit(x) for item in {"resolved": 0, "inferred": 1, "dispatch": 2, "external": 3, "ambiguous": 4}.items() for x in item])
    rows = links.select(source.alias("source"), target.alias("target"), "kind", "conf").filter("source <> target")
    return rows.groupBy("source", "target", "kind").agg(F.count("*").alias("count"), F.max_by("conf", rank[F.col("conf")]).alias("conf"))


def file_of(node: Column) -> Column:
    return F.element_at(F.split(node, "#"), 1)


def cap_by_degree(nodes: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes kept, edges between them, one row with how many nodes were dropped)."""
    deg = degrees(edges.withColumnsRenamed({"source": "src", "target": "dst"}))
    graded = nodes.join(deg, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    kept = cut(graded.orderBy(F.desc("degree"), "node").limit(limit))
    ids = kept.select("node")
    inside = edges.join(ids.withColumnRenamed("node", "source"), "source", "left_semi").join(ids.withColumnRenamed("node", "target"), "target", "left_semi")
    return kept, inside, nodes.agg((F.count("*") - F.lit(limit)).alias("d")).select(F.greatest("d", F.lit(0)).alias("dropped"))


def node_ids(edges: DataFrame) -> tuple[Column, Column]:
    """The typed nodes at both ends of an edge: code, ``note:``, ``ext:``, ``amb:`` and ``disp:``."""
    noted = F.col("kind").isin("links", "embeds")
    named = F.coalesce("ref_name", F.lit("?"))
    source = F.when(noted, F.concat(F.lit("note:"), "from_path")).otherwise(node_key(F.col("from_path"), F.col("from_symbol")))
    target = (
        F.when(F.col("conf") == "external", F.concat(F.lit("ext:"), named))
        .when(F.col("conf") == "ambiguous", F.concat(F.lit("amb:"), named))
        .when(F.col("conf") == "dispatch", F.concat(F.lit("disp:"), named))
        .when(noted, F.concat(F.lit("note:"), "to_path"))
        .otherwise(node_key(F.col("to_path"), F.col("to_symbol")))
    )
    return source, target


def node_references(edges: DataFrame, file_level: bool = False) -> tuple[DataFrame, DataFrame]:
    """((node, path, line), (node, candidate)): where the edges of a node stand, and the files it may mean.

    Nodes that merge into one file keep the distinct rows of all of them.  A row each, so a node with many
    edges is no array.
    """
    source, target = node_ids(edges)
    key = file_of if file_level else (lambda c: c)
    line = F.split("from_lines", "-")[0].cast("int")
    rows = edges.select(key(source).alias("source"), key(target).alias("target"), "from_path", line.alias("line"), "candidates", "conf")
    rows = rows.filter("target IS NOT NULL")
    ends = rows.select(F.explode(F.array("source", "target")).alias("node"), F.col("from_path").alias("path"), "line")
    listed = rows.filter("conf IN ('ambiguous', 'dispatch')").select(F.col("target").alias("node"), F.explode("candidates").alias("candidate"))
    return ends.distinct(), listed.distinct()


def cluster_index(nodes: DataFrame, space: int = 16384) -> DataFrame:
    """(cluster, size, place, x, y): clusters of (node, cluster) by size, then name, on a square grid that fills the space."""
    sizes = nodes.groupBy("cluster").agg(F.count("*").alias("size"))
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), "cluster")) - 1)
    columns = F.greatest(F.lit(1), F.ceil(F.sqrt(F.count("*").over(Window.partitionBy()))))
    placed = placed.withColumn("columns", columns).withColumn("cell", F.floor(F.lit(space) / (F.col("columns") + 1)))
    x = (F.col("place") % F.col("columns") + 0.5) * F.col("cell")
    y = (F.floor(F.col("place") / F.col("columns")) + 0.5) * F.col("cell")
    return placed.select("cluster", "size", "place", x.cast("double").alias("x"), y.cast("double").alias("y"))


def visual_graph(edges: DataFrame, kinds: list[str] | None = None, confs: list[str] | None = None, path_prefix: str | None = None,
                 focus: str | None = None, depth: int = 2, file_level: bool = False, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for drawing: filter, typed nodes, then a focus or the best connected part, with degree and cluster."""
    rows = edges
    if kinds:
        rows = rows.filter(F.col("kind").isin(*kinds))
    if confs:
        rows = rows.filter(F.col("conf").isin(*confs))
    if path_prefix:
        rows = rows.filter(F.col("from_path").startswith(path_prefix))
    source, target = node_ids(rows)
    mapped = rows.select(source.alias("src"), target.alias("dst"), "kind", "conf").filter("dst IS NOT NULL")
    if focus is not None:
        all_nodes = mapped.select(F.col("src").alias("node")).union(mapped.select(F.col("dst").alias("node"))).distinct()
        name = F.element_at(F.split("node", "[#:]"), -1)
        near = bfs(mapped, all_nodes.filter((name == focus) | (F.col("node") == focus)), depth, directed=False).select("node")
        mapped = mapped.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")
    key = file_of if file_level else (lambda c: c)
    merged = cut(roll_up(mapped, key(F.col("src")), key(F.col("dst"))))
    nodes = merged.select(F.col("source").alias("node")).union(merged.select(F.col("target").alias("node"))).distinct()
    if focus is None:
        nodes, merged, _ = cap_by_degree(nodes, merged, limit)
        nodes = nodes.drop("degree")
    deg = degrees(merged.withColumnsRenamed({"source": "src", "target": "dst"}))
    prefix = F.regexp_extract("node", "^(ext|amb|disp|note):", 1)
    cls = F.create_map(*map(F.lit, ["ext", "external", "amb", "ambiguous", "disp", "dispatch", "note", "note", "", "code"]))[prefix]
    place = file_of(F.regexp_replace("node", "^note:", ""))
    cluster = F.when(cls.isin("external", "ambiguous", "dispatch"), cls).otherwise(cluster_of(place))
    label = F.element_at(F.split(F.regexp_replace("node", "^(ext|amb|disp|note):", ""), "#"), -1)
    return nodes.join(deg, "node", "left").select("node", label.alias("label"), cls.alias("cls"), F.coalesce("degree", F.lit(0)).alias("degree"), cluster.alias("cluster")), merged


def link_proximity(links: DataFrame, start: str, hops: int = 2) -> DataFrame:
    """(node, hop, cocited, proximity) of nodes within some undirected hops of, or cited together with, a start."""
    spark = links.sparkSession
    near = bfs(links, spark.createDataFrame([(start,)], "node string"), hops, directed=False).filter("depth > 0")
    citing = links.filter(F.col("dst") == start).select("src").distinct()
    together = links.join(citing, "src", "left_semi").filter(F.col("dst") != start).select("src", "dst").distinct()
    cited = together.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("cocited"))
    by_hop = F.when(F.col("hop") == 1, 1.0).when(F.col("hop") == 2, 0.5).otherwise(0.0)
    by_cite = 0.5 * F.least(F.coalesce("cocited", F.lit(0)), F.lit(3)) / 3
    return near.withColumnRenamed("depth", "hop").join(cited, "node", "full").withColumn("proximity", F.least(F.greatest(F.coalesce(by_hop, F.lit(0.0)), by_cite), F.lit(1.0)))


def resolve_name(inventory: DataFrame, name: str, path: str | None = None, substring: bool = False) -> DataFrame:
    """Sites of a name; several without a path are ambiguous (the caller decides)."""
    rows = inventory.filter(F.col("name") == name)
    if path is not None:
        rows = rows.filter(F.col("path").contains(path) if substring else F.col("path") == path)
    return first_by(rows, ["path"], "line_start").withColumn("node", node_key(F.col("path"), F.col("name")))
