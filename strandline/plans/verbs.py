"""The query verbs as functions of an index, each returning a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.functions.vector import hash_embedding
from strandline.operators import communities as comm
from strandline.operators import crosslinks, extract, gitmetrics, graph
from strandline.operators import search as hybrid
from strandline.params import DEFAULTS, Params
from strandline.plans.index import Index
from strandline.sources import tables
from strandline.sources.files import lines_of_code


class Ambiguous(ValueError):
    """A name with several sites and no path to choose by."""


def embed_query(index: Index, query: str, dims: int = 64) -> list[float]:
    row = index.chunks.sparkSession.createDataFrame([(query,)], "q string").select(hash_embedding(F.col("q"), dims).alias("v"))
    return list(row.first()["v"])


def search(index: Index, query: str, k: int = 8, path_prefix: str | None = None, language: str | None = None, vector: list[float] | None = None, centrality: bool = True, params: Params = DEFAULTS) -> DataFrame:
    degrees = None
    if centrality:
        named = index.chunks.withColumn("symbols", F.transform("symbols", lambda s: s["name"]))
        degrees = graph.chunk_centrality(named, graph.build_links(index.edges))
    return hybrid.search(index.chunks, index.postings, index.stats, query, vector or embed_query(index, query), k, path_prefix, language, degrees=degrees, params=params)


def context(index: Index, query: str | None = None, targets: list[str] | None = None, k: int = 5, params: Params = DEFAULTS) -> DataFrame:
    """Hits with neighbours and a confidence; targets are ``path:line`` spans or symbol names."""
    links = graph.build_links(index.edges)
    named = index.chunks.withColumn("symbols", F.transform("symbols", lambda s: s["name"]))
    around = graph.context_for(named, links, params.context_cap)
    if query is not None:
        hits = search(index, query, min(max(k, 1), 20), centrality=False, params=params)
        level = hybrid.margin_confidence(hits, params=params).select("confidence")
        ids = index.chunks.select("id", "path", F.concat_ws("-", F.col("line_start").cast("string"), F.col("line_end").cast("string")).alias("lines"))
        return hits.join(ids, ["path", "lines"]).join(around, "id", "left").join(level).drop("id")
    spans, names = [t for t in targets or [] if ":" in t and t.rsplit(":", 1)[1][:1].isdigit()], []
    names = [t for t in targets or [] if t not in spans]
    rows = named.filter(F.arrays_overlap("symbols", F.array(*map(F.lit, names)))) if names else named.filter("false")
    for s in spans:
        path, line = s.rsplit(":", 1)
        rows = rows.unionByName(tables.chunk_at(named, path, int(line.split("-")[0])))
    found = rows.join(around, "id", "left")
    n, asked = rows.count(), len(targets or [])
    return found.withColumn("confidence", F.lit("low" if not n else "high" if n >= asked else "medium"))


def outline(index: Index, path: str) -> DataFrame:
    rows = tables.chunks_of(index.chunks, path)
    return rows.select("line_start", "line_end", F.array_join("scope", " › ").alias("scope"), text.signature_line("text", 100).alias("signature"))


def similar(index: Index, path: str, line: int, k: int = 8) -> DataFrame:
    return hybrid.similar(index.chunks, path, line, k)


def find(index: Index, name: str, kind: str = "definition", k: int = 20) -> DataFrame:
    return hybrid.find_symbol(index.chunks, name, kind, k, index.edges)


def callers(index: Index, name: str, limit: int = 200) -> DataFrame:
    return graph.by_name(index.edges, name, "callers", min(limit, 200))


def callees(index: Index, name: str, limit: int = 200) -> DataFrame:
    return graph.by_name(index.edges, name, "callees", min(limit, 200))


def backlinks(index: Index, path: str, limit: int = 200) -> DataFrame:
    rows = index.edges.filter(F.col("kind").isin("links", "embeds") & (F.col("to_path") == path))
    return rows.select("from_path", "kind", "from_lines").orderBy("from_path", "from_lines").limit(min(limit, 200))


def links(index: Index, path: str, limit: int = 200) -> DataFrame:
    rows = index.edges.filter(F.col("kind").isin("links", "embeds") & (F.col("from_path") == path))
    return rows.select("kind", "conf", "to_path", "ref_name").orderBy("ref_name").limit(min(limit, 200))


def neighbors(index: Index, name: str, path: str, line: int) -> DataFrame:
    return graph.neighbours(index.edges, index.chunks, name, path, line)


def _starts(index: Index, name: str, path: str | None, substring: bool = False) -> DataFrame:
    sites = graph.resolve_name(extract.inventory(index.chunks), name, path, substring)
    n = sites.limit(2).count()
    if n == 0:
        raise KeyError(name)
    if n > 1 and path is None:
        raise Ambiguous(name)
    return sites.select("node")


def impact(index: Index, name: str, path: str | None = None, direction: str = "callers", depth: int = 3, limit: int = 500, include_ambiguous: bool = False) -> DataFrame:
    return graph.impact(graph.build_links(index.edges, include_ambiguous), _starts(index, name, path), direction, depth, limit)


def path_between(index: Index, source: str, target: str, source_path: str | None = None, target_path: str | None = None, max_depth: int = 10) -> DataFrame:
    steps = graph.build_links(index.edges)
    return graph.shortest_path(steps, _starts(index, source, source_path, True), _starts(index, target, target_path, True), max_depth)


def orphans(index: Index) -> DataFrame:
    steps = graph.build_links(index.edges, include_ambiguous=True)
    return graph.orphans(extract.inventory(index.chunks), steps, graph.external_sources(index.edges)).orderBy("class", "path", "line_start")


def cycles(index: Index) -> DataFrame:
    """(graph, component, size, members) of the call, import and note graphs."""
    all_links = graph.resolve_stems(graph.build_links(index.edges), index.chunks.select("path").distinct())
    out = None
    for name, kinds in (("calls", ["calls"]), ("imports", ["imports"]), ("links", ["links", "embeds"])):
        found = graph.cycles(all_links.filter(F.col("kind").isin(*kinds))).withColumn("graph", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def communities(index: Index, method: str = "leiden") -> dict[str, DataFrame]:
    adj = tables.cut(comm.adjacency(graph.build_links(index.edges)))
    return comm.report(adj, tables.cut(comm.detect(adj, method)))


def graph_view(index: Index, **options) -> tuple[DataFrame, DataFrame]:
    return graph.visual_graph(index.edges, **options)


def cochange(index: Index | None, commits: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    pairs = None if index is None else gitmetrics.call_edge_pairs(index.edges)
    return gitmetrics.cochange(gitmetrics.commit_files(commits), pairs, params=params)


def hotspots(commits: DataFrame, files: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    loc = lines_of_code(files)
    return gitmetrics.hotspots(gitmetrics.commit_files(commits), loc, params=params)


def code_links(notes: Index, code: Index) -> DataFrame:
    whole = notes.chunks.groupBy("path").agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("text"))
    first = tables.first_by(code.chunks, ["path"], "line_start").select("path", "text")
    return crosslinks.code_links(whole, extract.inventory(code.chunks), first)


def notes_for(links_: DataFrame, code: Index, path: str) -> DataFrame:
    names = extract.inventory(code.chunks.filter(F.col("path") == path)).select(F.col("name").alias("symbol")).distinct()
    return crosslinks.reverse_links(links_, path, names)


def connections(index: Index, path: str, limit: int = 12, params: Params = DEFAULTS) -> DataFrame:
    """Notes related to a note by meaning, words and links."""
    own = index.chunks.filter(F.col("path") == path)
    width = max(3 * limit, 16) + 4
    near = hybrid.vector_top_batch(index.chunks, own.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector")), width)
    place = index.chunks.select("id", "path")
    semantic = near.join(place, "id").filter(F.col("path") != path).groupBy("path").agg(F.max("similarity").alias("similarity"))
    title = F.regexp_replace(text.basename("path"), r"\.md$", "")
    asked = own.groupBy("path").agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("t")).select(F.lit(0).alias("query_id"), text.lexical_query(title, "t").alias("query"))
    scored = hybrid.bm25(index.postings, index.stats, hybrid.query_terms(asked), params).join(place, "id").filter(F.col("path") != path)
    lexical = scored.groupBy("path").agg(F.max("score").alias("bm25")).orderBy(F.desc("bm25"), "path").limit(width)
    near_links = graph.link_proximity(graph.build_links(index.edges).filter(F.col("kind").isin("links", "embeds")), path, params.conn_graph_hops)
    return crosslinks.connections(semantic.orderBy(F.desc("similarity"), "path").limit(width), lexical, near_links.withColumnRenamed("node", "path"), limit, params)


def rank_rows(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def read_span(sources: DataFrame, path: str, first: int, last: int, context_lines: int = 0) -> DataFrame:
    from strandline.sources.files import read_span as read

    return read(sources, path, first, last, context_lines)


def note_refs(notes: Index, code: Index) -> DataFrame:
    """(note, kind, symbol, path, lines, text): what notes refer to, with the text it has now."""
    found = code_links(notes, code).select("note", "kind", "symbol", "path", "lines")
    bodies = extract.inventory(code.chunks).select(F.col("name").alias("symbol"), "path", "text")
    files = code.chunks.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_start", "text"))), lambda c: c["text"]), "\n").alias("text"))
    by_symbol = found.filter("kind = 'symbol'").join(bodies, ["symbol", "path"])
    by_file = found.filter("kind = 'file'").join(files, "path")
    return by_symbol.select("note", "kind", "symbol", "path", "lines", "text").unionByName(by_file.select("note", "kind", "symbol", "path", "lines", "text"))


def drift_baseline(notes: Index, code: Index) -> DataFrame:
    return crosslinks.snapshot(note_refs(notes, code))


def drift_check(baseline: DataFrame, notes: Index, code: Index, muted: DataFrame | None = None, note: str | None = None) -> DataFrame:
    found = crosslinks.drift(baseline, drift_baseline(notes, code), muted)
    return found if note is None else found.filter(F.col("note") == note)


def drift_ack(baseline: DataFrame, notes: Index, code: Index, note: str, symbol: str | None = None) -> DataFrame:
    return crosslinks.acknowledge(baseline, drift_baseline(notes, code), note, symbol)


def drift_mute(muted: DataFrame, note: str, symbol: str = "*") -> DataFrame:
    new = muted.sparkSession.createDataFrame([(note, symbol)], "note string, symbol string")
    return muted.unionByName(new).distinct()


def drift_sync(baseline: DataFrame, notes: Index, code: Index, muted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    return crosslinks.sync(baseline, drift_baseline(notes, code), muted)


def neighbourhood(index: Index, path: str, k: int = 12, most: int = 40) -> tuple[DataFrame, DataFrame]:
    steps = graph.build_links(index.edges).filter(F.col("kind").isin("links", "embeds"))
    return crosslinks.neighbourhood(path, connections(index, path, k), steps, k, most)


def token_savings(index: Index, sources: DataFrame, asked: list[str], k: int = 5) -> DataFrame:
    from strandline.operators.evaluate import token_savings as savings

    hits = None
    for q in asked:
        found = search(index, q, k, centrality=False).select(F.lit(q).alias("query"), "snippet")
        hits = found if hits is None else hits.unionByName(found)
    return savings(sources, hits)
