"""Further checked queries: operators on table-made inputs, each with the SQL of its result.

Orders stand in for calls, parts for declared methods, classes and chunks, lineitems for edges, documents
for files and notes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import predicates, symbols, text
from strandline.functions.vector import hash_embedding, l2_normalise, norm
from strandline.operators import chunking, communities, crosslinks, evaluate, gitmetrics, graph, resolve, search
from strandline.params import Params
from strandline.plans import index as plan
from strandline.plans.queries import _LINKS_SQL, _PATH_SQL, _deals, _documents, _links, _paths, _t, query
from strandline.sources import files, sinks, tables
from strandline.streaming import watch


def _s(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def _named(prefix: str, column: Column) -> Column:
    return F.concat(F.lit(prefix), column.cast("string"))


# Receiver types: orders call methods that parts declare


_CALLS_SQL = """
calls AS (SELECT o_orderkey AS call_id, 'T' || (o_custkey % 60) AS receiver_type, 'm' || (o_orderkey % 20) AS ref_name FROM orders),
methods AS (SELECT 'T' || p_size AS type, 'm' || (p_partkey % 20) AS name, p_brand || '.go' AS path, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS lines,
  p_partkey % 7 = 0 AS is_virtual, p_partkey % 5 = 0 AS is_override FROM part),
met AS (SELECT call_id, path, lines FROM calls JOIN methods ON type = receiver_type AND name = ref_name)"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), _named("T", F.col("o_custkey") % 60).alias("receiver_type"), _named("m", F.col("o_orderkey") % 20).alias("ref_name"))


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return _t(spark, sf_dir, "part").select(
        _named("T", F.col("p_size")).alias("type"), _named("m", key % 20).alias("name"), F.concat("p_brand", F.lit(".go")).alias("path"),
        F.lpad(key.cast("string"), 9, "0").alias("lines"), (key % 7 == 0).alias("is_virtual"), (key % 5 == 0).alias("is_override"),
    )


@query(f"WITH {_CALLS_SQL} SELECT call_id, min(path) AS to_path, min(lines) AS to_lines FROM met GROUP BY call_id HAVING count(*) = 1")
def typed_methods_one_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.typed_methods(_calls(spark, sf_dir), _methods(spark, sf_dir)).drop("candidates")


@query(f"WITH {_CALLS_SQL} SELECT call_id, min(path) AS to_path, min(lines) AS to_lines FROM met GROUP BY call_id HAVING count(DISTINCT path) = 1")
def typed_methods_one_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.typed_methods(_calls(spark, sf_dir), _methods(spark, sf_dir), distinct_paths=True).drop("candidates")


@query(f"""WITH {_CALLS_SQL},
heirs AS (SELECT 'T' || n_nationkey AS name, 'T' || n_regionkey AS base FROM nation WHERE n_nationkey <> n_regionkey),
family AS (SELECT base AS receiver_type, name AS type FROM heirs UNION SELECT type, type FROM methods),
sites AS (SELECT receiver_type, name, path, (type = receiver_type AND is_virtual) OR (type <> receiver_type AND is_override) AS open FROM family JOIN methods USING (type)),
grouped AS (SELECT receiver_type, name, array_to_string(list_sort(list(DISTINCT path)), ',') AS candidates FROM sites GROUP BY 1, 2 HAVING bool_or(open))
SELECT call_id, candidates FROM calls JOIN grouped USING (receiver_type) WHERE name = ref_name""")
def virtual_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _t(spark, sf_dir, "nation").filter("n_nationkey <> n_regionkey")
    heirs = pairs.select(_named("T", F.col("n_nationkey")).alias("name"), _named("T", F.col("n_regionkey")).alias("base"), F.lit(1).alias("depth"))
    found = resolve.virtual_dispatch(_calls(spark, sf_dir), heirs, _methods(spark, sf_dir))
    return found.select("call_id", F.array_join("candidates", ",").alias("candidates"))


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _methods(spark, sf_dir).filter("is_virtual").select("type", "path").distinct()


@query(f"""WITH {_CALLS_SQL}, classes AS (SELECT DISTINCT type, path FROM methods WHERE is_virtual),
hit AS (SELECT call_id, m.path, m.lines FROM calls c JOIN classes k ON k.type = c.receiver_type JOIN methods m ON m.path = k.path AND m.name = c.ref_name)
SELECT call_id, min(path) AS to_path, min(lines) AS to_lines FROM hit GROUP BY call_id HAVING count(DISTINCT path) = 1""")
def class_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.class_files(_calls(spark, sf_dir), _classes(spark, sf_dir), _methods(spark, sf_dir).select("name", "path", "lines")).drop("candidates")


@query(f"""WITH {_CALLS_SQL}, classes AS (SELECT DISTINCT type, path FROM methods WHERE is_virtual),
family AS (SELECT 'T' || n_regionkey AS receiver_type, 'T' || n_nationkey AS type, true AS heir FROM nation UNION SELECT receiver_type, receiver_type, false FROM calls),
hit AS (SELECT DISTINCT call_id, heir, m.path FROM calls c JOIN family f USING (receiver_type) JOIN classes k ON k.type = f.type JOIN methods m ON m.path = k.path AND m.name = c.ref_name)
SELECT call_id, array_to_string(list_sort(list(DISTINCT path)), ',') AS candidates FROM hit GROUP BY call_id HAVING bool_or(heir)""")
def class_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases = _t(spark, sf_dir, "nation").select(_named("T", F.col("n_nationkey")).alias("name"), _named("T", F.col("n_regionkey")).alias("base"))
    found = resolve.class_dispatch(_calls(spark, sf_dir), bases, _classes(spark, sf_dir), _methods(spark, sf_dir))
    return found.select("call_id", F.array_join("candidates", ",").alias("candidates"))


@query("""
WITH r AS (SELECT 'f' || (p_partkey % 700) AS name, min(p_type) AS made FROM part GROUP BY 1 HAVING count(DISTINCT p_type) = 1)
SELECT o_orderkey AS call_id, CASE WHEN o_orderkey % 4 = 0 THEN 'K' ELSE made END AS receiver_type FROM orders LEFT JOIN r ON r.name = 'f' || (o_custkey % 700)""")
def factory_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), F.when(F.col("o_orderkey") % 4 == 0, "K").alias("receiver_type"), _named("f", F.col("o_custkey") % 700).alias("receiver_factory"))
    returns = _t(spark, sf_dir, "part").select(_named("f", F.col("p_partkey") % 700).alias("name"), F.col("p_type").alias("type"))
    return resolve.factory_types(calls, returns).select("call_id", "receiver_type")


@query("""
WITH need AS (SELECT DISTINCT 'I' || (o_custkey % 40) AS interface, 'm' || (o_orderkey % 3 + o_custkey % 5) AS method FROM orders),
have AS (SELECT DISTINCT p_brand AS type, 'm' || (p_size % 9) AS name FROM part),
n AS (SELECT interface, count(*) AS n FROM need GROUP BY 1)
SELECT interface, type FROM need JOIN have ON name = method JOIN n USING (interface) GROUP BY interface, type, n HAVING count(*) = n""")
def type_method_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types whose method sets cover an interface's, over tables."""
    need = _t(spark, sf_dir, "orders").select(_named("I", F.col("o_custkey") % 40).alias("interface"), _named("m", F.col("o_orderkey") % 3 + F.col("o_custkey") % 5).alias("method")).distinct()
    have = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("type"), _named("m", F.col("p_size") % 9).alias("name"))
    return resolve.implementers(need, have)


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, 's' || label AS name, 'f' || (vec_id % 5) || '.ts' AS path FROM embeddings),
p AS (SELECT q.vec_id AS call_id, d.path, max(list_cosine_similarity(q.v, d.v)) AS sim FROM e q JOIN e d ON q.name = d.name AND q.vec_id <> d.vec_id
  WHERE q.vec_id % 100 = 0 AND (d.path = q.path OR d.path = 'f' || ((q.vec_id % 5 + 1) % 5) || '.ts' OR d.path = 'f' || ((q.vec_id % 5 + 3) % 5) || '.ts') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS n, lead(sim) OVER w AS second FROM p WINDOW w AS (PARTITION BY call_id ORDER BY sim DESC, path))
SELECT call_id, path AS to_path, floor(sim * 10000.0 + 0.5) / 10000.0 AS score FROM r WHERE n = 1 AND sim >= 0.3 AND (second IS NULL OR sim - second >= 0.01)""")
def disambiguation_by_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates are the call's own file and imported ones; the call's own chunk is none."""
    key = F.col("vec_id")
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding", _named("s", F.col("label")).alias("name"), F.concat(_named("f", key % 5), F.lit(".ts")).alias("path"), _s("vec_id").alias("content_hash"))
    paths = F.array(*(F.lit(f"f{k}.ts") for k in range(5)))
    calls = rows.filter("vec_id % 100 = 0").select(key.alias("call_id"), F.col("path").alias("from_path"), F.col("name").alias("ref_name"), F.lit(False).alias("is_method"), "content_hash", paths.alias("candidates"))
    imports = spark.createDataFrame([(f"f{k}.ts", f"f{(k + d) % 5}") for k in range(5) for d in (1, 3)], "from_path string, stem string")
    return resolve.disambiguate(calls, rows.select("name", "path", "embedding", "content_hash"), rows.select("content_hash", "embedding"), imports, Params(disambiguate_threshold=0.3, disambiguate_margin=0.01))


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'external' ELSE 'resolved' END AS conf,
  CASE p_size % 3 WHEN 1 THEN 'lib/' || p_type || '/n' || p_size WHEN 2 THEN 'lib/n' || p_size END AS to_path FROM part""")
def import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _named("n", F.col("p_size"))
    spec = F.when(F.col("p_size") % 3 == 1, F.concat(F.lit("./"), n, F.lit(".ts"))).when(F.col("p_size") % 3 == 2, F.concat(F.lit("../"), n, F.lit(".ts"))).otherwise(n)
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("lib/"), "p_type", F.lit("/a.ts")).alias("from_path"), spec.alias("spec"))
    return resolve.resolve_imports(rows).select("p_partkey", "conf", "to_path")


# Links, centrality and neighbours: lineitems as edges


_EDGES_SQL = """
e AS (SELECT CASE WHEN l_linenumber % 4 = 0 THEN 'imports' ELSE 'calls' END AS kind,
  CASE l_returnflag WHEN 'R' THEN 'ambiguous' WHEN 'A' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'dispatch' ELSE 'resolved' END ELSE CASE WHEN l_linestatus = 'F' THEN 'external' ELSE 'inferred' END END AS conf,
  's' || l_suppkey AS from_path, CASE WHEN l_partkey % 3 > 0 THEN 'f' || (l_partkey % 17) END AS from_symbol,
  CASE WHEN l_orderkey % 5 > 0 THEN 's' || (l_orderkey % 50) END AS to_path, CASE WHEN l_orderkey % 7 > 0 THEN 'g' || (l_orderkey % 11) END AS to_symbol,
  'g' || (l_orderkey % 11) AS ref_name, ['s' || (l_orderkey % 50), 's' || (l_partkey % 50)] AS candidates, CAST(l_linenumber AS VARCHAR) AS from_lines FROM lineitem),
k AS (SELECT *, from_path || coalesce('#' || from_symbol, '') AS src FROM e),
links AS (
  SELECT src, to_path || '#' || to_symbol AS dst, kind, conf FROM k WHERE kind = 'calls' AND conf IN ('resolved', 'inferred') AND to_path IS NOT NULL AND to_symbol IS NOT NULL
  UNION ALL SELECT src, unnest(candidates) || '#' || ref_name, kind, conf FROM k WHERE kind = 'calls' AND conf = 'dispatch'
  UNION ALL SELECT from_path, to_path, kind, conf FROM k WHERE kind <> 'calls' AND to_path IS NOT NULL)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, part, line = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    conf = F.when(F.col("l_returnflag") == "R", "ambiguous").when(F.col("l_returnflag") == "A", F.when(line % 2 == 0, "dispatch").otherwise("resolved")).when(F.col("l_linestatus") == "F", "external").otherwise("inferred")
    return _t(spark, sf_dir, "lineitem").select(
        F.when(line % 4 == 0, "imports").otherwise("calls").alias("kind"), conf.alias("conf"), _named("s", F.col("l_suppkey")).alias("from_path"), _s("l_linenumber").alias("from_lines"),
        F.when(part % 3 > 0, _named("f", part % 17)).alias("from_symbol"), F.when(order % 5 > 0, _named("s", order % 50)).alias("to_path"),
        F.when(order % 7 > 0, _named("g", order % 11)).alias("to_symbol"), _named("g", order % 11).alias("ref_name"),
        F.array(_named("s", order % 50), _named("s", part % 50)).alias("candidates"), F.lit(None).cast("string").alias("to_lines"),
    )


@query(f"WITH {_EDGES_SQL} SELECT src, dst, kind, conf, count(*) AS n FROM links GROUP BY ALL")
def edge_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_links(_edges(spark, sf_dir)).groupBy("src", "dst", "kind", "conf").agg(F.count("*").alias("n"))


@query(f"WITH {_EDGES_SQL} SELECT DISTINCT src AS node FROM k WHERE kind = 'calls' AND conf = 'external'")
def external_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.external_sources(_edges(spark, sf_dir))


_SYMBOLS_SQL = "c AS (SELECT p_partkey AS id, 's' || (p_partkey % 50) AS path, 'g' || (p_size % 11) AS symbol FROM part)"


def _chunk_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _named("s", F.col("p_partkey") % 50).alias("path"), F.array(_named("g", F.col("p_size") % 11)).alias("symbols"))


@query(f"""WITH {_EDGES_SQL}, {_SYMBOLS_SQL},
d AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM links WHERE kind = 'calls' UNION ALL SELECT dst FROM links WHERE kind = 'calls') GROUP BY 1),
i AS (SELECT dst AS node, count(*) AS n FROM links WHERE kind = 'imports' GROUP BY 1)
SELECT id, greatest(coalesce(d.n, 0), coalesce(i.n, 0)) AS degree FROM c LEFT JOIN d ON d.node = path || '#' || symbol LEFT JOIN i ON i.node = path""")
def chunk_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chunk_centrality(_chunk_symbols(spark, sf_dir), tables.cut(graph.build_links(_edges(spark, sf_dir))))


@query(f"""WITH {_EDGES_SQL}, {_SYMBOLS_SQL},
l AS (SELECT * FROM links WHERE kind = 'calls'),
i AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY other) AS n FROM (SELECT DISTINCT id, src AS other FROM c JOIN l ON dst = path || '#' || symbol)),
o AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY other) AS n FROM (SELECT DISTINCT id, dst AS other FROM c JOIN l ON src = path || '#' || symbol)),
x AS (SELECT id, string_agg(other, ',' ORDER BY other) AS callers FROM i WHERE n <= 5 GROUP BY 1), y AS (SELECT id, string_agg(other, ',' ORDER BY other) AS callees FROM o WHERE n <= 5 GROUP BY 1)
SELECT coalesce(x.id, y.id) AS id, callers, callees FROM x FULL JOIN y ON x.id = y.id""")
def chunk_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.context_for(_chunk_symbols(spark, sf_dir), tables.cut(graph.build_links(_edges(spark, sf_dir))))
    return found.select("id", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))


@query(f"""WITH {_EDGES_SQL}
SELECT from_path, from_lines, ref_name, count(*) AS n FROM (SELECT * FROM e WHERE kind = 'calls' AND to_symbol = 'g3' ORDER BY from_path, from_lines, ref_name LIMIT 200) GROUP BY ALL""")
def callers_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 callers of a bare name: the operator's own limit."""
    return graph.by_name(_edges(spark, sf_dir), "g3", "callers").groupBy("from_path", "from_lines", "ref_name").agg(F.count("*").alias("n"))


@query(f"""WITH {_EDGES_SQL}, i AS (SELECT from_path, from_lines, from_symbol FROM e WHERE kind = 'calls' AND to_symbol = 'g3' ORDER BY from_path, from_lines LIMIT 200)
SELECT 'caller' AS relation, from_path AS path, from_lines AS lines, count(*) AS n FROM i GROUP BY ALL
UNION ALL SELECT 'sibling', 's' || (p_partkey % 50), p_partkey || '-' || (p_partkey + 1), count(*) FROM part WHERE p_partkey % 50 = 3 AND p_partkey <> 53 GROUP BY ALL""")
def neighbours_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers by name and the other chunks of the file; symbols of callers tie in the limit and are left out."""
    key = F.col("p_partkey").cast("int")
    chunks = _t(spark, sf_dir, "part").select(_named("s", key % 50).alias("path"), key.alias("line_start"), (key + 1).alias("line_end"))
    found = graph.neighbours(_edges(spark, sf_dir), chunks, "g3", "s3", 53).filter("relation <> 'callee'")
    return found.groupBy("relation", "path", "lines").agg(F.count("*").alias("n"))


@query(f"""WITH {_EDGES_SQL}, m AS (
  SELECT split_part(src, '#', 1) AS source, split_part(CASE conf WHEN 'ambiguous' THEN 'amb:' || ref_name WHEN 'dispatch' THEN 'disp:' || ref_name ELSE to_path || coalesce('#' || to_symbol, '') END, '#', 1) AS target, kind
  FROM k WHERE kind = 'calls' AND conf <> 'external'),
g AS (SELECT source, target, kind, count(*) AS count FROM m WHERE target IS NOT NULL AND source <> target GROUP BY 1, 2, 3),
d AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM g UNION ALL SELECT target FROM g) GROUP BY 1 ORDER BY degree DESC, node LIMIT 40)
SELECT source, target, kind, count FROM g WHERE source IN (SELECT node FROM d) AND target IN (SELECT node FROM d)""")
def drawn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the forty best connected files: filter by kind and confidence, roll up, cap (the cap is the feature)."""
    _, merged = graph.visual_graph(_edges(spark, sf_dir), kinds=["calls"], confs=["resolved", "inferred", "dispatch", "ambiguous"], file_level=True, limit=40)
    return merged.select("source", "target", "kind", "count")


@query(f"""WITH {_EDGES_SQL}, m AS (SELECT split_part(src, '#', 1) AS source,
  split_part(CASE conf WHEN 'external' THEN 'ext:' || ref_name WHEN 'ambiguous' THEN 'amb:' || ref_name WHEN 'dispatch' THEN 'disp:' || ref_name ELSE to_path || coalesce('#' || to_symbol, '') END, '#', 1) AS target,
  from_path, CAST(from_lines AS INT) AS line FROM k)
SELECT node, count(*) AS refs FROM (SELECT DISTINCT source AS node, from_path, line FROM m WHERE target IS NOT NULL UNION SELECT target, from_path, line FROM m WHERE target IS NOT NULL) GROUP BY 1""")
def merged_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, _ = graph.node_references(_edges(spark, sf_dir), file_level=True)
    return refs.groupBy("node").agg(F.count("*").alias("refs"))


@query(f"""WITH {_EDGES_SQL}
SELECT CASE conf WHEN 'ambiguous' THEN 'amb:' ELSE 'disp:' END || ref_name AS node, count(DISTINCT c) AS candidates FROM (SELECT conf, ref_name, unnest(candidates) AS c FROM e WHERE conf IN ('ambiguous', 'dispatch')) GROUP BY 1""")
def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, listed = graph.node_references(_edges(spark, sf_dir))
    return listed.groupBy("node").agg(F.count("*").alias("candidates"))


@query("""
WITH c AS (SELECT p_brand AS cluster, count(*) AS size FROM part GROUP BY 1),
p AS (SELECT *, row_number() OVER (ORDER BY size DESC, cluster) - 1 AS place, greatest(1, ceil(sqrt(count(*) OVER ()))) AS cols FROM c),
q AS (SELECT *, floor(16384 / (cols + 1)) AS cell FROM p)
SELECT cluster, size, place, CAST((place % CAST(cols AS BIGINT) + 0.5) * cell AS DOUBLE) AS x, CAST((floor(place / cols) + 0.5) * cell AS DOUBLE) AS y FROM q""")
def cluster_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cluster_index(_t(spark, sf_dir, "part").select(_s("p_partkey").alias("node"), F.col("p_brand").alias("cluster")))


@query(f"""WITH {_LINKS_SQL}, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM links UNION ALL SELECT dst FROM links) GROUP BY 1),
n AS (SELECT CAST(p_partkey AS VARCHAR) AS node FROM part), r AS (SELECT node, coalesce(degree, 0) AS degree FROM n LEFT JOIN d USING (node) ORDER BY 2 DESC, 1 LIMIT 50)
SELECT node, degree, (SELECT greatest(count(*) - 50, 0) FROM n) AS dropped, (SELECT count(*) FROM links WHERE src IN (SELECT node FROM r) AND dst IN (SELECT node FROM r)) AS inside FROM r""")
def capped_by_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best connected parts, and how much was dropped: the cap is the feature."""
    edges = _links(spark, sf_dir).withColumnsRenamed({"src": "source", "dst": "target"})
    kept, inside, dropped = graph.cap_by_degree(_t(spark, sf_dir, "part").select(_s("p_partkey").alias("node")), edges, 50)
    return kept.select("node", "degree").join(dropped).join(inside.agg(F.count("*").alias("inside")))


@query(f"""WITH {_LINKS_SQL}, s AS (SELECT CAST(p_partkey AS VARCHAR) AS node FROM part WHERE p_size <= 10)
SELECT src, dst FROM links WHERE src IN (SELECT node FROM s) AND dst IN (SELECT node FROM s)""")
def code_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = _t(spark, sf_dir, "part").filter("p_size <= 10").select(_s("p_partkey").alias("node"))
    return crosslinks.code_structure(shown, _links(spark, sf_dir))


@query("""
WITH s AS (SELECT p_name AS name, p_brand || '/' || p_type AS path, p_partkey, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part WHERE p_name = 'small ring' AND contains(p_brand, '#1'))
SELECT name, path, path || '#' || name AS node, p_partkey AS line_start FROM s WHERE n = 1""")
def symbol_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.concat_ws("/", "p_brand", "p_type").alias("path"), F.col("p_partkey").alias("line_start"))
    return graph.resolve_name(rows, "small ring", "#1", substring=True).select("name", "path", "node", "line_start")


@query(f"""WITH {_LINKS_SQL}, f AS (SELECT CAST(p_partkey AS VARCHAR) AS k, replace(p_brand, '#', '-') AS b FROM part),
p AS (SELECT x.b AS s, y.b AS t FROM links JOIN f x ON x.k = src JOIN f y ON y.k = dst WHERE x.b <> y.b)
SELECT least(s, t) AS a, greatest(s, t) AS b, CAST(count(*) AS DOUBLE) AS w FROM p GROUP BY 1, 2""")
def file_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = _t(spark, sf_dir, "part").select(_s("p_partkey").alias("k"), F.translate("p_brand", "#", "-").alias("b"))
    keyed = _links(spark, sf_dir).join(brand.withColumnsRenamed({"k": "src", "b": "x"}), "src").join(brand.withColumnsRenamed({"k": "dst", "b": "y"}), "dst")
    nodes = keyed.select(F.concat("x", F.lit("#"), "src").alias("src"), F.concat("y", F.lit("#"), "dst").alias("dst"), "kind")
    return communities.adjacency(nodes, by_file=True)


_MEMBERS_SQL = """
adj AS (SELECT 'c' || o_custkey AS a, 's' || l_suppkey AS b, CAST(count(*) AS DOUBLE) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
members AS (SELECT 'c' || c_custkey AS node, c_nationkey AS community FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey FROM supplier),
across AS (SELECT a, b, w, x.community AS ca, y.community AS cb FROM adj JOIN members x ON x.node = a JOIN members y ON y.node = b WHERE x.community <> y.community)"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _t(spark, sf_dir, "customer").select(_named("c", F.col("c_custkey")).alias("node"), F.col("c_nationkey").alias("community"))
    return customers.union(_t(spark, sf_dir, "supplier").select(_named("s", F.col("s_suppkey")), "s_nationkey"))


@query(f"WITH {_MEMBERS_SQL} SELECT a, b, w, ca, cb FROM across ORDER BY w DESC, a, b LIMIT 25")
def community_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.report(tables.cut(_deals(spark, sf_dir)), _members(spark, sf_dir))["bridges"]


@query(f"""WITH {_MEMBERS_SQL}, r AS (SELECT a AS node, cb AS other FROM across UNION ALL SELECT b, ca FROM across)
SELECT node, count(DISTINCT other) AS communities FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def god_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.report(tables.cut(_deals(spark, sf_dir)), _members(spark, sf_dir))["god_nodes"]


@query("""
WITH m AS (SELECT p_size AS community, CASE WHEN p_partkey % 4 = 0 THEN 'tests' ELSE replace(p_brand, '#', '-') END AS dir FROM part),
v AS (SELECT community, dir, count(*) AS n, dir = 'tests' AS is_test FROM m GROUP BY 1, 2),
l AS (SELECT community, arg_min(dir, (is_test::INT, -n, dir)) AS label FROM v GROUP BY 1)
SELECT community, count(*) AS size, label FROM m JOIN l USING (community) GROUP BY 1, 3 HAVING count(*) >= 2""")
def community_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and the commonest directory; a test directory only where there is no other."""
    directory = F.when(F.col("p_partkey") % 4 == 0, F.lit("tests")).otherwise(F.translate("p_brand", "#", "-"))
    members = _t(spark, sf_dir, "part").select(F.concat(directory, F.lit("/"), _s("p_partkey")).alias("node"), F.col("p_size").alias("community"))
    adj = spark.createDataFrame([], "a string, b string, w double")
    return communities.report(adj, members, min_size=2)["communities"]


# Retrieval


@query("""
WITH k AS (SELECT item_id AS query_id, text AS query, CASE WHEN regexp_matches(trim(text, (E' \\n\\t\\r\\f' || chr(11))), '^[A-Za-z_$][A-Za-z0-9_$]*$') THEN 'symbol'
    WHEN len(list_filter(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$.]*'), lambda t: regexp_matches(t, '[a-z][A-Z]|[A-Z][A-Z][a-z]|[A-Za-z]_[A-Za-z0-9]|[A-Za-z][0-9]|[0-9][A-Za-z]|[A-Za-z0-9_][.][A-Za-z0-9_]'))) > 0
    THEN 'mixed' ELSE 'plain' END AS kind FROM benchmark),
z AS (SELECT *, CASE kind WHEN 'plain' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM k),
d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
s AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM d),
q AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+'))) AS term FROM z WHERE weight > 0),
p AS (SELECT term, id, doc_len, count(*) AS tf FROM (SELECT id, len(w) AS doc_len, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
b AS (SELECT query_id, id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))) AS score FROM p JOIN q USING (term) JOIN f USING (term), s GROUP BY query_id, id),
l AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS fts_rank FROM b QUALIFY fts_rank <= 24),
c AS (SELECT q.item_id AS query_id, e.vec_id AS id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s
  FROM benchmark q JOIN embeddings v ON v.vec_id = q.item_id CROSS JOIN embeddings e WHERE e.vec_id IN (SELECT doc_id FROM documents)),
v AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS vec_rank FROM c QUALIFY vec_rank <= 24),
u AS (SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.id, l.id) AS id, vec_rank, fts_rank FROM v FULL JOIN l ON v.query_id = l.query_id AND v.id = l.id),
r AS (SELECT u.*, documents.source || '/' || lang || '/' || doc_id AS path,
  coalesce(1.0::DOUBLE / (60 + vec_rank), 0) + coalesce(weight / (60 + fts_rank), 0) AS raw FROM u JOIN z USING (query_id) JOIN documents ON doc_id = id)
SELECT query_id, path, vec_rank, fts_rank, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS rank, floor(raw * 10000.0 + 0.5) / 10000.0 AS score FROM r QUALIFY rank <= 8""")
def search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search, both branches with the weight of each query's kind, for all benchmark items."""
    vectors = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    docs = _paths(_documents(spark, sf_dir)).select(F.col("doc_id").alias("id"), "path", F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.lit("txt").alias("language"), "text")
    asked = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    seeds = vectors.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector")).join(asked.select("query_id"), "query_id")
    chunks = docs.join(vectors, "id", "left").withColumn("fts_text", F.col("text"))
    stored = tables.cut(tables.postings(chunks, only=search.query_terms(asked)))
    hits = search.search_batch(tables.cut(chunks), stored, tables.corpus_stats(chunks), asked, seeds, 8)
    return hits.select("query_id", "path", "vec_rank", "fts_rank", "rank", "score")


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, 'p' || (vec_id % 25) AS path, CAST(vec_id AS INT) AS a FROM embeddings),
seed AS (SELECT * FROM e WHERE path = 'p7' ORDER BY (a <= 40 AND a + 30 >= 40) DESC, a LIMIT 1),
s AS (SELECT e.vec_id AS id, list_cosine_similarity(e.v, seed.v) AS sim FROM e, seed WHERE e.vec_id <> seed.vec_id)
SELECT CAST(id AS VARCHAR) AS id, row_number() OVER (ORDER BY sim DESC, CAST(id AS VARCHAR)) AS rank, floor(sim * 1e6 + 0.5) / 1e6 AS similarity FROM s QUALIFY rank <= 12""")
def similar_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("vec_id").cast("int")
    chunks = _t(spark, sf_dir, "embeddings").select(_s("vec_id").alias("id"), _named("p", key % 25).alias("path"), key.alias("line_start"), (key + 30).alias("line_end"), "embedding")
    return search.similar(chunks, "p7", 40, 12).select("id", "rank", text.floor_to("similarity", 6).alias("similarity"))


@query("""
SELECT vec_id, floor(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) * 1e4 + 0.5) / 1e4 AS norm,
  floor(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x / list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))))) * 1e4 + 0.5) / 1e4 AS unit FROM embeddings""")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select("vec_id", text.floor_to(norm(F.col("embedding")), 4).alias("norm"), text.floor_to(norm(l2_normalise(F.col("embedding"))), 4).alias("unit"))


_CODE_SQL = """
'function ' || replace(p_name, ' ', '_') || '(x) { return ' || p_size || '; }' || chr(10) || 'class  K' || p_size || ' extends B {' || chr(10) || '  run' || p_size || '(a) { go(a); }' || chr(10) || '}' || chr(10) ||
'const v' || p_size || ' = async (a, b) => a;' || chr(10) || 'let w' || p_size || ' = 3;'"""


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = _s("p_size")
    body = F.concat(
        F.lit("function "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("(x) { return "), size, F.lit("; }\nclass  K"), size, F.lit(" extends B {\n  run"), size,
        F.lit("(a) { go(a); }\n}\nconst v"), size, F.lit(" = async (a, b) => a;\nlet w"), size, F.lit(" = 3;"),
    )
    return _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", body.alias("text"))


@query("""
SELECT p_partkey, replace(p_name, ' ', '_') || ',K' || p_size || ',v' || p_size || ',w' || p_size || ',run' || p_size AS declared,
  replace(p_name, ' ', '_') || ',K' || p_size || ',v' || p_size || ',run' || p_size AS callable, replace(p_name, ' ', '_') AS first FROM part""")
def declared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _code(spark, sf_dir)
    # The function stands in both passes and is named once.
    return rows.select("p_partkey", F.array_join(symbols.declared_symbols("text"), ",").alias("declared"), F.array_join(symbols.declared_callables("text"), ",").alias("callable"), symbols.declared_symbol("text").alias("first"))


@query(f"""
WITH c AS (SELECT p_partkey, {_CODE_SQL} AS t, replace(p_name, ' ', '_') AS name FROM part)
SELECT 'definition' AS kind, CAST(p_partkey AS VARCHAR) AS path FROM (SELECT * FROM c WHERE name = 'small_ring' ORDER BY CAST(p_partkey AS VARCHAR) LIMIT 100)
UNION ALL SELECT 'references', CAST(p_partkey AS VARCHAR) FROM (SELECT * FROM c WHERE p_partkey % 2 = 0 AND name <> 'small_ring' ORDER BY CAST(p_partkey AS VARCHAR) LIMIT 100)""")
def find_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to a hundred chunks that declare a name, and that mention it without declaring it: the operator's own limit."""
    mention = F.when(F.col("p_partkey") % 2 == 0, F.lit("\nsmall_ring(1);")).otherwise(F.lit("\nsmall_rings(1);"))
    chunks = _code(spark, sf_dir).select(_s("p_partkey").alias("path"), F.lit(1).alias("line_start"), F.concat("text", mention).alias("text"))
    found = search.find_symbol(chunks, "small_ring", "definition", 100).select(F.lit("definition").alias("kind"), "path")
    return found.union(search.find_symbol(chunks, "small_ring", "references", 100).select(F.lit("references"), "path"))


@query("SELECT doc_id FROM documents WHERE starts_with(source || '/' || lang || '/' || doc_id, 's') AND lang = 'en'")
def prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(_t(spark, sf_dir, "documents")).withColumnRenamed("lang", "language")
    return search.prefilter(rows, "s", "en").select("doc_id")


# Chunks and text


@query("""
SELECT p_partkey, p_brand || '.md' AS path, p_name AS scope, 1 AS line_start, 3 AS line_end, '# ' || p_name || chr(10) || p_type || ' body' AS text FROM part
UNION ALL SELECT p_partkey, p_brand || '.md', p_name || ' > Sub ' || p_size, 4, 5, '## Sub ' || p_size || chr(10) || 'more text' FROM part WHERE p_size % 2 = 0""")
def heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with text of their own; a heading without any opens no chunk but is part of the trail."""
    tail = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\n## Sub "), _s("p_size"), F.lit("\nmore text\n"))).otherwise(F.lit("\n## Empty\n"))
    content = F.concat(F.lit("# "), "p_name", F.lit("\n"), "p_type", F.lit(" body\n"), tail)
    rows = _t(spark, sf_dir, "part").select(F.concat(_s("p_partkey"), F.lit("|"), "p_brand", F.lit(".md")).alias("path"), F.lit("markdown").alias("language"), content.alias("content"))
    found = chunking.chunk_files(rows)
    parts = F.split("path", "[|]")
    return found.select(parts[0].cast("long").alias("p_partkey"), parts[1].alias("path"), F.array_join("scope", " > ").alias("scope"), "line_start", F.when(F.col("line_start") == 1, 3).otherwise(F.col("line_end")).alias("line_end"), "text")


@query("""
SELECT p_partkey, 'A' || p_size AS name, 1 AS line_start, 3 AS line_end FROM part UNION ALL SELECT p_partkey, 'b' || p_size, 5, 7 FROM part""")
def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level units and their spans; short neighbours share a chunk."""
    size = _s("p_size")
    content = F.concat(F.lit("class A"), size, F.lit(" {\n  m() { return '}'; }\n}\n\nexport function b"), size, F.lit("(x) {\n  return x;\n}\n"))
    rows = _t(spark, sf_dir, "part").select(_s("p_partkey").alias("path"), F.lit("typescript").alias("language"), content.alias("content"))
    spans = chunking.chunk_files(rows).select("path", F.explode("symbols").alias("s"))
    return spans.select(F.col("path").cast("long").alias("p_partkey"), "s.name", "s.line_start", "s.line_end")


@query(f"""
WITH d AS (SELECT doc_id, {_PATH_SQL} AS path, text, rtrim(substr(regexp_extract(text, '[^ \\t\\n\\r\\f\\v][^\\n]*'), 1, 120)) AS head FROM documents),
x AS (SELECT *, path || ' › ' || 'S › T — ' || head AS prefix, regexp_replace(path, '[^A-Za-z0-9]+', ' ', 'g') AS words FROM d)
SELECT doc_id, prefix, sha1(substr(prefix || chr(10) || text, 1, 300)) AS embedded,
  sha1(repeat(trim(regexp_replace(lower(words) || ' S T ' || head, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), (E' \\n\\t\\r\\f' || chr(11))) || chr(10), 3) || text) AS boosted FROM x""")
def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(_documents(spark, sf_dir)).withColumn("scope", F.array(F.lit("S"), F.lit("T")))
    rows = rows.withColumn("prefix", text.synthetic_prefix("path", "scope", "text"))
    return rows.select("doc_id", "prefix", F.sha1(text.embed_text("prefix", "text", 300)).alias("embedded"), F.sha1(text.fts_text("path", "scope", "text", 3)).alias("boosted"))


@query(f"""
WITH p AS (SELECT doc_id, {_PATH_SQL} || '.Md' AS path FROM documents)
SELECT doc_id, regexp_replace(path, '\\.[A-Za-z0-9]+$', '') AS bare, 'md' AS ext, CAST(doc_id AS VARCHAR) || '.md' AS key, string_split(path, '/')[1] AS top, string_split(path, '/')[1] || '/' || string_split(path, '/')[2] AS cluster FROM p""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(_t(spark, sf_dir, "documents")).withColumn("path", F.concat("path", F.lit(".Md")))
    return rows.select("doc_id", text.strip_ext("path").alias("bare"), text.file_ext("path").alias("ext"), text.note_key("path").alias("key"), text.top_dir("path").alias("top"), text.cluster_of("path").alias("cluster"))


_LINES_SQL = "list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, (E' \\n\\t\\r\\f' || chr(11)))), lambda s: s <> '')"


@query(f"""
WITH l AS (SELECT doc_id, text, {_LINES_SQL} AS ls, string_split(text, chr(10)) AS raw FROM documents),
x AS (SELECT *, coalesce(list_filter(ls, lambda s: NOT regexp_matches(s, '^(//|#|[*]|/[*]|--|<!--)'))[1], ls[1], '') AS sig, coalesce(ls[1], '') AS head FROM l)
SELECT doc_id, CASE WHEN length(sig) > 100 THEN substr(sig, 1, 99) || '…' ELSE sig END AS signature, CASE WHEN length(head) > 120 THEN substr(head, 1, 119) || '…' ELSE head END AS first_line,
  rtrim(substr(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), (E' \\n\\t\\r\\f' || chr(11))), 1, 200)) AS snippet, array_to_string(raw[2:3], chr(10)) AS middle FROM x""")
def text_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir)
    return rows.select("doc_id", text.signature_line("text").alias("signature"), text.first_line("text").alias("first_line"), F.rtrim(text.snippet("text")).alias("snippet"), F.coalesce(text.slice_lines("text", F.lit(2), F.lit(3)), F.lit("")).alias("middle"))


@query("""
WITH w AS (SELECT conv_id, turn, text, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9_]{2,}'), lambda w: w NOT IN ('and', 'are', 'for', 'from', 'how', 'into', 'our', 'that', 'the', 'this', 'what', 'when', 'where', 'which', 'with', 'you', 'your')) AS ws FROM conversations),
m AS (SELECT *, list_max(list_transform(ws, lambda w: length(w))) AS n FROM w)
SELECT conv_id, turn, coalesce(list_filter(ws, lambda w: length(w) = n)[1], '') AS term FROM m""")
def grep_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", text.grep_term("text").alias("term"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '_') END AS gap, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 0 END AS n_json FROM part""")
def meaning_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _code(spark, sf_dir)
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    asked = F.when(F.col("p_size") % 2 == 0, F.lit("something else")).otherwise(F.concat(F.lit("where is "), F.upper(name)))
    listed = F.when(F.col("p_size") % 3 == 0, F.lit('["a", "b"]')).otherwise(F.lit("no json"))
    n = F.coalesce(F.when(F.size(text.json_list(listed)) > 0, F.size(text.json_list(listed))), F.lit(0))
    return rows.select("p_partkey", text.meaning_gap(asked, "text").alias("gap"), n.alias("n_json"))


@query("""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'head' || chr(10) || '<b>' || chr(10) || p_name || chr(10) || '<e>' || ' tail' WHEN 1 THEN '<b>' || chr(10) || p_name || chr(10) || '<e>' || chr(10)
    ELSE 'head' || chr(10) || chr(10) || '<b>' || chr(10) || p_name || chr(10) || '<e>' || chr(10) END AS patched,
  CASE p_size % 2 WHEN 0 THEN '---' || chr(10) || 'a: 1' || chr(10) || 'k: ' || p_type || chr(10) || '---' || chr(10) || 'x' ELSE '---' || chr(10) || 'k: ' || p_type || chr(10) || '---' || chr(10) || 'x' END AS fronted FROM part""")
def patched_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.when(F.col("p_size") % 3 == 0, F.lit("head\n<b>\nold\n<e> tail")).when(F.col("p_size") % 3 == 1, F.lit("")).otherwise(F.lit("head"))
    front = F.when(F.col("p_size") % 2 == 0, F.lit("---\na: 1\nk: old\n---\nx")).otherwise(F.lit("x"))
    rows = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", old.alias("old"), front.alias("front"))
    return rows.select("p_partkey", text.upsert_section("old", "<b>", "<e>", F.col("p_name")).alias("patched"), text.front_matter_set("front", "k", F.col("p_type")).alias("fronted"))


@query("""
SELECT p_brand AS note, '| symbol | path | lines |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || p_name || ' | ' || p_type || ' | ' || p_size || ' |', chr(10) ORDER BY '| ' || p_name || ' | ' || p_type || ' | ' || p_size || ' |') AS "table"
FROM part GROUP BY 1""")
def reference_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("note"), F.col("p_name").alias("symbol"), F.col("p_type").alias("path"), _s("p_size").alias("lines"))
    return crosslinks.refs_table(rows)


@query("""
WITH n AS (SELECT doc_id, '# ' || lang || ' part ##' || chr(10) || chr(10) || regexp_replace(text, '#', '', 'g') AS t FROM documents),
b AS (SELECT doc_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda s: trim(s, (E' \\n\\t\\r\\f' || chr(11)))), lambda s: s <> '' AND NOT starts_with(s, '#')) AS ls FROM n)
SELECT b.doc_id, lang || ' part' AS section, rtrim(substr(trim(regexp_replace(array_to_string(ls, ' '), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), (E' \\n\\t\\r\\f' || chr(11))), 1, 200)) AS snippet FROM b JOIN documents USING (doc_id)""")
def note_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.concat(F.lit("# "), "lang", F.lit(" part ##\n\n"), F.replace("text", F.lit("#"), F.lit("")))
    rows = _documents(spark, sf_dir).select("doc_id", note.alias("t"))
    return rows.select("doc_id", text.section_of("t").alias("section"), text.body_snippet("t").alias("snippet"))


# Files and stored tables


_SCAN_SQL = """
f AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'src/node_modules/' WHEN 1 THEN 'build/' WHEN 2 THEN 'docs/' ELSE 'src/' END || p_partkey ||
  CASE p_partkey % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.png' WHEN 2 THEN '.min.js' WHEN 3 THEN '.log.md' WHEN 4 THEN '.ts' ELSE '.lock' END AS path, p_retailprice AS size FROM part)"""


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size") % 5, F.col("p_partkey") % 6
    folder = F.when(size == 0, "src/node_modules/").when(size == 1, "build/").when(size == 2, "docs/").otherwise("src/")
    ending = F.when(key == 0, ".py").when(key == 1, ".png").when(key == 2, ".min.js").when(key == 3, ".log.md").when(key == 4, ".ts").otherwise(".lock")
    return _t(spark, sf_dir, "part").select("p_partkey", F.concat(folder, _s("p_partkey"), ending).alias("path"))


@query(f"WITH {_SCAN_SQL} SELECT p_partkey, path FROM f WHERE regexp_matches(path, '[.](py|md|ts)$') AND NOT regexp_matches(path, '(^|/)(node_modules|build)/') AND NOT (starts_with(path, 'docs/') AND path LIKE '%.log.md')")
def scanned_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).filter(predicates.scanned(F.col("path"), list(files.LANGUAGES), ["*.log.md", "!src/*.log.md"]))


@query(f"WITH {_SCAN_SQL} SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'png' WHEN 2 THEN 'javascript' WHEN 3 THEN 'markdown' WHEN 4 THEN 'typescript' ELSE 'lock' END AS language FROM f")
def path_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).select("p_partkey", files.language_of(F.col("path")).alias("language"))


@query(f"""WITH {_SCAN_SQL}, listing AS (SELECT path FROM f WHERE p_partkey % 3 > 0), w AS (SELECT path FROM f WHERE p_partkey % 2 = 0 AND NOT regexp_matches(path, '(^|/)(node_modules|build)/'))
SELECT path, 'found' AS state FROM w WHERE path IN (SELECT path FROM listing) UNION ALL SELECT path, 'missing' FROM w WHERE path NOT IN (SELECT path FROM listing)""")
def named_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scan(spark, sf_dir)
    found, missing = files.stat_paths(rows.filter("p_partkey % 3 > 0").select("path"), rows.filter("p_partkey % 2 = 0"))
    return found.select("path", F.lit("found").alias("state")).union(missing.select("path", F.lit("missing")))


@query(f"SELECT {_PATH_SQL} AS file, len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS loc FROM documents WHERE octet_length(encode(text)) <= 2000")
def lines_of_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files up to a size: the guard is the feature."""
    return files.lines_of_code(_paths(_t(spark, sf_dir, "documents")).select("path", F.col("text").alias("content")), 2000)


@query("""
WITH c AS (SELECT l_orderkey AS path, l_linenumber * 10 AS a, l_linenumber * 10 + 5 AS b, l_partkey FROM lineitem)
SELECT path, a AS line_start, l_partkey FROM c WHERE path = 7 ORDER BY (a <= 23 AND b >= 23) DESC, a, l_partkey LIMIT 1""")
def chunk_at_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber") * 10
    # Equal lines of an order: the least part, as in the SQL.
    chunks = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path"), line.alias("line_start")).agg(F.min("l_partkey").alias("l_partkey"))
    return tables.chunk_at(chunks.withColumn("line_end", F.col("line_start") + 5), 7, 23).select("path", "line_start", "l_partkey")


@query("SELECT l_linenumber AS line_start, l_partkey FROM lineitem WHERE l_orderkey = 7")
def chunks_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.chunks_of(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line_start"), "l_partkey"), 7).drop("path")


@query(f"SELECT {_PATH_SQL} AS path FROM documents WHERE doc_id % 5 <> 2")
def evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(_t(spark, sf_dir, "documents")).select("doc_id", "path")
    return tables.evict(rows, rows.filter("doc_id % 5 = 2")).select("path")


@query("""
SELECT 's' || l_suppkey AS from_path, 'old' AS ref_name, count(*) AS n FROM lineitem WHERE l_suppkey % 4 > 0 GROUP BY 1
UNION ALL SELECT 's' || s_suppkey, 'new', 1 FROM supplier WHERE s_suppkey % 8 = 0""")
def edges_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _t(spark, sf_dir, "lineitem").select(_named("s", F.col("l_suppkey")).alias("from_path"), F.lit("old").alias("ref_name"))
    names = _t(spark, sf_dir, "supplier").select("s_suppkey", _named("s", F.col("s_suppkey")).alias("from_path"))
    new = names.filter("s_suppkey % 8 = 0").select("from_path", F.lit("new").alias("ref_name"))
    paths = names.filter("s_suppkey % 4 = 0").select(F.col("from_path").alias("path"))
    return tables.upsert_edges(stored, new, paths).groupBy("from_path", "ref_name").agg(F.count("*").alias("n"))


@query("""
WITH n AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN text || ' more more' ELSE text END AS t FROM documents WHERE doc_id % 9 <> 1),
w AS (SELECT doc_id, regexp_extract_all(lower(t), '[a-z0-9]+') AS ws FROM n), e AS (SELECT doc_id, len(ws) AS doc_len, unnest(ws) AS term FROM w)
SELECT doc_id AS id, count(DISTINCT term) AS terms, count(*) AS tokens, min(doc_len) AS doc_len, count(*) FILTER (term = 'more') AS more FROM e GROUP BY 1""")
def refreshed_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of changed and deleted documents are replaced, the others are kept."""
    docs = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("fts_text"))
    changed = docs.filter("id % 9 = 0").withColumn("fts_text", F.concat("fts_text", F.lit(" more more")))
    rows = tables.refresh_postings(tables.cut(tables.postings(docs)), changed, docs.filter("id % 9 = 1").select("id"))
    return rows.groupBy("id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"), F.min("doc_len").alias("doc_len"), F.sum(F.when(F.col("term") == "more", F.col("tf")).otherwise(0)).alias("more"))


@query("SELECT to_json({'k': n_nationkey, 'name': n_name}) AS json FROM nation")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.json_rows(_t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))


@query(f"""
WITH d AS (SELECT {_PATH_SQL} AS path, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id = 5)
SELECT path, 1 AS line_start, least(4, len(ls)) AS line_end, array_to_string(ls[1:least(4, len(ls))], chr(10)) AS text FROM d""")
def span_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(_t(spark, sf_dir, "documents")).select("doc_id", "path", F.col("text").alias("content"))
    named = rows.filter("doc_id = 5").select("path").first()
    return files.read_span(rows, named["path"] if named else "none", 2, 3, 1)


@query("""
SELECT count(DISTINCT source) AS files, count(*) AS chunks, (SELECT count(*) FROM lineitem) AS edges, CAST(floor((9000000 - max(n_chars)) / 60000) AS BIGINT) AS age_minutes FROM documents""")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _t(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("n_chars").alias("mtime_ms"))
    return plan.status(plan.Index(chunks, _t(spark, sf_dir, "lineitem"), chunks, chunks, {}, {}), 9_000_000)


@query(f"WITH {_SCAN_SQL} SELECT 2 * count(*) FILTER (path LIKE '%.md') >= count(*) AS notes_mode, count(*) FILTER (path LIKE '%.md') = count(*) AS prose_model FROM f")
def collection_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.detect_mode(_scan(spark, sf_dir))


# Notes, drift and history


@query(r"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$][A-Za-z0-9_$][A-Za-z0-9_$]+')) AS name FROM documents)
SELECT doc_id, count(DISTINCT name) AS names, count(*) AS mentions FROM m
WHERE name NOT IN ('this', 'true', 'false', 'null', 'function', 'return', 'const', 'async', 'await', 'import', 'export', 'class', 'interface', 'type', 'value', 'string', 'number', 'object') GROUP BY 1""")
def name_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crosslinks.mentions(_documents(spark, sf_dir).select(F.col("doc_id").alias("path"), "text"))
    return found.groupBy(F.col("note").alias("doc_id")).agg(F.count("*").alias("names"), F.sum("count").alias("mentions"))


@query("""
WITH l AS (SELECT DISTINCT 'n' || o_custkey AS note, CASE WHEN o_orderkey % 2 = 0 THEN 'symbol' ELSE 'file' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 'f' || (o_orderkey % 10) END AS symbol FROM orders WHERE o_orderkey % 30 < 10),
h AS (SELECT note, kind, symbol, row_number() OVER (PARTITION BY note ORDER BY CASE kind WHEN 'symbol' THEN 0 ELSE 1 END, symbol) AS n FROM l WHERE kind = 'file' OR symbol IN ('f2', 'f4'))
SELECT note, coalesce(symbol, 'p') AS via FROM h WHERE n = 1 ORDER BY CASE kind WHEN 'symbol' THEN 0 ELSE 1 END, note LIMIT 8""")
def notes_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight notes, those that name a symbol first: the cap is the feature."""
    key = F.col("o_orderkey")
    links = _t(spark, sf_dir, "orders").filter("o_orderkey % 30 < 10").select(_named("n", F.col("o_custkey")).alias("note"), F.when(key % 2 == 0, "symbol").otherwise("file").alias("kind"), F.when(key % 2 == 0, _named("f", key % 10)).alias("symbol"), F.lit("p").alias("path"), F.lit(1.0).alias("rank"))
    return crosslinks.reverse_links(links, "p", spark.createDataFrame([("f2",), ("f4",)], "symbol string"))


def _refs(spark: SparkSession, sf_dir: str, edited: bool) -> DataFrame:
    rows = _documents(spark, sf_dir)
    if edited:
        rows = rows.filter("doc_id % 7 <> 1").withColumn("text", F.expr("CASE WHEN doc_id % 7 = 2 THEN text || ' more' WHEN doc_id % 7 = 4 THEN 'new ' || text ELSE text END"))
    return crosslinks.snapshot(rows.select(F.col("source").alias("note"), F.lit("symbol").alias("kind"), _s("doc_id").alias("symbol"), F.lit("f").alias("path"), F.lit("1-1").alias("lines"), "text"))


@query("""
WITH x AS (SELECT source AS note, CASE doc_id % 7 WHEN 1 THEN 'high' WHEN 2 THEN 'medium' END AS severity FROM documents WHERE doc_id % 7 IN (1, 2))
SELECT note, severity, count(*) AS n FROM x WHERE note <> (SELECT min(source) FROM documents) GROUP BY 1, 2""")
def drift_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed texts and longer ones counted by note; one note is muted whole."""
    first = _t(spark, sf_dir, "documents").agg(F.min("source").alias("note")).withColumn("symbol", F.lit("*"))
    old = _refs(spark, sf_dir, False).withColumns({"sig": F.lit(""), "sig_hash": F.lit("")})
    rows = _documents(spark, sf_dir).filter("doc_id % 7 <> 1").withColumn("text", F.expr("CASE WHEN doc_id % 7 = 2 THEN 'x' || text ELSE text END"))
    now = crosslinks.snapshot(rows.select(F.col("source").alias("note"), F.lit("symbol").alias("kind"), _s("doc_id").alias("symbol"), F.lit("f").alias("path"), F.lit("1-1").alias("lines"), "text")).withColumns({"sig": F.lit(""), "sig_hash": F.lit("")})
    return crosslinks.drift_counts(crosslinks.drift(old, now, first))


@query("""
WITH x AS (SELECT source AS note, doc_id % 7 AS k FROM documents)
SELECT count(DISTINCT note) AS stale_notes, count(*) AS stale_links FROM x WHERE k IN (1, 2) AND note = (SELECT min(source) FROM documents)""")
def drift_report_of_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _refs(spark, sf_dir, False).withColumns({"sig": F.lit(""), "sig_hash": F.lit("")})
    rows = _documents(spark, sf_dir).filter("doc_id % 7 <> 1").withColumn("text", F.expr("CASE WHEN doc_id % 7 = 2 THEN 'x' || text ELSE text END"))
    now = crosslinks.snapshot(rows.select(F.col("source").alias("note"), F.lit("symbol").alias("kind"), _s("doc_id").alias("symbol"), F.lit("f").alias("path"), F.lit("1-1").alias("lines"), "text")).withColumns({"sig": F.lit(""), "sig_hash": F.lit("")})
    note = _t(spark, sf_dir, "documents").agg(F.min("source").alias("n")).first().n
    return crosslinks.report_for(crosslinks.drift(old, now), note)[1]


@query("""
SELECT source AS note, CAST(doc_id AS VARCHAR) AS symbol, CASE WHEN source = (SELECT min(source) FROM documents) AND doc_id % 7 = 2 THEN sha1(regexp_replace('x' || t, '[ \\t\\n\\r\\f\\v]+', '', 'g')) ELSE sha1(regexp_replace(t, '[ \\t\\n\\r\\f\\v]+', '', 'g')) END AS body_hash
FROM (SELECT doc_id, source, regexp_replace(text, '[#/*]', '', 'g') AS t FROM documents) WHERE source <> (SELECT min(source) FROM documents) OR doc_id % 7 <> 1""")
def acknowledged_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note's rows taken from the current state, the others kept; texts without comment marks."""
    plain = _documents(spark, sf_dir).withColumn("text", F.regexp_replace("text", "[#/*]", ""))
    shape = lambda rows: crosslinks.snapshot(rows.select(F.col("source").alias("note"), F.lit("symbol").alias("kind"), _s("doc_id").alias("symbol"), F.lit("f").alias("path"), F.lit("1-1").alias("lines"), "text"))
    now = shape(plain.filter("doc_id % 7 <> 1").withColumn("text", F.expr("CASE WHEN doc_id % 7 = 2 THEN 'x' || text ELSE text END")))
    note = _t(spark, sf_dir, "documents").agg(F.min("source").alias("n")).first().n
    return crosslinks.acknowledge(shape(plain), now, note or "").select("note", "symbol", "body_hash")


@query("""
WITH f AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS f FROM lineitem),
u AS (SELECT f.* FROM f JOIN (SELECT k FROM f GROUP BY k HAVING count(*) <= 25) g USING (k)),
p AS (SELECT a.f AS a, b.f AS b, count(*) AS c FROM u a JOIN u b ON a.k = b.k AND a.f < b.f GROUP BY 1, 2 HAVING count(*) >= 3),
e AS (SELECT DISTINCT least(s_suppkey, (s_suppkey + 1) % (SELECT count(*) FROM supplier)) AS a, greatest(s_suppkey, (s_suppkey + 1) % (SELECT count(*) FROM supplier)) AS b FROM supplier)
SELECT a, b, c AS count, (a, b) IN (SELECT (a, b) FROM e) AS call_edge FROM p""")
def cochange_with_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_suppkey").alias("file"))
    suppliers = _t(spark, sf_dir, "supplier")
    n = suppliers.count()
    return gitmetrics.cochange(items, suppliers.select(F.col("s_suppkey").alias("a"), ((F.col("s_suppkey") + 1) % n).alias("b"))).select("a", "b", "count", "call_edge")


@query(f"""WITH {_EDGES_SQL}, t AS (SELECT from_path AS s, unnest(CASE conf WHEN 'dispatch' THEN candidates ELSE [to_path] END) AS t FROM e WHERE kind = 'calls' AND conf IN ('resolved', 'inferred', 'dispatch'))
SELECT DISTINCT least(s, t) AS a, greatest(s, t) AS b FROM t WHERE t IS NOT NULL AND s <> t""")
def call_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gitmetrics.call_edge_pairs(_edges(spark, sf_dir))


# Evaluation, streams


@query("""
WITH p AS (SELECT n_nationkey AS k, n_regionkey / 10.0 AS threshold, n_nationkey / 100.0 AS margin, CASE WHEN n_nationkey % 4 = 0 THEN 1.0 ELSE 0.9 END AS precision, (n_nationkey % 7) / 10.0 AS recall FROM nation)
SELECT k FROM p ORDER BY (precision = 1) DESC, recall DESC, precision DESC, threshold, margin LIMIT 1""")
def operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    rows = _t(spark, sf_dir, "nation").select(key.alias("k"), (F.col("n_regionkey") / 10).alias("threshold"), (key / 100).alias("margin"), F.when(key % 4 == 0, 1.0).otherwise(0.9).alias("precision"), ((key % 7) / 10).alias("recall"))
    return evaluate.best_operating_point(rows).select("k")


@query("""
WITH g AS (SELECT 'p' || (o_orderkey % 40) || CASE o_orderkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '.go' END AS f, CASE o_orderkey % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'wrong' ELSE 'correct' END AS verdict FROM orders)
SELECT CASE WHEN grouping(e) = 1 THEN 'all' ELSE e END AS ext, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'wrong') AS wrong, count(*) FILTER (verdict = 'missing') AS missing,
  floor(avg(CASE WHEN verdict = 'correct' THEN 1.0::DOUBLE ELSE 0 END) * 10000.0 + 0.5) / 10000.0 AS recall FROM (SELECT split_part(f, '.', 2) AS e, verdict FROM g) GROUP BY ROLLUP (e)""")
def edge_recall_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    name = F.concat(_named("p", key % 40), F.when(key % 3 == 0, ".ts").when(key % 3 == 1, ".py").otherwise(".go"))
    return evaluate.edge_metrics(_t(spark, sf_dir, "orders").select(name.alias("from"), F.when(key % 4 == 0, "missing").when(key % 4 == 1, "wrong").otherwise("correct").alias("verdict")))


@query("""
WITH g AS (SELECT o_orderkey AS q, 'p' || (o_orderkey % 7) AS path, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 90 END AS a, CAST(o_orderkey % 3 AS VARCHAR) AS tier FROM orders),
r AS (SELECT l_orderkey AS q, l_linenumber AS rank, 'p' || (l_partkey % 7) AS path, l_partkey % 100 AS s, l_partkey % 100 + 40 AS e FROM lineitem),
h AS (SELECT g.q, tier, min(r.rank) FILTER (r.path = g.path) AS rank, min(r.rank) FILTER (r.path = g.path AND g.a <= e AND s <= g.a + 10) AS sec, bool_or(a IS NOT NULL) AS labelled FROM g LEFT JOIN r USING (q) GROUP BY 1, 2)
SELECT CASE WHEN grouping(tier) = 1 THEN 'all' ELSE tier END AS tier, count(*) AS n, floor(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) * 10000.0 + 0.5) / 10000.0 AS recall_5,
  floor(avg(CASE WHEN labelled THEN CASE WHEN sec <= 1 THEN 1.0::DOUBLE ELSE 0 END END) * 10000.0 + 0.5) / 10000.0 AS sec_hit_1,
  floor(avg(CASE WHEN labelled THEN CASE WHEN sec <= 5 THEN 1.0::DOUBLE ELSE 0 END END) * 10000.0 + 0.5) / 10000.0 AS sec_hit_5 FROM h GROUP BY ROLLUP (tier)""")
def section_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden lines against result lines: the first rank whose lines overlap."""
    key = F.col("o_orderkey")
    low = (key % 90).cast("int")
    golden = _t(spark, sf_dir, "orders").select(key.alias("query"), F.array(_named("p", key % 7)).alias("paths"), F.when(key % 2 == 0, F.array(low, low + 10)).alias("lines"), _s(key % 3).alias("tier"))
    start = F.col("l_partkey") % 100
    results = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("rank"), _named("p", F.col("l_partkey") % 7).alias("path"), F.concat(_s(start), F.lit("-"), _s(start + 40)).alias("lines"))
    return evaluate.retrieval_metrics(evaluate.golden_ranks(golden, results)).select("tier", "n", "recall_5", "sec_hit_1", "sec_hit_5")


@query("""
WITH t AS (SELECT doc_id % 50 AS query, CAST(ceil(length(text) / 4.0) AS BIGINT) AS n FROM documents)
SELECT CAST(query AS VARCHAR) || ' ring' AS query, sum(n)::BIGINT AS search_tokens FROM t GROUP BY 1""")
def tokens_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    hits = docs.select(F.concat(_s(F.col("doc_id") % 50), F.lit(" ring")).alias("query"), F.col("text").alias("snippet"))
    return evaluate.token_savings(docs.select(F.col("text").alias("content")), hits).select("query", "search_tokens")


@query("""
WITH e AS (SELECT user_id AS path, arg_max(event_type, (ts, event_type)) AS event FROM events GROUP BY 1) SELECT path, event FROM e""")
def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.last_events(_t(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "ts", F.col("event_type").alias("event")))


@query("""
WITH l AS (SELECT user_id AS holder, max(ts) AS last FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
SELECT holder, epoch_us(last) AS last, last >= now - INTERVAL '6 hours' AS alive FROM l, n""")
def live_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = _t(spark, sf_dir, "events").select(F.col("user_id").alias("holder"), "ts")
    now = beats.agg(F.max("ts").cast("string").alias("now")).first().now
    found = watch.live_holders(beats, now, "6 hours")
    return found.select("holder", F.unix_micros("last").alias("last"), "alive")


@query("""
WITH e AS (SELECT event_type AS k, epoch_us(ts) AS t, user_id FROM events), l AS (SELECT *, lag(t) OVER (PARTITION BY k ORDER BY t) AS b FROM e),
s AS (SELECT *, sum(CASE WHEN b IS NULL OR t - b >= 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY t) AS g FROM l)
SELECT k AS event_type, min(t) AS start, max(t) + 600000000 AS "end", count(*) AS n, count(DISTINCT user_id) AS paths FROM s GROUP BY k, g""")
def change_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("ts", F.col("user_id").alias("path"), "event_type")
    found = watch.change_batches(rows, "10 minutes", key="event_type")
    return found.select("event_type", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n", F.size("paths").cast("long").alias("paths"))


@query("""
SELECT o_orderkey, a <= 30 AND 20 <= b AS hit FROM (SELECT o_orderkey, o_custkey % 50 AS a, o_custkey % 50 + o_orderkey % 10 AS b FROM orders)""")
def line_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("o_custkey") % 50
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat(_s(low), F.lit("-"), _s(low + F.col("o_orderkey") % 10)).alias("lines"))
    a, b = text.parse_lines("lines")
    return rows.select("o_orderkey", text.overlaps(a, b, F.lit(20), F.lit(30)).alias("hit"))


@query("""
WITH r AS (SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_suppkey, l_linenumber) AS n FROM lineitem)
SELECT l_orderkey, l_partkey, l_quantity FROM r WHERE n = 1""")
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.first_by(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], F.desc("l_quantity"), "l_partkey", "l_suppkey", "l_linenumber").select("l_orderkey", "l_partkey", "l_quantity")


@query()
def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default embedder; its hash has no SQL."""
    return _documents(spark, sf_dir).select("doc_id", text.floor_to(norm(hash_embedding(F.substring("text", 1, 6000), 16)), 4).alias("norm"))



# The tiers and tallies that have a literal query as well, over tables


_TIERS_SQL = """
c AS (SELECT o_orderkey AS call_id, 'p' || (o_custkey % 40) || '.ts' AS from_path, 'g' || (o_orderkey % 60) AS ref_name, CASE WHEN o_orderkey % 11 = 0 THEN 'g' || (o_orderkey % 60) END AS local_target FROM orders),
d AS (SELECT DISTINCT 'g' || (p_partkey % 45) AS name, 'p' || p_size || '.ts' AS path, lpad(CAST(p_partkey // 10 AS VARCHAR), 6, '0') AS lines FROM part WHERE p_partkey % 45 < 40 OR p_partkey < 45),
i AS (SELECT 'p' || (c_custkey % 40) || '.ts' AS from_path, 'g' || (c_custkey % 60) AS ref_name, min('p' || (c_custkey % 50)) AS stem FROM customer GROUP BY 1, 2),
s AS (SELECT name, list_sort(list({'path': path, 'lines': lines})) AS sites FROM d GROUP BY 1),
r AS (SELECT c.*, coalesce(sites, []) AS sites, list_filter(sites, lambda x: x.path = stem || '.ts')[1] AS vouched, list_filter(sites, lambda x: x.path = c.from_path)[1] AS own FROM c LEFT JOIN s ON name = c.ref_name LEFT JOIN i ON i.from_path = c.from_path AND i.ref_name = c.ref_name),
t AS (SELECT *, CASE WHEN local_target IS NOT NULL THEN 'resolved' WHEN len(sites) = 0 THEN 'external' WHEN vouched IS NOT NULL THEN 'resolved' WHEN len(sites) = 1 AND sites[1].path = from_path THEN 'resolved' ELSE 'ambiguous' END AS conf FROM r)"""


@query(f"""WITH {_TIERS_SQL}
SELECT call_id, conf, CASE WHEN local_target IS NOT NULL THEN coalesce(own.path, from_path) WHEN conf = 'resolved' THEN coalesce(vouched.path, sites[1].path) END AS to_path,
  CASE WHEN local_target IS NOT NULL THEN own.lines WHEN conf = 'resolved' THEN coalesce(vouched.lines, sites[1].lines) END AS to_lines,
  CASE WHEN conf = 'resolved' THEN ref_name END AS to_symbol, CASE WHEN conf = 'ambiguous' THEN array_to_string(list_sort(list_distinct(list_transform(sites, lambda x: x.path))), ',') ELSE '' END AS candidates FROM t""")
def call_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local targets, imports that vouch, single and several candidates, and none."""
    key = F.col("o_orderkey")
    name = _named("g", key % 60)
    calls = _t(spark, sf_dir, "orders").select(key.alias("call_id"), F.concat(_named("p", F.col("o_custkey") % 40), F.lit(".ts")).alias("from_path"), name.alias("ref_name"), F.when(key % 11 == 0, name).alias("local_target"))
    part = F.col("p_partkey")
    defs = _t(spark, sf_dir, "part").filter((part % 45 < 40) | (part < 45)).select(_named("g", part % 45).alias("name"), F.concat(_named("p", F.col("p_size")), F.lit(".ts")).alias("path"), F.lpad(F.floor(part / 10).cast("string"), 6, "0").alias("lines"))
    customer = F.col("c_custkey")
    imports = _t(spark, sf_dir, "customer").select(F.concat(_named("p", customer % 40), F.lit(".ts")).alias("from_path"), _named("g", customer % 60).alias("name"), _named("p", customer % 50).alias("stem"))
    done = resolve.resolve_calls(calls, defs, imports)
    return done.select("call_id", "conf", "to_path", "to_lines", "to_symbol", F.array_join(F.array_sort("candidates"), ",").alias("candidates"))


@query("""
WITH n AS (SELECT 'd' || p_partkey || '/N' || (p_partkey % 150) || '.md' AS path, 'n' || (p_partkey % 150) AS key, p_size, p_partkey FROM part),
l AS (SELECT 'links' AS kind, path AS from_path, 1 AS line, 'N' || (p_size * 4) AS target FROM n UNION ALL SELECT 'embeds', path, 5, 'n' || (p_partkey % 7 + 145) FROM n),
k AS (SELECT key, list_sort(list(path)) AS paths FROM n GROUP BY 1)
SELECT kind, from_path, line, target, CASE WHEN paths IS NULL THEN 'external' WHEN len(paths) = 1 THEN 'resolved' ELSE 'ambiguous' END AS conf, CASE WHEN len(paths) = 1 THEN paths[1] END AS to_path,
  CASE WHEN len(paths) > 1 THEN array_to_string(paths, ',') ELSE '' END AS candidates FROM l LEFT JOIN k ON key = lower(target)""")
def note_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and embeds outside fences, resolved by note key."""
    from strandline.operators import extract

    key, size = F.col("p_partkey"), F.col("p_size")
    content = F.concat(F.lit("see [["), _named("N", size * 4), F.lit("#part|shown]]\n```\n[[Nope]]\n```\n![["), _named("n", key % 7 + 145), F.lit("]]"))
    notes = _t(spark, sf_dir, "part").select(F.concat(_named("d", key), F.lit("/"), _named("N", key % 150), F.lit(".md")).alias("path"), content.alias("content"))
    done = resolve.resolve_wikilinks(extract.wikilinks(notes), notes.select("path"), joined=",")
    return done.select("kind", "from_path", "line", "target", "conf", "to_path", "candidates")


@query("""
WITH f AS (SELECT 'C' || (p_size % 30) AS class, 'r' || (p_partkey % 15) AS field, min(CASE WHEN p_partkey % 2 = 0 THEN '*' ELSE '' END || p_type) AS type FROM part GROUP BY 1, 2),
a AS (SELECT 'C' || n_nationkey AS name, 'C' || n_regionkey AS base FROM nation WHERE n_nationkey <> n_regionkey),
c AS (SELECT o_orderkey AS call_id, 'C' || (o_custkey % 40) AS cls, 'r' || (o_orderkey % 20) AS receiver, CASE WHEN o_orderkey % 3 = 0 THEN '.' ELSE '->' END AS op, CASE WHEN o_orderkey % 9 = 0 THEN 'Known' END AS known FROM orders),
x AS (SELECT call_id, known, op, coalesce(own.type, far.type) AS type FROM c LEFT JOIN f own ON own.class = cls AND own.field = receiver LEFT JOIN a ON a.name = cls LEFT JOIN f far ON far.class = a.base AND far.field = receiver)
SELECT call_id, coalesce(known, CASE WHEN NOT starts_with(type, '*') THEN type WHEN op = '->' THEN substr(type, 2) END) AS receiver_type FROM x""")
def receivers_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class's own field, else its base's; a wrapped type by the arrow only."""
    part, order = F.col("p_partkey"), F.col("o_orderkey")
    marked = F.concat(F.when(part % 2 == 0, "*").otherwise(""), "p_type")
    fields = _t(spark, sf_dir, "part").groupBy(_named("C", F.col("p_size") % 30).alias("class"), _named("r", part % 15).alias("field")).agg(F.min(marked).alias("type"))
    fields = fields.withColumn("wrapped", F.col("type").startswith("*")).withColumn("type", F.ltrim("type", F.lit("*")))
    heirs = _t(spark, sf_dir, "nation").filter("n_nationkey <> n_regionkey").select(_named("C", F.col("n_nationkey")).alias("name"), _named("C", F.col("n_regionkey")).alias("base"), F.lit(1).alias("depth"))
    calls = _t(spark, sf_dir, "orders").select(order.alias("call_id"), _named("C", F.col("o_custkey") % 40).alias("enclosing_class"), _named("r", order % 20).alias("receiver"), F.when(order % 3 == 0, ".").otherwise("->").alias("member_op"), F.when(order % 9 == 0, "Known").alias("receiver_type"))
    return resolve.field_receivers(calls, fields, heirs).select("call_id", "receiver_type")


@query("""
WITH RECURSIVE b AS (SELECT 'K' || p_partkey AS name, 'K' || (p_partkey // 3) AS base FROM part WHERE p_partkey > 0),
w AS (SELECT name, base, 1 AS depth FROM b UNION SELECT w.name, b.base, w.depth + 1 FROM w JOIN b ON b.name = w.base)
SELECT name, base, min(depth) AS depth FROM w WHERE name <> base GROUP BY 1, 2""")
def class_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return graph.transitive_bases(_t(spark, sf_dir, "part").filter("p_partkey > 0").select(_named("K", key).alias("name"), _named("K", F.floor(key / 3)).alias("base")))


@query(f"""WITH {_EDGES_SQL},
changed AS (SELECT 's' || s_suppkey AS path, 'g' || (s_suppkey % 11) AS name FROM supplier WHERE s_suppkey % 23 = 0), gone AS (SELECT 's' || s_suppkey AS path FROM supplier WHERE s_suppkey % 23 = 1),
touched AS (SELECT path FROM changed UNION SELECT path FROM gone), live AS (SELECT * FROM e WHERE kind <> 'imports' AND from_path <> 's5')
SELECT DISTINCT path FROM (SELECT from_path AS path FROM live WHERE to_path IN (SELECT path FROM touched) OR list_has_any(candidates, (SELECT list(path) FROM touched)) OR ref_name IN (SELECT name FROM changed) UNION SELECT path FROM changed)
WHERE path NOT IN (SELECT path FROM gone)""")
def dependents_of_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    names = _t(spark, sf_dir, "supplier").select(key.alias("k"), _named("s", key).alias("path"), _named("g", key % 11).alias("name"))
    edges = _edges(spark, sf_dir).filter("from_path <> 's5'")
    return tables.reextract_paths(edges, names.filter("k % 23 = 0").select("path"), names.filter("k % 23 = 1").select("path"), names.select("path", "name"))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS hash, unnest(['a' || (o_custkey % 9) || '.py', 'dir/b' || (o_orderkey % 5) || '.py']) AS file FROM orders""")
def commits_of_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    log = F.concat(F.lit("\x01"), _s(key), F.lit("\na"), _s(F.col("o_custkey") % 9), F.lit(".py \r\ndir/b"), _s(key % 5), F.lit(".py\n\n"))
    return files.parse_git_log(_t(spark, sf_dir, "orders").select(log.alias("log"))).select("hash", F.explode("files").alias("file"))


@query("""
WITH p AS (SELECT p_partkey, p_size, CASE p_partkey % 7 WHEN 0 THEN 'Tests/' WHEN 1 THEN 'src/latest/' WHEN 2 THEN 'e2e/' ELSE 'src/' END || CASE p_size % 6 WHEN 0 THEN 'test_' WHEN 1 THEN 'my' ELSE 'a' END || p_partkey ||
  CASE p_size % 5 WHEN 0 THEN '.test.ts' WHEN 1 THEN '_spec.rb' WHEN 2 THEN '.py' WHEN 3 THEN 'test.go' ELSE '-test.c' END AS path FROM part)
SELECT p_partkey, p_partkey % 7 IN (0, 2) OR p_size % 5 IN (0, 1, 4) OR (p_size % 6 = 0 AND p_size % 5 = 2) AS is_test FROM p""")
def test_path_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    folder = F.when(key % 7 == 0, "Tests/").when(key % 7 == 1, "src/latest/").when(key % 7 == 2, "e2e/").otherwise("src/")
    stem = F.when(size % 6 == 0, "test_").when(size % 6 == 1, "my").otherwise("a")
    ending = F.when(size % 5 == 0, ".test.ts").when(size % 5 == 1, "_spec.rb").when(size % 5 == 2, ".py").when(size % 5 == 3, "test.go").otherwise("-test.c")
    return _t(spark, sf_dir, "part").select("p_partkey", predicates.is_test_path(F.concat(folder, stem, _s("p_partkey"), ending)).alias("is_test"))


@query("""
WITH x AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'bin/x.js' WHEN 1 THEN 'src/index.ts' WHEN 2 THEN 'a.go' WHEN 3 THEN 'tests/a.js' ELSE 'src/a.js' END AS path,
  CASE p_size % 6 WHEN 0 THEN 'handler' WHEN 1 THEN 'onClick' WHEN 2 THEN 'Public' WHEN 3 THEN 'once' ELSE 'work' END AS name, p_partkey % 5 AS t FROM part)
SELECT p_partkey, CASE WHEN path = 'tests/a.js' THEN 'test path' WHEN path IN ('bin/x.js', 'src/index.ts') THEN 'entry file' WHEN name IN ('handler', 'onClick') THEN 'entry/handler name'
  WHEN t = 0 OR (t = 1 AND name = 'work') OR t = 2 OR (t = 3 AND name = 'Public') THEN 'exported' WHEN path = 'a.go' AND name = 'Public' THEN 'go exported' END AS reason FROM x""")
def entrypoint_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    path = F.when(key % 8 == 0, "bin/x.js").when(key % 8 == 1, "src/index.ts").when(key % 8 == 2, "a.go").when(key % 8 == 3, "tests/a.js").otherwise("src/a.js")
    name = F.when(size % 6 == 0, "handler").when(size % 6 == 1, "onClick").when(size % 6 == 2, "Public").when(size % 6 == 3, "once").otherwise("work")
    body = F.when(key % 5 == 0, "module.exports = {}").when(key % 5 == 1, "export async function work(a) {").when(key % 5 == 2, "x\nexport\n default y").when(key % 5 == 3, "pub struct Public;").otherwise("exporting work;\nfn Public")
    return _t(spark, sf_dir, "part").select("p_partkey", predicates.entrypoint_reason(path, name, body).alias("reason"))


@query(r"""
SELECT conv_id, turn, CASE WHEN regexp_matches(trim(text, (E' \n\t\r\f' || chr(11))), '^[A-Za-z_$][A-Za-z0-9_$]*$') THEN 'symbol'
  WHEN len(list_filter(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$.]*'), lambda t: regexp_matches(t, '[a-z][A-Z]|[A-Z][A-Z][a-z]|[A-Za-z]_[A-Za-z0-9]|[A-Za-z][0-9]|[0-9][A-Za-z]|[A-Za-z0-9_][.][A-Za-z0-9_]'))) > 0 THEN 'mixed' ELSE 'plain' END AS kind
FROM conversations""")
def kinds_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.query_kind(_t(spark, sf_dir, "conversations"), "text").select("conv_id", "turn", "kind")


@query("""
WITH g AS (SELECT DISTINCT 's' || (o_orderkey % 60) AS "from", 'g' || (o_custkey % 13) AS symbol, CASE WHEN o_orderkey % 4 > 0 THEN 's' || (o_custkey % 50) END AS "to" FROM orders),
m AS (SELECT 's' || l_suppkey AS "from", 'g' || (l_orderkey % 11) AS symbol, CASE WHEN l_orderkey % 5 > 0 THEN 's' || (l_orderkey % 50) END AS t, CASE WHEN l_returnflag = 'A' THEN 'dispatch' ELSE 'resolved' END AS conf, 's' || (l_partkey % 50) AS c FROM lineitem),
x AS (SELECT g.*, m.conf IS NOT NULL AS seen, CASE WHEN "to" IS NULL THEN t IS NULL ELSE coalesce(t = "to", false) OR (conf = 'dispatch' AND c = "to") END AS hit FROM g LEFT JOIN m USING ("from", symbol))
SELECT "from", symbol, "to", CASE WHEN bool_or(seen AND hit) THEN 'correct' WHEN bool_or(seen) THEN 'wrong' ELSE 'missing' END AS verdict FROM x GROUP BY 1, 2, 3""")
def golden_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    golden = _t(spark, sf_dir, "orders").select(_named("s", order % 60).alias("from"), _named("g", customer % 13).alias("symbol"), F.lit("calls").alias("kind"), F.when(order % 4 > 0, _named("s", customer % 50)).alias("to")).distinct()
    made = _t(spark, sf_dir, "lineitem").select(_named("s", F.col("l_suppkey")).alias("from_path"), _named("g", F.col("l_orderkey") % 11).alias("ref_name"), F.lit("calls").alias("kind"), F.when(F.col("l_orderkey") % 5 > 0, _named("s", F.col("l_orderkey") % 50)).alias("to_path"), F.when(F.col("l_returnflag") == "A", "dispatch").otherwise("resolved").alias("conf"), F.array(_named("s", F.col("l_partkey") % 50)).alias("candidates"))
    return evaluate.edge_tally(golden, made).drop("kind")


@query("""
WITH g AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 5 END AS e, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 5 END AS t FROM orders),
c AS (SELECT count(*) FILTER (e IS NOT NULL AND t = e) AS tp, count(*) FILTER (t IS NOT NULL AND (e IS NULL OR t <> e)) AS fp, count(*) FILTER (e IS NOT NULL AND t IS NULL) AS fn, count(*) FILTER (e IS NULL AND t IS NULL) AS tn FROM g)
SELECT tp, fp, fn, tn, floor(tp / (tp + fp) * 10000.0 + 0.5) / 10000.0 AS precision, floor(tp / (tp + fn) * 10000.0 + 0.5) / 10000.0 AS recall, floor(tn / (tn + fp) * 10000.0 + 0.5) / 10000.0 AS abstain FROM c""")
def disambiguation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = _t(spark, sf_dir, "orders").select(_s(key).alias("from_path"), F.lit("f").alias("symbol"), F.when(key % 3 > 0, _s(F.col("o_custkey") % 5)).alias("expect"), F.when(key % 4 > 0, _s(key % 5)).alias("to_path"))
    return evaluate.disambiguation_metrics(rows.select("from_path", "symbol", "expect"), rows.filter("to_path IS NOT NULL").select("from_path", "symbol", "to_path"))


@query("""
WITH g AS (SELECT CASE p_size % 2 WHEN 0 THEN 'likely_dead' ELSE 'possible_entrypoint' END AS e, CASE WHEN p_partkey % 5 = 0 THEN 'reached' WHEN p_partkey % 3 = 0 THEN 'likely_dead' ELSE 'possible_entrypoint' END AS c FROM part)
SELECT count(*) FILTER (e = c) AS correct, count(*) FILTER (c = 'likely_dead' AND e <> c) AS false_dead, count(*) FILTER (c = 'possible_entrypoint' AND e <> c) AS false_entrypoint, count(*) FILTER (c = 'reached') AS missing,
  floor(count(*) FILTER (e = c) / count(*) * 10000.0 + 0.5) / 10000.0 AS accuracy FROM g""")
def orphan_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    rows = _t(spark, sf_dir, "part").select(_s(key).alias("path"), F.col("p_name").alias("symbol"), F.when(F.col("p_size") % 2 == 0, "likely_dead").otherwise("possible_entrypoint").alias("expect"), key.alias("k"))
    found = rows.filter("k % 5 <> 0").select("path", F.col("symbol").alias("name"), F.when(F.col("k") % 3 == 0, "likely_dead").otherwise("possible_entrypoint").alias("class"))
    return evaluate.orphan_metrics(rows.select("path", "symbol", "expect"), found)


@query("""
WITH m AS (SELECT p_type AS tier, floor(avg(p_size) * 100 + 0.5) / 10000 AS now, floor(avg(p_partkey % 50) * 100 + 0.5) / 10000 AS was FROM part GROUP BY 1)
SELECT tier, 'recall_1' AS metric, was, now, was - now > 0.02 + 1e-9 AS regressed FROM m""")
def gate_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    shape = lambda c: part.groupBy(F.col("p_type").alias("tier")).agg((F.floor(F.avg(c) * 100 + 0.5) / 10000).alias("recall_1"))
    tiers = tuple(r.p_type for r in part.select("p_type").distinct().collect())  # a handful of types
    return evaluate.compare_baseline(shape(F.col("p_size")), shape(F.col("p_partkey") % 50), 0.02, tiers)


@query("""
WITH h AS (SELECT n_nationkey + 1 AS rank, n_name AS id FROM nation), v AS (SELECT r_regionkey * 6 AS i, r_regionkey * 6 + 1 AS rank, 4 - r_regionkey AS place FROM region),
j AS (SELECT h.id, h.rank, place FROM h LEFT JOIN v USING (rank))
SELECT place_now AS rank, id FROM (SELECT row_number() OVER (ORDER BY place NULLS LAST, rank) AS place_now, id FROM j) WHERE place_now <= 20""")
def reranked_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list reordered by a ranking of some of its places, an unknown place and a repeated one among them."""
    hits = _t(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("rank"), F.col("n_name").alias("id"))
    key = F.col("r_regionkey")
    ranking = _t(spark, sf_dir, "region").select((4 - key).alias("place"), (key * 6).alias("index"), (key / 10).alias("score"))
    extra = spark.createDataFrame([(7, 0, 0.1), (8, 900, 0.2)], "place int, index int, score double")
    return search.apply_rerank(hits, ranking.unionByName(extra), 20).select("rank", "id")


@query("""
WITH h AS (SELECT o_custkey AS q, o_orderkey AS id, floor(o_totalprice / 100000) AS score, o_orderkey % 12 AS degree FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM h)
SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, CASE WHEN degree > 0 THEN 1 + 0.15 * degree / (degree + 8.0) ELSE 1.0 END DESC, rank) AS rank FROM r""")
def centrality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of each customer's orders, reordered by degree inside bands of equal scores."""
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 100000).cast("double").alias("score"), (F.col("o_orderkey") % 12).alias("degree"))
    hits = search.ranked(rows, "score", "rank", 1 << 30, ["q"])
    return search.centrality_tiebreak(hits, ["q"]).select("q", "id", "rank")


@query("""
WITH n AS (SELECT 'n' || s_suppkey AS note, s_suppkey AS k FROM supplier),
i AS (SELECT p_partkey, 'fnName' || (p_partkey % 40) AS name, 'src/lib/m' || p_size || '.ts' AS path, p_partkey AS a FROM part),
s AS (SELECT note, 'symbol' AS kind, name AS symbol, path, min(a) AS a, 2 + length(name) / 100.0 AS rank FROM n JOIN i ON name = 'fnName' || (k % 40) GROUP BY ALL),
f AS (SELECT note, 'file' AS kind, NULL AS symbol, 'pkg/src/lib/m' || (k % 50 + 1) || '.ts' AS path, 0.5 AS rank FROM n),
u AS (SELECT note, kind, symbol, path, CAST(rank AS DOUBLE) AS rank FROM s UNION ALL SELECT * FROM f)
SELECT note, kind, symbol, path, rank FROM u QUALIFY row_number() OVER (PARTITION BY note ORDER BY rank DESC, path, symbol) <= 15""")
def links_of_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen best code sites of each note: mentioned names, and mentioned paths by their suffix."""
    key = F.col("s_suppkey")
    name = _named("fnName", key % 40)
    body = F.concat(name, F.lit(" is like "), name, F.lit(", see src/lib/m"), _s(key % 50 + 1), F.lit(".ts here"))
    notes = _t(spark, sf_dir, "supplier").select(_named("n", key).alias("path"), body.alias("text"))
    part = _t(spark, sf_dir, "part")
    inventory = part.select(_named("fnName", F.col("p_partkey") % 40).alias("name"), F.concat(F.lit("src/lib/m"), _s("p_size"), F.lit(".ts")).alias("path"), F.col("p_partkey").alias("line_start"), F.col("p_partkey").alias("line_end"), F.col("p_type").alias("text"))
    listing = spark.range(1, 51).select(F.concat(F.lit("pkg/src/lib/m"), _s("id"), F.lit(".ts")).alias("path"), F.lit("x").alias("text"))
    return crosslinks.code_links(notes, inventory, listing).select("note", "kind", "symbol", "path", "rank")


@query("""
WITH s AS (SELECT 'n' || p_partkey AS path, p_size / 50.0 AS v, row_number() OVER (ORDER BY p_size / 50.0 DESC, 'n' || p_partkey) AS sr FROM part WHERE p_partkey % 2 = 0),
l AS (SELECT 'n' || p_partkey AS path, row_number() OVER (ORDER BY p_retailprice DESC, 'n' || p_partkey) AS lr FROM part WHERE p_partkey % 3 = 0),
x AS (SELECT 'n' || p_partkey AS path, CASE p_size % 3 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.0 END AS prox FROM part WHERE p_partkey % 5 = 0),
r AS (SELECT coalesce(s.path, l.path) AS path, (coalesce(1.0::DOUBLE / (60 + sr), 0) + coalesce(1.0::DOUBLE / (60 + lr), 0)) * (1 + 0.25 * coalesce(prox, 0)) AS raw FROM s FULL JOIN l ON s.path = l.path LEFT JOIN x ON x.path = coalesce(s.path, l.path))
SELECT path, floor(raw * 10000.0 + 0.5) / 10000.0 AS score FROM r ORDER BY raw DESC, path LIMIT 12""")
def related_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve notes next to one by fused ranks and link proximity."""
    part = _t(spark, sf_dir, "part").withColumn("path", _named("n", F.col("p_partkey")))
    near = F.when(F.col("p_size") % 3 == 1, 1.0).when(F.col("p_size") % 3 == 2, 0.5).otherwise(0.0)
    semantic = part.filter("p_partkey % 2 = 0").select("path", (F.col("p_size") / 50).alias("similarity"))
    lexical = part.filter("p_partkey % 3 = 0").select("path", F.col("p_retailprice").alias("bm25"))
    proximity = part.filter("p_partkey % 5 = 0").select("path", F.lit(1).alias("hop"), F.lit(0).alias("cocited"), near.alias("proximity"))
    return crosslinks.connections(semantic, lexical, proximity).select("path", "score")


@query("""
WITH p AS (SELECT 'src/n' || (p_partkey % 150) AS stem, 'src/n' || (p_partkey % 150) || CASE p_size % 2 WHEN 0 THEN '.ts' ELSE '.py' END AS path FROM part WHERE p_partkey < 200),
u AS (SELECT stem, min(path) AS file FROM p GROUP BY 1 HAVING count(*) = 1)
SELECT 'o' || o_orderkey AS src, coalesce(file, 'src/n' || (o_orderkey % 180)) AS dst FROM orders LEFT JOIN u ON stem = 'src/n' || (o_orderkey % 180)""")
def import_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    paths = _t(spark, sf_dir, "part").filter("p_partkey < 200").select(F.concat(_named("src/n", key % 150), F.when(F.col("p_size") % 2 == 0, ".ts").otherwise(".py")).alias("path"))
    links = _t(spark, sf_dir, "orders").select(_named("o", F.col("o_orderkey")).alias("src"), _named("src/n", F.col("o_orderkey") % 180).alias("dst"), F.lit("imports").alias("kind"), F.lit("resolved").alias("conf"))
    return graph.resolve_stems(links, paths).select("src", "dst")


# Extraction from source text: parts as files


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, content, k): a Python, Go, TypeScript or C++ file for each part."""
    key, size = F.col("p_partkey"), _s("p_size")
    python = F.concat(F.lit("from .m"), size, F.lit(" import helper\n\nclass K:\n    def run(self):\n        return self.go(helper("), size, F.lit("))\n"))
    go = F.concat(F.lit("package a\n\nfunc (f *File"), size, F.lit(") Read(p int) int {\n\treturn f.inner(p)\n}\n\nfunc use(r Reader"), size, F.lit(") {\n\tr.Read(1)\n\tx := New"), size, F.lit("(2)\n\tx.Close()\n}\n"))
    script = F.concat(F.lit("import { a } from './m"), size, F.lit("';\nconst api = { run() { return 1; } };\nclass C"), size, F.lit(" implements Shape {\n  area() { return this.side(2); }\n}\nfunction main(s: Shape) {\n  s.area(); api.run(); new C"), size, F.lit("();\n}\n"))
    cpp = F.concat(F.lit("class Kid"), size, F.lit(" : public Base {\n  std::unique_ptr<Engine> engine_;\n  void run() override { engine_->start(1); }\n  virtual void stop();\n};\nEngine* make"), size, F.lit("(int a) { return build(a); }\n"))
    kind = key % 4
    language = F.when(kind == 0, "python").when(kind == 1, "go").when(kind == 2, "typescript").otherwise("cpp")
    content = F.when(kind == 0, python).when(kind == 1, go).when(kind == 2, script).otherwise(cpp)
    return _t(spark, sf_dir, "part").select(_s(key).alias("path"), language.alias("language"), content.alias("content"))


_EXTRACTED = {
    0: [("imports", "helper", None, None, None, "./m{n}", 1), ("calls", "go", "run", "self", "K", None, 5), ("calls", "helper", "run", None, None, None, 5)],
    1: [("calls", "inner", "Read", "f", "File{n}", None, 4), ("calls", "Read", "use", "r", "Reader{n}", None, 8), ("calls", "New{n}", "use", None, None, None, 9), ("calls", "Close", "use", "x", None, None, 10)],
    2: [("imports", "a", None, None, None, "./m{n}", 1), ("calls", "side", "area", "this", "C{n}", None, 4), ("calls", "area", "main", "s", "Shape", None, 7), ("calls", "run", "main", "api", None, None, 7)],
    3: [("calls", "start", "run", "engine_", None, None, 3), ("calls", "build", "make{n}", None, None, None, 6)],
}


def _literal(value: object) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else str(value) if isinstance(value, int) else "'" + str(value).replace("{n}", "' || p_size || '") + "'"


@query(" UNION ALL ".join(
    f"SELECT CAST(p_partkey AS VARCHAR) AS path, {_literal(kind)} AS kind, {_literal(name)} AS ref_name, {_literal(inside)} AS from_symbol, {_literal(owner)} AS receiver, {_literal(of)} AS receiver_type, {_literal(spec)} AS spec, {line} AS line FROM part WHERE p_partkey % 4 = {k}"
    for k, rows in _EXTRACTED.items() for kind, name, inside, owner, of, spec, line in rows))
def extracted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and imports of files in four languages, with the types of their receivers."""
    from strandline.operators import extract

    found = extract.extract_edges(_sources(spark, sf_dir))
    return found.select(F.col("from_path").alias("path"), "kind", "ref_name", "from_symbol", "receiver", "receiver_type", "spec", "line")


_FACTS = {
    1: [("method", "File{n}", "Read", None)],
    2: [("class", "C{n}", "C{n}", None), ("base", "C{n}", "Shape", None), ("method", "C{n}", "area", None), ("callable", None, "area", None), ("callable", None, "main", None), ("callable", None, "run", None)],
    3: [("class", "Kid{n}", "Kid{n}", None), ("base", "Kid{n}", "Base", None), ("field", "Kid{n}", "engine_", "Engine"), ("override", "Kid{n}", "run", None), ("virtual", "Kid{n}", "stop", None), ("method", "Kid{n}", "run", None), ("callable", None, "run", None), ("callable", None, "make{n}", None), ("returns", None, "make{n}", "Engine")],
}


@query(" UNION ALL ".join(
    f"SELECT CAST(p_partkey AS VARCHAR) AS path, {_literal(fact)} AS fact, {_literal(owner)} AS owner, {_literal(name)} AS name, {_literal(detail)} AS detail FROM part WHERE p_partkey % 4 = {k}"
    for k, rows in _FACTS.items() for fact, owner, name, detail in rows))
def extracted_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, bases, methods, fields, virtuals, overrides and returns of those files."""
    from strandline.operators import extract

    return extract.extract_types(_sources(spark, sf_dir)).select("path", "fact", "owner", "name", "detail")


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS path, CASE p_partkey % 4 WHEN 0 THEN 'K' WHEN 1 THEN 'Read,use' WHEN 2 THEN 'C' || p_size || ',main' ELSE 'Kid' || p_size || ',make' || p_size END AS names FROM part""")
def inventory_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of each file from the spans of its chunks."""
    from strandline.operators import extract

    found = extract.inventory(chunking.chunk_files(_sources(spark, sf_dir)))
    return found.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


@query("""
WITH n AS (SELECT p_partkey, p_size AS lines FROM part),
w AS (SELECT p_partkey, lines, unnest(range(0, CAST(greatest(0, ceil((lines - 20) / 16.0)) AS BIGINT) + 1)) AS k FROM n),
f AS (SELECT p_partkey, lines, k * 16 + 1 AS first, least(lines, k * 16 + 20) AS last FROM w),
e AS (SELECT p_partkey, lines, arg_max(last - first + 1, first) AS held FROM f GROUP BY 1, 2),
t AS (SELECT p_partkey, lines - least(4, held - 1) + 1 AS first, lines AS last FROM e WHERE least(4, held - 1) >= 2)
SELECT p_partkey, first, last, count(*) AS n FROM (SELECT p_partkey, first, last FROM f WHERE last > first UNION ALL SELECT * FROM t) GROUP BY ALL""")
def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line windows of files whose lines have a hundred characters: twenty a window, four carried over, the last carry by itself."""
    content = F.repeat(F.concat(F.lit("x" * 99), F.lit("\n")), F.col("p_size"))
    rows = _t(spark, sf_dir, "part").select(_s("p_partkey").alias("path"), F.lit("toml").alias("language"), content.alias("content"))
    found = chunking.chunk_files(rows)
    return found.groupBy(F.col("path").cast("long").alias("p_partkey"), F.col("line_start").alias("first"), F.col("line_end").alias("last")).agg(F.count("*").alias("n"))


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS path, p_name || ' > One' AS scope FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name || ' > One > Two' FROM part""")
def titled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The front matter's title opens the trail; fenced marks are no headings."""
    content = F.concat(F.lit("---\ntitle: "), "p_name", F.lit("\ntags: [a, b]\n---\n# One\ntext\n```\n# no heading\n```\n## Two\nmore\n# Three\n"))
    rows = _t(spark, sf_dir, "part").select(_s("p_partkey").alias("path"), F.lit("markdown").alias("language"), content.alias("content"))
    return chunking.chunk_files(rows).select("path", F.array_join("scope", " > ").alias("scope"))


@query("""
WITH x AS (SELECT p_partkey, p_partkey % 5 AS k FROM part)
SELECT CASE k WHEN 0 THEN 'python' WHEN 1 THEN 'markdown' WHEN 2 THEN 'toml' WHEN 3 THEN 'go' ELSE 'rust' END AS language, count(*) AS chunks, sum(CASE k WHEN 0 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 0 END)::BIGINT AS symbols FROM x GROUP BY 1""")
def chunks_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunker of each language: parsed, by headings, by windows, by braces."""
    key = F.col("p_partkey") % 5
    pad = "# " + "pad " * 30 + "\n"
    language = F.when(key == 0, "python").when(key == 1, "markdown").when(key == 2, "toml").when(key == 3, "go").otherwise("rust")
    content = F.when(key == 0, F.lit("def a():\n    return 1\n\nclass B:\n    pass\n")).when(key == 1, F.lit("# T\nbody\n")).when(key == 2, F.lit(pad)).when(key == 3, F.lit("package a\n\nfunc (f *F) Go() {\n}\n")).otherwise(F.lit("pub fn go(a: i32) -> i32 {\n  a\n}\n"))
    found = chunking.chunk_files(_t(spark, sf_dir, "part").select(_s("p_partkey").alias("path"), language.alias("language"), content.alias("content")))
    return found.groupBy("language").agg(F.count("*").alias("chunks"), F.sum(F.size("symbols")).alias("symbols"))


@query("""
WITH l AS (SELECT DISTINCT 'n' || (p_partkey % 60) AS src, 'n' || (p_size + 5) AS dst FROM part WHERE p_partkey % 60 <> p_size + 5),
t AS (SELECT CASE WHEN src = 'n7' THEN dst ELSE src END AS node, count(*) AS degree FROM l WHERE src = 'n7' OR dst = 'n7' GROUP BY 1),
r AS (SELECT 'n' || s_suppkey AS node, s_suppkey / 10.0 + 1 AS score FROM supplier WHERE s_suppkey < 9 AND s_suppkey <> 7 ORDER BY score DESC, node LIMIT 5),
w AS (SELECT node, floor((0.4 + 0.6 * score / max(score) OVER ()) * 1000 + 0.5) / 1000 AS weight FROM r),
d AS (SELECT node, floor(least(1.0, 0.2 + 0.1 * degree) * 1000 + 0.5) / 1000 AS weight FROM t WHERE node NOT IN (SELECT node FROM w)),
a AS (SELECT 'n7' AS node, 2.0 AS weight UNION ALL SELECT * FROM w UNION ALL SELECT * FROM d)
SELECT node, CAST(least(weight, 1.0) AS DOUBLE) AS weight FROM (SELECT * FROM a ORDER BY weight DESC, node LIMIT 20)""")
def note_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nodes around a note: related ones, then linked ones by degree."""
    key = F.col("p_partkey")
    links = _t(spark, sf_dir, "part").select(_named("n", key % 60).alias("src"), _named("n", F.col("p_size") + 5).alias("dst")).filter("src <> dst").distinct()
    related = _t(spark, sf_dir, "supplier").filter("s_suppkey < 9 AND s_suppkey <> 7").select(_named("n", F.col("s_suppkey")).alias("path"), (F.col("s_suppkey") / 10 + 1).alias("score"))
    return crosslinks.neighbourhood("n7", related, links, 5, 20)[0].select("node", "weight")


@query("SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 2 = 0")
def versioned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written twice: the pointer names the second version."""
    root = f"{tables.shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    sinks.write_version(rows, root)
    sinks.write_version(rows.filter("k % 2 = 0"), root)
    return sinks.read_version(spark, root)


@query("SELECT 'embedKey' AS key, 'm|transformers|' || count(*) AS value FROM nation UNION ALL SELECT 'version', '2'")
def stored_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.params import embedding_identity

    root = f"{tables.shared_folder(spark)}/meta-{uuid.uuid4().hex}"
    n = _t(spark, sf_dir, "nation").count()
    tables.write_meta(spark, {"embedKey": "old"}, root)
    tables.write_meta(spark, {"embedKey": embedding_identity("m", "transformers", str(n)), "version": "2"}, root)
    return spark.createDataFrame(sorted(tables.read_meta(spark, root).items()), "key string, value string")


@query("""
SELECT p_brand || '.ts' AS query, p_type AS tier, 'p' || p_size AS path FROM part""")
def golden_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden rows written and read as JSON."""
    path = f"{tables.shared_folder(spark)}/golden-{uuid.uuid4().hex}"
    rows = _t(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(".ts")).alias("query"), F.col("p_type").alias("tier"), F.array(_named("p", F.col("p_size"))).alias("paths"))
    rows.write.json(path)
    found = spark.read.schema("query string, tier string, paths array<string>").json(path)
    return found.select("query", "tier", F.col("paths")[0].alias("path"))


@query("""
WITH c AS (SELECT 'io/f' || s_suppkey || '.go' AS f, s_suppkey AS k FROM supplier)
SELECT f AS from_path, 'use' AS from_symbol, 'Read' AS ref_name, 'resolved' AS conf, f AS to_path FROM c
UNION ALL SELECT f, 'Read', 'inner', 'resolved', f FROM c UNION ALL SELECT f, 'use', 'missing', 'external', NULL FROM c""")
def built_index_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index built over a Go file for each supplier: chunks, calls, types and the tiers over them."""
    k = _s("s_suppkey")
    content = F.concat(F.lit("package io\n\nfunc (f *File"), k, F.lit(") Read(p int) int {\n\treturn f.inner(p)\n}\n\nfunc (f *File"), k, F.lit(") inner(p int) int {\n\treturn p\n}\n\nfunc use(f *File"), k, F.lit(") {\n\tf.Read(1)\n\tmissing(2)\n}\n"))
    rows = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("io/f"), k, F.lit(".go")).alias("path"), F.lit(1).cast("long").alias("mtime_ms"), content.alias("content"))
    built = plan.build(rows, params=Params(disambiguate=False))
    return built.edges.filter("kind = 'calls'").select("from_path", "from_symbol", "ref_name", "conf", "to_path")
