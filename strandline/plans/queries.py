"""Checked queries over the driver's tables: each operator family on a stand-in for its own inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import predicates, text
from strandline.functions.vector import cosine
from strandline.operators import chunking, communities, crosslinks, evaluate, extract, gitmetrics, graph, resolve, search
from strandline.params import Params
from strandline.sources import files, sinks, tables
from strandline.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _low(x, digits: int):
    return text.floor_to(x, digits)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spread(_t(spark, sf_dir, "documents"))


_PATH_SQL = "source || '/' || lang || '/' || doc_id"


def _paths(docs: DataFrame) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return docs.withColumn("path", path)


# Version history


@query("""
WITH f AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS f FROM lineitem),
u AS (SELECT f.* FROM f JOIN (SELECT k FROM f GROUP BY k HAVING count(*) <= 25) g USING (k)),
n AS (SELECT f, count(*) AS n FROM u GROUP BY f),
p AS (SELECT a.f AS a, b.f AS b, count(*) AS c FROM u a JOIN u b ON a.k = b.k AND a.f < b.f GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT p.a, p.b, p.c AS count, floor(p.c / least(x.n, y.n) * 100.0 + 0.5) / 100.0 AS confidence
FROM p JOIN n x ON p.a = x.f JOIN n y ON p.b = y.f""")
def cochange(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_suppkey").alias("file"))
    return gitmetrics.cochange(items).drop("call_edge")


@query("""
WITH f AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS f FROM lineitem),
n AS (SELECT f, count(*) AS revisions FROM f JOIN (SELECT k FROM f GROUP BY k HAVING count(*) <= 25) g USING (k) GROUP BY f)
SELECT f AS file, revisions, p_size AS loc, revisions * p_size AS score FROM n JOIN part ON p_partkey = f""")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("file"))
    loc = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), F.col("p_size").alias("loc"))
    return gitmetrics.hotspots(items, loc, limit=None)


@query("""
SELECT hash, unnest(files) AS file FROM (VALUES ('a1', ['x.py', 'y.py']), ('b2', ['y.py']), ('c3', ['z.md', 'x.py'])) t(hash, files)""")
def git_log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = "\x01a1\nx.py\ny.py\n\n\x01b2\ny.py\n\x01c3\nz.md\nx.py\n"
    rows = files.parse_git_log(spark.createDataFrame([(log,)], "log string"))
    return rows.select("hash", F.explode("files").alias("file"))


# Store


_MANIFEST_SQL = f"""
WITH now AS (SELECT {_PATH_SQL} AS path, n_chars AS m FROM documents WHERE doc_id % 11 <> 3),
was AS (SELECT {_PATH_SQL} AS path, n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS m FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(now.path, was.path) AS path, CASE WHEN now.m IS NULL THEN 'deleted'
  WHEN was.m IS NULL OR was.m <> now.m THEN 'changed' ELSE 'unchanged' END AS state
FROM now FULL JOIN was ON now.path = was.path"""


def _listings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of one collection: files that came, went and changed."""
    rows = _paths(_t(spark, sf_dir, "documents")).select("doc_id", "path", F.col("n_chars").alias("mtime_ms"))
    now = rows.filter("doc_id % 11 <> 3").select("path", "mtime_ms")
    was = rows.filter("doc_id % 7 <> 0").select("path", (F.col("mtime_ms") + (F.col("doc_id") % 5 == 0).cast("int")).alias("mtime_ms"))
    return now, was


@query(_MANIFEST_SQL)
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, was = _listings(spark, sf_dir)
    return tables.diff_manifest(now, tables.manifest(was))


@query(f"""
WITH was AS (SELECT {_PATH_SQL} AS path, n_chars AS m FROM documents WHERE doc_id % 7 <> 0),
new AS (SELECT {_PATH_SQL} AS path, n_chars + 1 AS m FROM documents WHERE doc_id % 3 = 0)
SELECT path, m AS mtime_ms FROM was WHERE path NOT IN (SELECT path FROM new) UNION ALL SELECT path, m FROM new""")
def upsert_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(_t(spark, sf_dir, "documents")).select("doc_id", "path", F.col("n_chars").alias("mtime_ms"))
    new = rows.filter("doc_id % 3 = 0").select("path", (F.col("mtime_ms") + 1).alias("mtime_ms"))
    return tables.upsert(rows.filter("doc_id % 7 <> 0").select("path", "mtime_ms"), new)


@query("""
WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents), c AS (SELECT DISTINCT h FROM d WHERE doc_id % 7 <> 0)
SELECT doc_id, h IN (SELECT h FROM c) AS reused FROM d""")
def embed_cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", text.content_hash("text").alias("content_hash"))
    cache = rows.filter("doc_id % 7 <> 0").select("content_hash", F.array(F.lit(0.0)).alias("embedding"))
    hit, miss = tables.split_by_cache(rows, cache)
    return hit.select("doc_id", F.lit(True).alias("reused")).union(miss.select("doc_id", F.lit(False).alias("reused")))


@query("""
WITH e(kind, from_path, to_path, ref_name, candidates) AS (VALUES
  ('calls', 'a.py', 'b.py', 'run', CAST([] AS VARCHAR[])), ('calls', 'c.py', NULL, 'go', ['b.py', 'd.py']),
  ('calls', 'f.py', NULL, 'made', CAST([] AS VARCHAR[])), ('imports', 'g.py', 'b.py', 'b', CAST([] AS VARCHAR[])),
  ('links', 'n.md', 'm.md', 'm', CAST([] AS VARCHAR[])), ('calls', 'd.py', 'b.py', 'run', CAST([] AS VARCHAR[])))
SELECT DISTINCT from_path AS path FROM e WHERE kind <> 'imports' AND from_path <> 'd.py'
  AND (to_path IN ('b.py', 'd.py') OR list_has_any(candidates, ['b.py', 'd.py']) OR ref_name = 'made')
UNION SELECT 'b.py'""")
def reextract_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        ("calls", "a.py", "b.py", "run", []), ("calls", "c.py", None, "go", ["b.py", "d.py"]), ("calls", "f.py", None, "made", []),
        ("imports", "g.py", "b.py", "b", []), ("links", "n.md", "m.md", "m", []), ("calls", "d.py", "b.py", "run", []),
    ]
    edges = spark.createDataFrame(rows, "kind string, from_path string, to_path string, ref_name string, candidates array<string>")
    one = lambda p: spark.createDataFrame([(p,)], "path string")
    return tables.reextract_paths(edges, one("b.py"), one("d.py"), spark.createDataFrame([("b.py", "made")], "path string, name string"))


# Text


@query(f"""
SELECT doc_id, sha1(text) AS text_hash, {_PATH_SQL} || '::0-' || length(text) || '::' || substr(sha1(text), 1, 8) AS id,
  len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS n_lines,
  rtrim(substr(regexp_extract(text, '[^ \\t\\n\\r\\f\\v][^\\n]*'), 1, 120)) AS first_line,
  CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, regexp_replace({_PATH_SQL}, '[^A-Za-z0-9]+', ' ', 'g') AS path_words
FROM documents""")
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _paths(_documents(spark, sf_dir))
    return docs.select(
        "doc_id", text.text_hash("text").alias("text_hash"), text.stable_id("path", F.lit(0), F.length("text"), "text").alias("id"),
        text.line_count("text").alias("n_lines"), text.first_significant_line("text").alias("first_line"),
        text.estimate_tokens("text").alias("tokens"), text.path_tokens("path").alias("path_words"),
    )


@query("""
SELECT p_partkey, upper(p_name) AS shouted, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  trim(regexp_replace(lower(p_type), '[^a-z0-9_]+', '_', 'g'), '_') AS label,
  CAST((length(p_name) - length(replace(lower(p_name), 'a', ''))) AS BIGINT) AS n_a,
  substr(p_name, 1, 5) AS head FROM part""")
def label_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select(
        "p_partkey", F.upper("p_name").alias("shouted"), text.slug("p_name").alias("slug"), text.sanitise_label("p_type").alias("label"),
        text.count_matches("p_name", F.lit("a")).alias("n_a"), F.substring("p_name", 1, 5).alias("head"),
    )


@query(r"""
WITH n AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '/\*(?s:.*?)\*/', ' ', 'g'),
    '(^|[^:])//[^\n]*', '\1', 'g'), '(^|[ \t\n\r\f\v])#[^\n]*', '\1', 'g'), '[ \t\n\r\f\v]+', '', 'g') AS body FROM documents)
SELECT doc_id, sha1(body) AS body_hash FROM n""")
def drift_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", text.body_hash("text").alias("body_hash"))


@query(r"""
SELECT conv_id, turn, regexp_matches(trim(text, (E' \n\t\r\f' || chr(11))), '^[A-Za-z_$][A-Za-z0-9_$]*$') AS is_symbol,
  regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(tests?|specs?|mocks?|fixtures?)([^A-Za-z0-9_]|$)') AS seeks_tests,
  len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 4 AND w NOT IN (STRUCTURAL)))) AS n_terms
FROM conversations""".replace("STRUCTURAL", ", ".join(f"'{w}'" for w in text.STRUCTURAL_WORDS)))
def query_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select(
        "conv_id", "turn", predicates.is_symbol_query(F.col("text")).alias("is_symbol"), predicates.seeks_tests(F.col("text")).alias("seeks_tests"),
        F.size(text.query_terms("text")).cast("long").alias("n_terms"),
    )


@query("""
SELECT * FROM (VALUES ('getUser', 'symbol'), ('where is parseQuery used', 'mixed'), ('what does the API do', 'plain'), ('read utf8 text', 'mixed'),
  ('snake_case please', 'mixed'), ('how are files walked', 'plain'), ('HTTPServer start', 'mixed'), ('open fs.read now', 'mixed'), ('  run  ', 'symbol')) t(query, kind)""")
def query_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = ["getUser", "where is parseQuery used", "what does the API do", "read utf8 text", "snake_case please", "how are files walked", "HTTPServer start", "open fs.read now", "  run  "]
    return search.query_kind(spark.createDataFrame([(q,) for q in asked], "query string"))


@query("""
SELECT * FROM (VALUES ('src/tests/a.js', true), ('src/a.test.ts', true), ('pkg/test_io.py', true), ('src/contest.py', false), ('lib/a_test.go', true),
  ('spec/x.rb', true), ('src/latest/a.c', false), ('src/__tests__/b.tsx', true)) t(path, is_test)""")
def test_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ["src/tests/a.js", "src/a.test.ts", "pkg/test_io.py", "src/contest.py", "lib/a_test.go", "spec/x.rb", "src/latest/a.c", "src/__tests__/b.tsx"]
    return spark.createDataFrame([(p,) for p in rows], "path string").withColumn("is_test", predicates.is_test_path(F.col("path")))


@query("""
SELECT * FROM (VALUES ('src/app/main.ts', './util', 'src/app/util'), ('src/app/main.ts', '../lib/x.js', 'src/lib/x'), ('a.py', './b', 'b'),
  ('x/y/z.js', '../../top.mjs', 'top'), ('x/y.js', '../../../over', 'over')) t(from_path, spec, stem)""")
def relative_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("src/app/main.ts", "./util"), ("src/app/main.ts", "../lib/x.js"), ("a.py", "./b"), ("x/y/z.js", "../../top.mjs"), ("x/y.js", "../../../over")]
    frame = spark.createDataFrame(rows, "from_path string, spec string")
    return frame.withColumn("stem", text.resolve_relative("from_path", "spec"))


@query()
def line_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _paths(_documents(spark, sf_dir)).select("path", F.lit("txt").alias("language"), F.col("text").alias("content"))
    return chunking.chunk_files(docs).select("id", "path", "chunk_start", "chunk_end", "line_start", "line_end", F.length("text").alias("chars"))


# Retrieval


_KNN_SQL = """
SELECT q.vec_id AS query_id, c.vec_id AS id, c.label, floor(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) * 1e6 + 0.5) / 1e6 AS similarity
FROM embeddings q CROSS JOIN embeddings c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id"""


def _knn(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    rows = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    asked = rows.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return search.vector_top_batch(rows, asked, n, digits=6, skip_equal=True).join(rows.select("id", "label"), "id").select("query_id", "id", "label", "similarity", "vec_rank")


@query(f"""
SELECT query_id, id, label, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS vec_rank
FROM ({_KNN_SQL}) QUALIFY vec_rank <= 16""")
def vector_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, 16)


@query(f"""
WITH k AS (SELECT query_id, similarity AS score, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM ({_KNN_SQL})),
m AS (SELECT a.query_id, a.score, CASE WHEN a.score > 0 THEN (a.score - coalesce(b.score, 0)) / a.score ELSE 0 END AS margin
  FROM k a LEFT JOIN k b ON a.query_id = b.query_id AND b.rank = 2 WHERE a.rank = 1)
SELECT query_id, floor(margin * 10000.0 + 0.5) / 10000.0 AS margin,
  CASE WHEN score <= 0 THEN 'low' WHEN margin >= 0.3 THEN 'high' WHEN margin < 0.08 THEN 'low' ELSE 'high' END AS confidence FROM m""")
def context_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _knn(spark, sf_dir, 16).select("query_id", F.col("similarity").alias("score"), F.col("vec_rank").alias("rank"), "vec_rank")
    return search.margin_confidence(hits, ["query_id"])


_BM25_SQL = """
d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
s AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM d),
q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark),
p AS (SELECT term, id, doc_len, count(*) AS tf FROM (SELECT id, len(w) AS doc_len, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
b AS (SELECT query_id, id, floor(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))) * 1e6 + 0.5) / 1e6 AS score
  FROM p JOIN q USING (term) JOIN f USING (term), s GROUP BY query_id, id)"""


def _bm25(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    docs = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("fts_text"))
    asked = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.bm25_top_batch(docs, asked, n)


def _by_item(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """(query_id, id, vec_rank): vectors near to the one with the item's number."""
    vectors = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    seeds = vectors.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector")).join(asked, "query_id")
    return search.vector_top_batch(vectors, seeds, n, digits=6).select("query_id", "id", "vec_rank")


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, id): documents that hold a benchmark passage."""
    docs = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    return search.containing(docs, _t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage")))


@query(f"""WITH {_BM25_SQL}
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS fts_rank FROM b QUALIFY fts_rank <= 16""")
def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 16)


@query(f"""WITH {_BM25_SQL},
l AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS fts_rank FROM b QUALIFY fts_rank <= 24),
c AS (SELECT q.item_id AS query_id, e.vec_id AS id, floor(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) * 1e6 + 0.5) / 1e6 AS s
  FROM benchmark q JOIN embeddings v ON v.vec_id = q.item_id CROSS JOIN embeddings e),
v AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS vec_rank FROM c QUALIFY vec_rank <= 24),
u AS (SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.id, l.id) AS id, vec_rank, fts_rank,
  coalesce(1.0::DOUBLE / (60 + vec_rank), 0) + coalesce(1.0::DOUBLE / (60 + fts_rank), 0) AS raw FROM v FULL JOIN l ON v.query_id = l.query_id AND v.id = l.id)
SELECT query_id, id, vec_rank, fts_rank, 1.0::DOUBLE AS prior, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS rank,
  floor(raw * 10000.0 + 0.5) / 10000.0 AS score FROM u QUALIFY rank <= 8""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuse(_by_item(spark, sf_dir, 24), _bm25(spark, sf_dir, 24), 1.0, 8, keys=["query_id"])


@query(f"""WITH {_BM25_SQL},
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b QUALIFY rank <= 10),
g AS (SELECT item_id AS query_id, doc_id AS id, item_id % 4 AS tier FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)),
h AS (SELECT g.query_id, tier, min(rank) AS rank FROM g LEFT JOIN r ON g.query_id = r.query_id AND g.id = r.id GROUP BY 1, 2)
SELECT CASE WHEN grouping(tier) = 1 THEN 'all' ELSE CAST(tier AS VARCHAR) END AS tier, count(*) AS n,
  floor(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) * 10000.0 + 0.5) / 10000.0 AS recall_1,
  floor(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) * 10000.0 + 0.5) / 10000.0 AS recall_5,
  floor(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END) * 10000.0 + 0.5) / 10000.0 AS recall_10,
  floor(avg(coalesce(1.0::DOUBLE / rank, 0)) * 10000.0 + 0.5) / 10000.0 AS mrr FROM h GROUP BY ROLLUP (tier)""")
def retrieval_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _bm25(spark, sf_dir, 10).select(F.col("query_id").alias("query"), F.col("fts_rank").alias("rank"), F.col("id").cast("string").alias("path"), F.lit("1-1").alias("lines"))
    golden = _held(spark, sf_dir).groupBy(F.col("item_id").alias("query")).agg(F.collect_set(F.col("id").cast("string")).alias("paths"))
    golden = golden.withColumn("tier", (F.col("query") % 4).cast("string")).withColumn("lines", F.lit(None).cast("array<int>"))
    return evaluate.retrieval_metrics(evaluate.golden_ranks(golden, hits)).drop("sec_hit_1", "sec_hit_5")


@query(f"""WITH {_BM25_SQL},
l AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS fts_rank FROM b QUALIFY fts_rank <= 24),
c AS (SELECT q.item_id AS query_id, e.vec_id AS id, floor(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) * 1e6 + 0.5) / 1e6 AS s
  FROM benchmark q JOIN embeddings v ON v.vec_id = q.item_id CROSS JOIN embeddings e),
v AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS vec_rank FROM c QUALIFY vec_rank <= 24),
u AS (SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.id, l.id) AS id, vec_rank, fts_rank FROM v FULL JOIN l ON v.query_id = l.query_id AND v.id = l.id),
g(combo, w) AS (VALUES (0, 0.0::DOUBLE), (1, 0.3), (2, 0.5), (3, 1.0)),
r AS (SELECT combo, query_id, id, row_number() OVER (PARTITION BY combo, query_id ORDER BY
  coalesce(1.0::DOUBLE / (60 + vec_rank), 0) + coalesce(w / (60 + fts_rank), 0) DESC, id) AS rank FROM u, g QUALIFY rank <= 10),
t AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)),
h AS (SELECT g.combo, a.query_id, min(r.rank) AS rank FROM t a CROSS JOIN g LEFT JOIN r ON r.combo = g.combo AND r.query_id = a.query_id AND r.id = a.id GROUP BY 1, 2)
SELECT combo, floor(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) * 10000.0 + 0.5) / 10000.0 AS recall_1,
  floor(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) * 10000.0 + 0.5) / 10000.0 AS recall_5,
  floor(avg(coalesce(1.0::DOUBLE / rank, 0)) * 10000.0 + 0.5) / 10000.0 AS mrr FROM h GROUP BY combo""")
def weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical = _bm25(spark, sf_dir, 24).select("query_id", "id", "fts_rank")
    both = _by_item(spark, sf_dir, 24).join(lexical, ["query_id", "id"], "full")
    branches = both.select(F.col("query_id").alias("query"), F.lit("plain").alias("kind"), "id", F.col("id").alias("path"), "vec_rank", "fts_rank")
    grid = evaluate.grid_table(spark, evaluate.parse_grid("plain=0,0.3,0.5,1"), {"plain": 0.0, "symbol": 1.0, "mixed": 1.0})
    wanted = _held(spark, sf_dir).select(F.col("item_id").alias("query"), F.col("id").alias("path"))
    return evaluate.sweep(branches, grid, wanted)


@query("""SELECT * FROM (VALUES (1, 'c', 0.9::DOUBLE), (2, 'a', 0.5::DOUBLE), (3, 'b', NULL), (4, 'd', NULL)) t(rank, id, rerank_score)""")
def rerank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")], "rank int, id string")
    ranking = spark.createDataFrame([(0, 2, 0.9), (1, 0, 0.5), (2, 2, 0.4), (3, 99, 0.3)], "place int, index int, score double")
    return search.apply_rerank(hits, ranking, 4).select("rank", "id", "rerank_score")


@query("""SELECT * FROM (VALUES (1, 'b'), (2, 'a'), (3, 'c'), (4, 'e'), (5, 'd')) t(rank, id)""")
def centrality_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "a", 0.5, 1), (2, "b", 0.5, 9), (3, "c", 0.4, 0), (4, "d", 0.3, 0), (5, "e", 0.3, 2)]
    return search.centrality_tiebreak(spark.createDataFrame(rows, "rank int, id string, score double, degree int")).select("rank", "id")


# Graph


_LINKS_SQL = """
o AS (SELECT l_partkey AS s, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS t, l_returnflag AS f FROM lineitem),
links AS (SELECT CAST(s AS VARCHAR) AS src, CAST(t AS VARCHAR) AS dst, CASE WHEN bool_or(f <> 'R') THEN 'resolved' ELSE 'ambiguous' END AS conf
  FROM o WHERE s <> t GROUP BY 1, 2)"""


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, t, w): lineitems from suppliers of one nation to customers of another."""
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sold = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    sold = sold.join(_t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    sold = sold.join(_t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return sold.groupBy(F.col("c_nationkey").alias("s"), F.col("s_nationkey").alias("t")).agg(F.count("*").alias("w"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call graph of parts: each line's part to the next line's in its order; resolved where some line wasn't returned."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag")
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    pairs = items.withColumn("next", F.lead("l_partkey").over(order)).filter("next <> l_partkey")
    conf = F.when(F.bool_or(F.col("l_returnflag") != "R"), "resolved").otherwise("ambiguous").alias("conf")
    links = pairs.groupBy(F.col("l_partkey").cast("string").alias("src"), F.col("next").cast("string").alias("dst"))
    return tables.cut(links.agg(F.lit("calls").alias("kind"), conf))


@query(f"""WITH RECURSIVE {_LINKS_SQL},
walk AS (SELECT '3' AS node, 0 AS depth UNION SELECT links.dst, walk.depth + 1 FROM walk JOIN links ON links.src = walk.node WHERE walk.depth < 3),
near AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node HAVING min(depth) > 0)
SELECT node, depth, (SELECT count(*) FROM near) > 500 AS truncated FROM near ORDER BY depth, node LIMIT 500""")
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 by depth and key: the operator's own limit, told by ``truncated``."""
    return graph.impact(_links(spark, sf_dir), spark.createDataFrame([("3",)], "node string"), "callees", 3)


@query(f"""WITH RECURSIVE {_LINKS_SQL}, e AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links),
walk AS (SELECT '7' AS node, 0 AS depth UNION SELECT e.b, walk.depth + 1 FROM walk JOIN e ON e.a = walk.node WHERE walk.depth < 2)
SELECT node, min(depth) AS depth FROM walk GROUP BY node""")
def ego_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bfs(_links(spark, sf_dir), spark.createDataFrame([("7",)], "node string"), 2, directed=False)


@query(f"""WITH RECURSIVE {_LINKS_SQL},
hops AS (SELECT '3' AS node, 0 AS depth UNION SELECT links.dst, hops.depth + 1 FROM hops JOIN links ON links.src = hops.node WHERE hops.depth < 8),
dist AS (SELECT node, min(depth) AS depth FROM hops GROUP BY node), goal AS (SELECT * FROM dist WHERE node = (SELECT max(dst) FROM links)),
walk AS (SELECT '3' AS node, 0 AS depth, ['3'] AS path UNION ALL SELECT links.dst, walk.depth + 1, list_append(walk.path, links.dst)
  FROM walk JOIN links ON links.src = walk.node JOIN dist ON dist.node = links.dst AND dist.depth = walk.depth + 1 WHERE walk.depth < (SELECT depth FROM goal))
SELECT array_to_string(path, '>') AS path, depth AS hops FROM walk WHERE node = (SELECT node FROM goal) ORDER BY walk.path LIMIT 1""")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    found = graph.shortest_path(links, spark.createDataFrame([("3",)], "node string"), links.agg(F.max("dst").alias("node")), 8)
    return found.select(F.array_join("path", ">").alias("path"), "hops")


_NEXT_SQL = """
n AS (SELECT max(p_partkey) + 1 AS n FROM part),
links AS (SELECT CAST(p_partkey AS VARCHAR) AS src, CAST((p_partkey * 7 + p_size) % n AS VARCHAR) AS dst FROM part, n)"""


def _next_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One link a part, to another one by arithmetic: cycles and trees that lead into them."""
    part = _t(spark, sf_dir, "part")
    n = (part.agg(F.max("p_partkey").alias("n")).first().n or 0) + 1
    target = (F.col("p_partkey") * 7 + F.col("p_size")) % n
    return tables.cut(part.select(F.col("p_partkey").cast("string").alias("src"), target.cast("string").alias("dst"), F.lit("calls").alias("kind"), F.lit("resolved").alias("conf")))


_CLOSURE_SQL = """
walk AS (SELECT src AS a, dst AS b FROM links UNION SELECT walk.a, links.dst FROM walk JOIN links ON links.src = walk.b),
nodes AS (SELECT src AS node FROM links UNION SELECT dst FROM links),
mutual AS (SELECT x.a AS node, x.b AS other FROM walk x JOIN walk y ON x.a = y.b AND x.b = y.a UNION SELECT node, node FROM nodes),
comp AS (SELECT node, min(other) AS component FROM mutual GROUP BY node)"""


@query(f"WITH RECURSIVE {_NEXT_SQL}, {_CLOSURE_SQL} SELECT node, component FROM comp")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(_next_links(spark, sf_dir))


@query(f"""WITH RECURSIVE {_NEXT_SQL}, {_CLOSURE_SQL}
SELECT component, count(*) AS size, array_to_string(list_sort(list(node)), ',') AS members FROM comp GROUP BY component HAVING count(*) > 1""")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(_next_links(spark, sf_dir)).withColumn("members", F.array_join("members", ","))


@query(f"""WITH RECURSIVE {_NEXT_SQL}, {_CLOSURE_SQL},
big AS (SELECT component, count(*) AS size FROM comp GROUP BY component HAVING count(*) > 1 ORDER BY size DESC, component LIMIT 1),
step AS (SELECT component AS node, [component] AS path FROM big UNION ALL SELECT links.dst, list_append(step.path, links.dst)
  FROM step JOIN links ON links.src = step.node WHERE len(step.path) <= (SELECT size FROM big))
SELECT array_to_string(path, '>') AS path, len(path) - 1 AS hops FROM step WHERE len(path) = (SELECT size FROM big) + 1""")
def example_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest cycle of the largest component through its least node."""
    links = _next_links(spark, sf_dir)
    big = graph.cycles(links).orderBy(F.desc("size"), "component").first()
    found = graph.example_cycle(links, big["members"] if big else ["none"])
    return found.select(F.array_join("path", ">").alias("path"), "hops")


@query(f"WITH {_NEXT_SQL} SELECT 'calls' AS kind, count(*) AS self_loops FROM links WHERE src = dst HAVING count(*) > 0")
def self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.self_loops(_next_links(spark, sf_dir))


@query(f"""WITH {_LINKS_SQL} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM links UNION ALL SELECT dst FROM links) GROUP BY node""")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_links(spark, sf_dir), ("calls",))


_BRANDS_SQL = f"""{_LINKS_SQL}, r AS (SELECT CAST(p_partkey AS VARCHAR) AS k, p_brand AS g FROM part),
rolled AS (SELECT a.g AS source, b.g AS target, 'calls' AS kind, count(*) AS count, max(conf = 'ambiguous') AS worst_is_ambiguous
  FROM links JOIN r a ON a.k = src JOIN r b ON b.k = dst WHERE a.g <> b.g GROUP BY 1, 2)"""


def _brand_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k"), F.col("p_brand").alias("g"))
    placed = _links(spark, sf_dir).join(brand.withColumnsRenamed({"k": "src", "g": "gs"}), "src").join(brand.withColumnsRenamed({"k": "dst", "g": "gt"}), "dst")
    return graph.roll_up(placed, F.col("gs"), F.col("gt"))


@query(f"WITH {_BRANDS_SQL} SELECT * FROM rolled")
def rollup_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = _brand_links(spark, sf_dir)
    return rolled.select("source", "target", "kind", "count", (F.col("conf") == "ambiguous").alias("worst_is_ambiguous"))


@query("""
WITH hit AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity >= 45)
SELECT p_name AS name, 'lib/' || p_partkey || '.go' AS path, CASE WHEN regexp_matches(p_name, '^[A-Z]') THEN 'possible_entrypoint' ELSE 'likely_dead' END AS class
FROM part WHERE p_partkey NOT IN (SELECT k FROM hit)""")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.concat(F.lit("lib/"), F.col("p_partkey").cast("string"), F.lit(".go")).alias("path"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"), F.col("p_type").alias("text"))
    hit = _t(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select("l_partkey").distinct()
    named = part.join(hit.select(F.concat(F.lit("lib/"), F.col("l_partkey").cast("string"), F.lit(".go")).alias("path")), "path")
    links = named.select(F.lit("caller").alias("src"), graph.node_key(F.col("path"), F.col("name")).alias("dst"), F.lit("calls").alias("kind"), F.lit("resolved").alias("conf"))
    return graph.orphans(part, links, spark.createDataFrame([], "node string")).select("name", "path", "class")


_MOD_SQL = """
WITH n AS (SELECT c.c_nationkey AS s, s.s_nationkey AS t, count(*) AS w FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2),
a AS (SELECT least(s, t) AS a, greatest(s, t) AS b, sum(w)::DOUBLE AS w FROM n WHERE s <> t GROUP BY 1, 2),
p AS (SELECT w, x.n_regionkey AS ca, y.n_regionkey AS cb FROM a JOIN nation x ON a.a = x.n_nationkey JOIN nation y ON a.b = y.n_nationkey),
i AS (SELECT ca AS c, sum(w) AS inner_w FROM p WHERE ca = cb GROUP BY ca),
t AS (SELECT c, sum(w) AS total FROM (SELECT ca AS c, w FROM p UNION ALL SELECT cb, w FROM p) GROUP BY c), m AS (SELECT sum(w) AS m FROM a)
SELECT floor(sum(coalesce(inner_w, 0) / m - (total / (2 * m)) * (total / (2 * m))) * 1e6 + 0.5) / 1e6 AS q FROM t LEFT JOIN i USING (c), m"""


def _nation_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    trade = _trade(spark, sf_dir).filter("s <> t")
    return trade.groupBy(F.least("s", "t").cast("string").alias("a"), F.greatest("s", "t").cast("string").alias("b")).agg(F.sum("w").cast("double").alias("w"))


def _deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, w): customer, supplier and the lineitems between them."""
    items = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ends = (F.concat(F.lit(p), F.col(c).cast("string")).alias(n) for p, c, n in (("c", "o_custkey", "a"), ("s", "l_suppkey", "b")))
    return items.select(*ends).filter("a IS NOT NULL AND b IS NOT NULL").repartition("a").groupBy("a", "b").agg(F.count("*").cast("double").alias("w"))


@query(_MOD_SQL)
def modularity_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("node"), F.col("n_regionkey").alias("community"))
    return communities.modularity(tables.cut(_nation_adjacency(spark, sf_dir)), region).select(_low("q", 6).alias("q"))


@query()
def leiden_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all customers and suppliers, by the lineitems between them."""
    return communities.detect(tables.cut(_deals(spark, sf_dir)))


@query(f"""WITH {_BRANDS_SQL}
SELECT 'flowchart LR' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS diagram FROM (
  SELECT '  n' || substr(sha1(source), 1, 8) || '["' || source || '"] -->|calls| n' || substr(sha1(target), 1, 8) || '["' || target || '"]' AS line FROM rolled)""")
def mermaid_diagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diagram is one string: of the links between brands, whose number is fixed."""
    return sinks.mermaid(_brand_links(spark, sf_dir).select("source", "target", "kind"))


@query("""
WITH RECURSIVE b(name, base) AS (VALUES ('C', 'B'), ('B', 'A'), ('D', 'B'), ('X', 'Y'), ('Y', 'X')),
w AS (SELECT name, base, 1 AS depth FROM b UNION SELECT w.name, b.base, w.depth + 1 FROM w JOIN b ON b.name = w.base WHERE w.depth < 10)
SELECT name, base, min(depth) AS depth FROM w WHERE name <> base GROUP BY 1, 2""")
def class_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("C", "B"), ("B", "A"), ("D", "B"), ("X", "Y"), ("Y", "X")]
    return graph.transitive_bases(spark.createDataFrame(rows, "name string, base string"))


# Pages as notes: what they link to


_PAGES_SQL = """
h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]+)"', 1)) AS host FROM pages),
e AS (SELECT DISTINCT page_id, host FROM h)"""


def _page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = F.regexp_extract_all("html", F.lit('href="(/[^"]+)"'), F.lit(1))
    return _t(spark, sf_dir, "pages").select("page_id", F.explode(hosts).alias("host")).distinct()


@query(f"""WITH {_PAGES_SQL} SELECT host, count(*) AS pages, min(page_id) AS first_page FROM e GROUP BY host""")
def backlinks_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_links(spark, sf_dir).groupBy("host").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


@query(f"""WITH {_PAGES_SQL}, top AS (SELECT host FROM e GROUP BY host ORDER BY count(*) DESC, host LIMIT 1),
c AS (SELECT DISTINCT page_id FROM e WHERE host IN (SELECT host FROM top))
SELECT host AS node, count(*) AS cocited, least(0.5::DOUBLE * least(count(*), 3) / 3, 1.0) AS proximity FROM e WHERE page_id IN (SELECT page_id FROM c)
AND host NOT IN (SELECT host FROM top) GROUP BY host""")
def cocited_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _page_links(spark, sf_dir)
    top = pairs.groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").first()
    start = top["host"] if top else ""
    links = tables.cut(pairs.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("src"), F.col("host").alias("dst"), F.lit("links").alias("kind"), F.lit("resolved").alias("conf")))
    near = graph.link_proximity(links, start, 1).filter("cocited IS NOT NULL")
    return near.select("node", "cocited", "proximity")


# Resolution


_CALLS = [
    (1, "a.ts", "local", "local"), (2, "a.ts", "nowhere", None), (3, "a.ts", "helper", None), (4, "b.ts", "own", None),
    (5, "a.ts", "own", None), (6, "c.ts", "twice", None),
]
_DEFS = [("helper", "lib/h.ts", "1-3"), ("helper", "lib/g.ts", "2-4"), ("own", "b.ts", "5-6"), ("twice", "x.ts", "1-2"), ("twice", "y.ts", "1-2")]


@query("""SELECT * FROM (VALUES (1, 'resolved', 'a.ts', 'local', ''), (2, 'external', NULL, NULL, ''), (3, 'resolved', 'lib/h.ts', 'helper', ''),
  (4, 'resolved', 'b.ts', 'own', ''), (5, 'ambiguous', NULL, NULL, 'b.ts'), (6, 'ambiguous', NULL, NULL, 'x.ts,y.ts')) t(call_id, conf, to_path, to_symbol, candidates)""")
def resolution_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = spark.createDataFrame(_CALLS, "call_id int, from_path string, ref_name string, local_target string")
    imports = spark.createDataFrame([("a.ts", "helper", "lib/h")], "from_path string, name string, stem string")
    done = resolve.resolve_calls(calls, spark.createDataFrame(_DEFS, "name string, path string, lines string"), imports)
    return done.select("call_id", "conf", "to_path", "to_symbol", F.array_join("candidates", ",").alias("candidates"))


@query("""SELECT * FROM (VALUES ('a.md', 'Plan', 'resolved', 'notes/plan.md'), ('a.md', 'gone', 'external', NULL), ('b.md', 'dup', 'ambiguous', NULL)) t(from_path, target, conf, to_path)""")
def wikilink_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = "see [[Plan#goals|the plan]] and\n```\n[[fenced]]\n```\n![[gone]]"
    notes = spark.createDataFrame([("a.md", content), ("b.md", "[[dup]]"), ("notes/plan.md", ""), ("x/dup.md", ""), ("y/dup.md", "")], "path string, content string")
    return resolve.resolve_wikilinks(extract.wikilinks(notes), notes.select("path")).select("from_path", "target", "conf", "to_path")


@query("""SELECT * FROM (VALUES ('Reader', 'File'), ('Reader', 'Both'), ('Any', 'File'), ('Any', 'Both'), ('Any', 'Writer')) t(interface, type)""")
def interface_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    interfaces = spark.createDataFrame([("Reader", "read"), ("Reader", "close"), ("Any", None)], "interface string, method string")
    methods = spark.createDataFrame([("File", "read", "f.go"), ("File", "close", "f.go"), ("Both", "read", "b.go"), ("Both", "close", "b.go"), ("Both", "write", "b.go"), ("Writer", "write", "w.go")], "type string, name string, path string")
    return resolve.implementers(interfaces, methods)


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS call_id FROM lineitem),
k AS (SELECT l_orderkey, l_linenumber AS line_start, l_linenumber + 1 AS line_end, l_partkey FROM lineitem WHERE l_linenumber % 3 = 1),
j AS (SELECT call_id, l_partkey, row_number() OVER (PARTITION BY call_id ORDER BY
  CASE WHEN c.l_linenumber BETWEEN line_start AND line_end THEN 0 ELSE 1 END, abs(line_start - c.l_linenumber), line_start, CAST(l_partkey AS VARCHAR)) AS n
  FROM c JOIN k USING (l_orderkey))
SELECT call_id, CAST(l_partkey AS VARCHAR) AS content_hash FROM j WHERE n = 1""")
def covering_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "lineitem")
    path = F.col("l_orderkey").cast("string")
    calls = items.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), path.alias("from_path"), F.col("l_linenumber").alias("line"))
    spans = items.filter("l_linenumber % 3 = 1").select(path.alias("path"), F.col("l_linenumber").alias("line_start"), (F.col("l_linenumber") + 1).alias("line_end"), F.col("l_partkey").cast("string").alias("content_hash"))
    return resolve.covering_chunk(calls, spans)


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, 's' || label AS name, 'f' || (vec_id % 5) AS path FROM embeddings),
p AS (SELECT q.vec_id AS call_id, d.path, max(floor(list_cosine_similarity(q.v, d.v) * 1e6 + 0.5) / 1e6) AS sim FROM e q JOIN e d ON q.name = d.name AND q.vec_id <> d.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS n, lead(sim) OVER w AS second FROM p WINDOW w AS (PARTITION BY call_id ORDER BY sim DESC, path))
SELECT call_id, path AS to_path, floor(sim * 10000.0 + 0.5) / 10000.0 AS score FROM r WHERE n = 1 AND sim >= 0.3 AND (second IS NULL OR sim - second >= 0.01)""")
def disambiguation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.concat(F.lit("s"), F.col("label").cast("string")).alias("name"), F.concat(F.lit("f"), (F.col("vec_id") % 5).cast("string")).alias("path"))
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("call_id"), "name", F.col("embedding").alias("here"))
    pairs = asked.join(rows, "name").filter("call_id <> vec_id")
    best = pairs.withColumn("sim", _low(cosine(F.col("here"), F.col("embedding")), 6)).groupBy("call_id", "path").agg(F.max("sim").alias("sim"))
    return resolve.promote(best, Params(disambiguate_threshold=0.3, disambiguate_margin=0.01))


# Drift


_EDIT_SQL = "CASE WHEN doc_id % 7 = 2 THEN text || ' more' WHEN doc_id % 7 = 4 THEN 'new ' || text WHEN doc_id % 7 = 5 THEN text || '   ' ELSE text END"


def _bare_sql(column: str) -> str:
    """Without comments and blanks."""
    no_blocks = f"regexp_replace({column}, '/\\*(?s:.*?)\\*/', ' ', 'g')"
    no_lines = f"regexp_replace({no_blocks}, '(^|[^:])//[^\\n]*', '\\1', 'g')"
    return f"regexp_replace(regexp_replace({no_lines}, '(^|[ \\t\\n\\r\\f\\v])#[^\\n]*', '\\1', 'g'), '[ \\t\\n\\r\\f\\v]+', '', 'g')"


def _signature_sql(column: str) -> str:
    """What stands before the first brace, else the first line that is not blank."""
    blanks = "(E' \\n\\t\\r\\f' || chr(11))"
    before = f"trim(regexp_replace(string_split({column}, '{{')[1], '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), {blanks})"
    rows = f"list_filter(list_transform(string_split({column}, chr(10)), lambda s: trim(s, {blanks})), lambda s: s <> '')"
    return f"CASE WHEN contains({column}, '{{') THEN {before} ELSE coalesce(list_extract({rows}, 1), '') END"


@query(f"""
WITH b AS (SELECT doc_id, source AS note, CAST(doc_id AS VARCHAR) AS symbol, text AS t FROM documents),
c AS (SELECT doc_id, {_EDIT_SQL} AS u FROM documents WHERE doc_id % 7 <> 1),
x AS (SELECT note, symbol, c.doc_id IS NULL AS gone, {_signature_sql("t")} AS s1, {_signature_sql("u")} AS s2, {_bare_sql("t")} AS b1, {_bare_sql("u")} AS b2
  FROM b LEFT JOIN c USING (doc_id)),
g AS (SELECT note, symbol, CASE WHEN gone THEN 'removed' WHEN s1 <> s2 THEN 'signature' WHEN b1 <> b2 THEN 'body' END AS grade FROM x)
SELECT note, symbol, grade, CASE grade WHEN 'body' THEN 'medium' ELSE 'high' END AS severity FROM g WHERE grade IS NOT NULL""")
def drift_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grades of all documents, those with comment marks and braces too."""
    docs = _documents(spark, sf_dir)
    refs = docs.select("doc_id", F.col("source").alias("note"), F.lit("symbol").alias("kind"), F.col("doc_id").cast("string").alias("symbol"), F.lit("f").alias("path"), F.lit("1-1").alias("lines"), "text")
    edited = F.expr("CASE WHEN doc_id % 7 = 2 THEN text || ' more' WHEN doc_id % 7 = 4 THEN 'new ' || text WHEN doc_id % 7 = 5 THEN text || '   ' ELSE text END")
    now = crosslinks.snapshot(refs.filter("doc_id % 7 <> 1").withColumn("text", edited))
    return crosslinks.drift(crosslinks.snapshot(refs), now).select("note", "symbol", "grade", "severity")


# Classification tallies over events


_CONF_SQL = "CASE event_id % 5 WHEN 0 THEN 'resolved' WHEN 1 THEN 'external' WHEN 2 THEN 'inferred' ELSE 'ambiguous' END"


@query(f"""SELECT count_if(c = 'resolved') AS resolved, count_if(c = 'inferred') AS inferred, count_if(c = 'dispatch') AS dispatch, count_if(c = 'ambiguous') AS ambiguous,
  count_if(c = 'external') AS external FROM (SELECT {_CONF_SQL} AS c FROM events)""")
def confidence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.conf_split(_t(spark, sf_dir, "events").select(F.expr(_CONF_SQL).alias("conf")))


@query(f"""
WITH e AS (SELECT event_type AS ext, {_CONF_SQL} AS c, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'T' || (user_id % 4) END AS rt, user_id % 2 = 0 AS cls FROM events),
r AS (SELECT ext, c, CASE WHEN c = 'ambiguous' THEN CASE WHEN rt IS NULL AND NOT cls THEN 'a' WHEN rt IS NULL THEN 'b' WHEN rt IN ('T3') THEN 'c' ELSE 'd' END END AS reason FROM e)
SELECT CASE WHEN grouping(ext) = 1 THEN 'all' ELSE ext END AS ext, count(*) AS total, count_if(c = 'resolved') AS resolved, count_if(c = 'external') AS external,
  count_if(c = 'inferred') AS inferred, count_if(reason = 'a') AS no_enclosing_class, count_if(reason = 'b') AS receiver_untyped,
  count_if(reason = 'c') AS receiver_external, count_if(reason = 'd') AS method_external FROM r GROUP BY ROLLUP (ext)""")
def member_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select(
        F.concat(F.lit("x."), F.col("event_type")).alias("from_path"), F.lit("calls").alias("kind"), F.lit(True).alias("is_method"), F.expr(_CONF_SQL).alias("conf"),
        F.lit("r").alias("receiver"), F.expr("CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'T' || (user_id % 4) END").alias("receiver_type"),
        F.expr("CASE WHEN user_id % 2 = 0 THEN 'C' END").alias("enclosing_class"), F.array(F.lit("a")).alias("candidates"), F.lit(False).alias("has_method"))
    types = spark.createDataFrame([("T0",), ("T1",), ("T2",)], "type string")
    return evaluate.member_call_stats(rows, types).select("ext", "total", "resolved", "external", "inferred", "no_enclosing_class", "receiver_untyped", "receiver_external", "method_external")


@query("""SELECT 1::BIGINT AS tp, 1::BIGINT AS fp, 1::BIGINT AS fn, 1::BIGINT AS tn, 0.5::DOUBLE AS precision, 0.5::DOUBLE AS recall, 0.5::DOUBLE AS abstain""")
def disambiguation_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = spark.createDataFrame([("a", "f", "x"), ("b", "g", "y"), ("c", "h", None), ("d", "i", None)], "from_path string, symbol string, expect string")
    made = spark.createDataFrame([("a", "f", "x"), ("c", "h", "z")], "from_path string, symbol string, to_path string")
    return evaluate.disambiguation_metrics(golden, made)


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events),
l AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS b FROM e),
s AS (SELECT *, sum(CASE WHEN b IS NULL OR t - b >= 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM l)
SELECT user_id, CAST(session AS BIGINT) AS session, min(t) AS start, max(t) AS last, count(*) AS n FROM s GROUP BY 1, 2""")
def change_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.sessions_by_gap(_t(spark, sf_dir, "events"), "user_id", 3600)


@query("""
SELECT epoch_us(time_bucket(INTERVAL '5 minutes', ts)) AS start, count(*) AS n, count(DISTINCT user_id) AS paths FROM events GROUP BY 1""")
def periodic_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").withColumn("path", F.col("user_id"))
    return watch.sweeps(rows).select(F.unix_micros("start").alias("start"), "n", "paths")


# Literal fixtures: shapes that the tables lack


@query("""SELECT * FROM (VALUES ('n1', 'symbol', 'parseQuery', 'src/q.ts', 2.1::DOUBLE), ('n1', 'file', NULL, 'lib/src/util.ts', 0.5), ('n2', 'symbol', 'walkRepo', 'src/w.ts', 1.08)) t(note, kind, symbol, path, rank)""")
def code_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = spark.createDataFrame([("n1", "parseQuery calls parseQuery, see src/util.ts"), ("n2", "walkRepo with this"), ("n3", "nothing here")], "path string, text string")
    inventory = spark.createDataFrame([("parseQuery", "src/q.ts", 1, 4, "function parseQuery() {"), ("walkRepo", "src/w.ts", 2, 9, "function walkRepo() {"), ("other", "src/o.ts", 1, 1, "")], "name string, path string, line_start int, line_end int, text string")
    listing = spark.createDataFrame([("lib/src/util.ts", "x"), ("lib/util.ts", "y")], "path string, text string")
    return crosslinks.code_links(notes, inventory, listing).select("note", "kind", "symbol", "path", "rank")


@query("""
WITH s(path, sr) AS (VALUES ('a', 1), ('b', 2)), l(path, lr) AS (VALUES ('b', 1), ('c', 2)), p(path, prox) AS (VALUES ('c', 1.0::DOUBLE), ('a', 0.5))
SELECT coalesce(s.path, l.path) AS path, floor((coalesce(1.0::DOUBLE / (60 + sr), 0) + coalesce(1.0::DOUBLE / (60 + lr), 0)) * (1 + 0.25 * coalesce(prox, 0)) * 10000.0 + 0.5) / 10000.0 AS score
FROM s FULL JOIN l ON s.path = l.path LEFT JOIN p ON p.path = coalesce(s.path, l.path)""")
def note_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    semantic = spark.createDataFrame([("a", 0.9), ("a", 0.2), ("b", 0.8)], "path string, similarity double")
    lexical = spark.createDataFrame([("b", 3.0), ("c", 2.0)], "path string, bm25 double")
    proximity = spark.createDataFrame([("c", 1, 0, 1.0), ("a", 2, 1, 0.5)], "path string, hop int, cocited int, proximity double")
    return crosslinks.connections(semantic, lexical, proximity).select("path", "score")


@query("""SELECT * FROM (VALUES ('a.ts', 'f', 'calls', 'b.ts', 'correct'), ('a.ts', 'g', 'calls', 'c.ts', 'wrong'), ('a.ts', 'h', 'calls', NULL, 'correct'), ('z.ts', 'q', 'imports', 'y', 'missing')) t("from", symbol, kind, "to", verdict)""")
def edge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = spark.createDataFrame([("a.ts", "f", "calls", "b.ts"), ("a.ts", "g", "calls", "c.ts"), ("a.ts", "h", "calls", None), ("z.ts", "q", "imports", "y")], "from string, symbol string, kind string, to string")
    made = spark.createDataFrame([("a.ts", "f", "calls", None, "dispatch", ["b.ts"]), ("a.ts", "g", "calls", "d.ts", "resolved", []), ("a.ts", "h", "calls", None, "external", [])], "from_path string, ref_name string, kind string, to_path string, conf string, candidates array<string>")
    return evaluate.edge_tally(golden, made)


@query("""SELECT 1::BIGINT AS correct, 1::BIGINT AS false_dead, 0::BIGINT AS false_entrypoint, 1::BIGINT AS missing, 0.3333::DOUBLE AS accuracy""")
def orphan_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = spark.createDataFrame([("a", "f", "likely_dead"), ("a", "g", "possible_entrypoint"), ("b", "h", "likely_dead")], "path string, symbol string, expect string")
    found = spark.createDataFrame([("a", "f", "likely_dead"), ("a", "g", "likely_dead")], "path string, name string, class string")
    return evaluate.orphan_metrics(golden, found)


@query("""SELECT * FROM (VALUES ('all', 'recall_1', 0.93::DOUBLE, 0.9::DOUBLE, true), ('all', 'mrr', 0.8, 0.79, false)) t(tier, metric, was, now, regressed)""")
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = spark.createDataFrame([("all", 0.90, 0.79), ("hard", 0.1, 0.1)], "tier string, recall_1 double, mrr double")
    was = spark.createDataFrame([("all", 0.93, 0.8), ("hard", 0.9, 0.9)], "tier string, recall_1 double, mrr double")
    return evaluate.compare_baseline(now, was)


@query("""SELECT 1::BIGINT AS correct, 1::BIGINT AS wrong, 1::BIGINT AS external, 1::BIGINT AS unaligned, 2::BIGINT AS refs, 0.5::DOUBLE AS precision, 0.5::DOUBLE AS recall""")
def index_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.createDataFrame(
        [(1, "src/a.ts", 5, "run", "resolved", "src/b.ts", "1-9", []), (2, "src/a.ts", 8, "go", "resolved", "src/z.ts", "1-9", []), (3, "src/a.ts", 11, "ext", "resolved", "src/b.ts", "1-9", []), (4, "src/a.ts", 40, "run", "resolved", "src/b.ts", "1-9", [])],
        "edge_id int, from_path string, line int, ref_name string, conf string, to_path string, to_lines string, candidates array<string>")
    references = spark.createDataFrame([("a.ts", 6, "S#run().", "run"), ("a.ts", 8, "S#go().", "go"), ("a.ts", 11, "X#ext().", "ext")], "path string, line int, symbol string, method string")
    definitions = spark.createDataFrame([("S#run().", "b.ts", 3), ("S#go().", "b.ts", 4)], "symbol string, path string, line int")
    return evaluate.oracle_check(edges, references, definitions)["metrics"]


@query("""SELECT * FROM (VALUES ('d', 'links', 'resolved', 2::BIGINT), ('e', 'calls', 'external', 1)) t(target, kind, conf, n)""")
def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("links", "resolved", "a.md", None, "d", None, "d"), ("links", "resolved", "b.md", None, "d", None, "d"), ("calls", "external", "x/a.ts", "f", None, None, "e")]
    edges = spark.createDataFrame(rows, "kind string, conf string, from_path string, from_symbol string, to_path string, to_symbol string, ref_name string")
    _, merged = graph.visual_graph(edges)
    return merged.groupBy(F.regexp_replace("target", "^(note|ext):", "").alias("target"), "kind", "conf").agg(F.count("*").alias("n"))


@query("""SELECT * FROM (VALUES ('b', 'g'), ('a', 'f')) t(path, symbol)""")
def stem_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = spark.createDataFrame([("f", "src/a", "imports", "resolved"), ("g", "src/b", "imports", "resolved"), ("h", "src/c", "imports", "resolved")], "src string, dst string, kind string, conf string")
    paths = spark.createDataFrame([("src/a.ts",), ("src/b.py",), ("src/c.h",), ("src/c.cpp",)], "path string")
    rows = graph.resolve_stems(links, paths).filter("dst LIKE '%.%'")
    return rows.select(F.regexp_extract("dst", "/([a-z])[.]", 1).alias("path"), F.col("src").alias("symbol"))


@query("""SELECT * FROM (VALUES ('file.h', 'run', 'Base'), ('own.h', 'run', 'Own')) t(from_path, ref_name, receiver_type)""")
def field_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = spark.createDataFrame([("file.h", "run", "p", None, "Kid"), ("own.h", "run", "q", None, "Kid")], "from_path string, ref_name string, receiver string, receiver_type string, enclosing_class string")
    fields = spark.createDataFrame([("Parent", "p", "Base"), ("Kid", "q", "Own"), ("Parent", "q", "Far")], "class string, field string, type string")
    ancestors = spark.createDataFrame([("Kid", "Parent", 1)], "name string, base string, depth int")
    return resolve.field_receivers(calls, fields, ancestors).select("from_path", "ref_name", "receiver_type")


@query("""
WITH m AS (SELECT doc_id, text, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM documents)
SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CAST(w AS BIGINT) AS words FROM m""")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return docs.select("doc_id", text.estimate_tokens("text").alias("tokens"), F.regexp_count("text", F.lit("[A-Za-z0-9_]+")).cast("long").alias("words"))


def queries() -> dict[str, Query]:
    from strandline.plans import checked  # noqa: F401  its queries register themselves

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
