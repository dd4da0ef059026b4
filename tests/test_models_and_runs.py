"""Model policies, a model in the worker, evaluation runs, drawn graphs, the busy gate, meta and postings."""

import json
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import models, text
from strandline.operators import crosslinks, graph, search
from strandline.plans import evaluation
from strandline.plans import index as plan
from strandline.sources import files, sinks, tables
from strandline.streaming import watch


def test_batches_retries_and_refusals():
    seen, failures = [], iter([RuntimeError("busy"), None, None, None])

    def model(texts):
        seen.append(list(texts))
        if (problem := next(failures, None)) is not None:
            raise problem
        return [[float(len(t))] for t in texts]

    run = models.Batched(model, batch=2, wait=0.01, truncate=4)
    out = run(pd.Series(["abcdef", "x", None, "abcdzz", "yy"]))
    assert out.tolist() == [[4.0], [1.0], [0.0], [4.0], [2.0]]
    assert seen == [["abcd", "x"], ["abcd", "x"], ["", "yy"]]

    def refused(texts):
        seen.append("refused")
        raise models.Refused("400")

    with pytest.raises(models.Refused):
        models.Batched(refused, wait=0.01)(pd.Series(["a"]))
    assert seen.count("refused") == 1
    with pytest.raises(TimeoutError):
        models.Batched(lambda t: time.sleep(0.4), timeout=0.05, retries=1, wait=0.01)(pd.Series(["a"]))
    with pytest.raises(RuntimeError):
        models.Batched(lambda t: [], retries=0)(pd.Series(["a"]))


def _message(*fields):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return b"".join(varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v for k, v in fields)


def _lookup_model(table):
    """An ONNX file with one Gather of token rows: the smallest encoder there is."""
    tensor = _message((1, table.shape[0]), (1, table.shape[1]), (2, 1), (8, b"rows"), (9, table.astype("<f4").tobytes()))
    node = _message((1, b"rows"), (1, b"input_ids"), (2, b"hidden"), (4, b"Gather"))

    def value(name, kind, dims):
        shape = _message(*((1, _message((2, d))) for d in dims))
        return _message((1, name), (2, _message((1, _message((1, kind), (2, shape))))))

    graph_ = _message((1, node), (2, b"g"), (5, tensor), (11, value(b"input_ids", 7, [b"b", b"t"])), (12, value(b"hidden", 1, [b"b", b"t", b"d"])))
    return _message((1, 8), (7, graph_), (8, _message((1, b""), (2, 17))))


def test_model_in_the_worker(spark, tmp_path):
    from tokenizers import Tokenizer, models as kinds, pre_tokenizers

    vocabulary = {"[UNK]": 0, "red": 1, "blue": 2, "sea": 3}
    tokenizer = Tokenizer(kinds.WordLevel(vocabulary, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(f"{tmp_path}/t.json")
    table = np.array([[1, 1], [1, 0], [0, 2], [3, 4]], np.float32)
    (tmp_path / "m.onnx").write_bytes(_lookup_model(table))
    mean = models.LocalModel(f"{tmp_path}/m.onnx", f"{tmp_path}/t.json", batch=2)
    last = models.LocalModel(f"{tmp_path}/m.onnx", f"{tmp_path}/t.json", "last")
    texts = pd.Series(["red blue", "sea", "blue sea red sea"])
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    assert np.allclose(mean(texts)[0], unit(np.array([0.5, 1.0]))) and np.allclose(mean(texts)[2], unit((table[2] + 2 * table[3] + table[1]) / 4))
    assert np.allclose(last(texts)[2], unit(table[3])) and np.allclose(last(texts)[0], [0, 1])
    rows = spark.createDataFrame([("a", "red blue"), ("b", "sea")], "id string, embed_text string")
    got = {r.id: r.embedding for r in search.embed(rows, mean).collect()}
    assert np.allclose(got["b"], [0.6, 0.8])


SOURCES = [
    ("src/a.py", 1, "from .b import helper\n\ndef alpha():\n    return helper(1) + beta()\n\ndef beta():\n    return 2\n" + "# pad\n" * 10),
    ("src/b.py", 1, "def helper(x):\n    return print(x)\n\ndef unused_thing():\n    return 0\n" + "# pad\n" * 10),
    ("notes/n.md", 1, "# Title\nSee [[m]] and the helper function used in many places of the code base, which is long enough to stay.\n"),
    ("notes/m.md", 1, "# M\nAnother note with enough text to be kept as a chunk of its own in the index, really it has.\n"),
]


@pytest.fixture(scope="module")
def built(spark):
    return plan.build(spark.createDataFrame(SOURCES, "path string, mtime_ms long, content string"))


def test_runs_and_gates(spark, built):
    schema = "query string, paths array<string>, lines array<int>, tier string"
    golden = spark.createDataFrame([("helper", ["src/b.py"], [1, 2], "gate"), ("alpha", ["src/a.py"], None, "gate"), ("nowhere_at_all", ["x"], None, "hard")], schema)
    metrics, gate = evaluation.run_retrieval(built, golden)
    by = {r.tier: r for r in metrics.collect()}
    assert gate is None and by["gate"].recall_5 == 1.0 and by["gate"].sec_hit_5 == 1.0 and by["hard"].mrr == 0 and by["all"].n == 3
    raised = metrics.withColumn("recall_1", F.col("recall_1") + 0.5)
    bad = {(r.tier, r.metric) for r in evaluation.run_retrieval(built, golden, raised)[1].collect()}
    assert bad == {("all", "recall_1"), ("gate", "recall_1")}
    # One query at a time and all in one plan agree.
    asked = spark.createDataFrame([("helper",), ("how are notes kept",)], "query string").withColumn("query_id", F.col("query"))
    from strandline.plans import verbs

    vectors = [(q, verbs.embed_query(built, q)) for q in ("helper", "how are notes kept")]
    together = search.search_batch(built.chunks, built.postings, built.stats, asked, spark.createDataFrame(vectors, "query_id string, query_vector array<double>"), 3)
    for q, vector in vectors:
        alone = search.search(built.chunks, built.postings, built.stats, q, vector, 3)
        key = lambda r: (r["rank"], r["path"], r["lines"], r["score"], r["vec_rank"], r["fts_rank"])
        assert sorted(map(key, alone.collect())) == sorted(map(key, together.filter(F.col("query_id") == q).collect()))
    assert "snippet" not in search.compact(together).columns
    edges = spark.createDataFrame([("src/a.py", "helper", "calls", "src/b.py"), ("src/a.py", "beta", "calls", "src/a.py")], "from string, symbol string, kind string, to string")
    assert {r.tier: r.recall for r in evaluation.run_edges(built, edges)[0].collect()} == {"py": 1.0, "all": 1.0}
    dead = spark.createDataFrame([("src/b.py", "unused_thing", "likely_dead")], "path string, symbol string, expect string")
    assert evaluation.run_orphans(built, dead)[0].first().accuracy == 1.0
    abstain = spark.createDataFrame([("src/a.py", "helper", None)], "from_path string, symbol string, expect string")
    assert evaluation.run_disambiguation(built, abstain)[0].first().abstain == 1.0


def test_references_clusters_and_pages(spark):
    rows = [
        ("calls", "resolved", "x/a.ts", "5-5", "f", "x/b.ts", "g", "g", []), ("calls", "resolved", "x/a.ts", "9-9", "h", "x/b.ts", "k", "k", []),
        ("calls", "ambiguous", "x/a.ts", "9-9", "h", None, None, "m", ["y/c.ts", "y/d.ts"]), ("calls", "ambiguous", "x/b.ts", "2-2", "g", None, None, "m", ["y/c.ts"]),
    ]
    edges = spark.createDataFrame(rows, "kind string, conf string, from_path string, from_lines string, from_symbol string, to_path string, to_symbol string, ref_name string, candidates array<string>")
    refs, listed = graph.node_references(edges, file_level=True)
    assert {(r.node, r.path, r.line) for r in refs.collect()} >= {("x/b.ts", "x/a.ts", 5), ("x/b.ts", "x/a.ts", 9), ("amb:m", "x/b.ts", 2)}
    assert {(r.node, r.candidate) for r in listed.collect()} == {("amb:m", "y/c.ts"), ("amb:m", "y/d.ts")}
    nodes = spark.createDataFrame([("1", "b"), ("2", "b"), ("3", "a"), ("4", "c"), ("5", "d"), ("6", "e")], "node string, cluster string")
    grid = {r.cluster: (r.place, r.x, r.y) for r in graph.cluster_index(nodes, 1000).collect()}
    assert grid == {"b": (0, 125.0, 125.0), "a": (1, 375.0, 125.0), "c": (2, 625.0, 125.0), "d": (3, 125.0, 375.0), "e": (4, 375.0, 375.0)}
    drawn = nodes.select("node", F.col("node").alias("label"), F.lit(1).alias("degree"))
    assert json.loads(sinks.html_graph(drawn, drawn, "t").split("id=graph>")[1].split("</script>")[0])["nodes"][0]["degree"] == 1
    with pytest.raises(ValueError):
        sinks.html_graph(drawn, drawn, "t", most=3)


def test_sections_snippets_lines_and_reports(spark):
    notes = spark.createDataFrame([("intro\n\n## The Part ##\nbody  text\n",), ("no heading",), ("# A\n" + "w " * 300,)], "t string")
    got = [(r.s, r.b) for r in notes.select(text.section_of("t").alias("s"), text.body_snippet("t").alias("b")).collect()]
    assert got[:2] == [("The Part", "intro body text"), ("", "no heading")] and got[2][0] == "A" and len(got[2][1]) == 199
    listing = spark.createDataFrame([("a.py", "x\ny\n"), ("../b.py", "x"), ("/c.py", "x"), ("d.py", "z" * 50)], "path string, content string")
    assert {(r.file, r.loc) for r in files.lines_of_code(listing, 40).collect()} == {("a.py", 2)}
    found = spark.createDataFrame([("n", "f"), ("n", "g"), ("m", "h")], "note string, symbol string")
    assert crosslinks.report_for(found)[1].first().asDict() == {"stale_notes": 2, "stale_links": 3}
    assert crosslinks.report_for(found, "m")[1].first().asDict() == {"stale_notes": 1, "stale_links": 1}


def test_busy_sources_defer_the_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"ts":"2024-01-01T00:00:00","path":"a","event":"add"}\n')
    stream = spark.readStream.schema("ts timestamp, path string, event string").json(str(source))
    answers, seen = iter([True, True, False]), []
    done = watch.refresh_on_change(stream, lambda c, d: seen.append(c.count()), str(tmp_path / "cp"), busy=lambda: next(answers, False), once=True, poll=0.05)
    assert done.awaitTermination(60) and seen == [1]
    with pytest.raises(watch.Busy):
        watch.wait_until_free(lambda: True, poll=0.01, patience=0.03)


def test_meta_postings_and_edges_are_replaced_by_key(spark, tmp_path):
    root = f"{tmp_path}/meta"
    assert not tables.exists(spark, root)
    tables.write_meta(spark, {"a": "1", "b": "2"}, root)
    tables.write_meta(spark, {"a": "3"}, root)
    assert tables.exists(spark, root) and tables.read_meta(spark, root) == {"a": "3"}
    docs = lambda rows: spark.createDataFrame(rows, "id string, fts_text string")
    old, new = docs([("1", "a b a"), ("2", "b c"), ("3", "d")]), docs([("1", "a b a"), ("2", "c c e")])
    again = tables.refresh_postings(tables.postings(old), docs([("2", "c c e")]), docs([("3", "")]).select("id"))
    assert sorted(again.collect()) == sorted(tables.postings(new).collect())
    edges = spark.createDataFrame([("a", "x"), ("b", "y")], "from_path string, ref_name string")
    fresh = tables.upsert_edges(edges, spark.createDataFrame([("a", "z")], edges.schema), spark.createDataFrame([("a",), ("c",)], "path string"))
    assert sorted(fresh.collect()) == [("a", "z"), ("b", "y")]


def test_lexical_scores_with_and_without_postings(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(vocabulary, rng.integers(0, 30)))) for k in range(120)] + [(500, None), (501, "")], "id long, fts_text string")
    asked = spark.createDataFrame([(q, " ".join(rng.choice(vocabulary, 5))) for q in range(12)] + [(50, "none of these"), (51, "")], "query_id long, query string")
    scored = search.bm25(tables.postings(docs), tables.corpus_stats(docs.na.fill("")), search.query_terms(asked))
    want = search.ranked(scored.withColumn("score", text.floor_to("score", 6)), "score", "fts_rank", 7, ["query_id"])
    key = lambda df: sorted((r.query_id, r.fts_rank, r.id, r.score) for r in df.collect())
    assert key(search.bm25_top_batch(docs, asked, 7)) == key(want) != []
    monkeypatch.setattr(search, "MOST_CELLS", 60)
    assert key(search.bm25_top_batch(docs, asked, 7)) == key(want)


def test_many_query_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 6)).round(1)
    x[7] = x[8]
    rows = [(f"c{k:02}", v.tolist()) for k, v in enumerate(x)] + [("zero", [0.0] * 6), ("none", None), ("short", [1.0])]
    chunks = spark.createDataFrame(rows, "id string, embedding array<double>")
    asked = spark.createDataFrame([(f"c{k:02}", x[k].tolist()) for k in range(0, 90, 9)], "query_id string, query_vector array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = []
    for k in range(0, 90, 9):
        scores = {f"c{j:02}": np.floor(unit[j] @ unit[k] * 1e6 + 0.5) / 1e6 for j in range(90) if j != k} | {"zero": 0.0, "none": 0.0, "short": 0.0}
        want += [(f"c{k:02}", n + 1, i) for n, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:5])]
    for group_bytes in (16_000_000, 200):
        got = search.vector_top_batch(chunks, asked, 5, digits=6, skip_equal=True, group_bytes=group_bytes)
        assert sorted((r.query_id, r.vec_rank, r.id) for r in got.collect()) == sorted(want)
