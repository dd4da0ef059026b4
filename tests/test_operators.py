"""Invariants and literal fixtures of operators that tables cannot show."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.functions.predicates import entrypoint_reason, ignored
from strandline.operators import chunking, communities, crosslinks, evaluate, extract, gitmetrics, graph, resolve, search
from strandline.params import Params
from strandline.plans import index as plan
from strandline.plans import verbs
from strandline.sources import files, sinks, tables
from strandline.streaming import watch


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_windows_carry_a_proper_suffix():
    p = Params(max_chars=40, min_chars=5, overlap_chars=15)
    content = "".join(f"line number {k}\n" for k in range(10))
    found = chunking.windows("a.txt", "txt", content, p)
    assert found[0]["line_start"] == 1 and found[-1]["line_end"] == 10
    for a, b in zip(found, found[1:]):
        assert a["line_start"] < b["line_start"] <= a["line_end"] + 1
    single = chunking.windows("b.txt", "txt", "x" * 200, p)
    assert len(single) == 1


def test_markdown_sections_and_front_matter():
    content = "---\ntitle: Guide\ntags: [a, b]\n---\n# One\ntext\n```\n# not a heading\n```\n## Two\nmore\n# Three\n"
    meta, _ = chunking.front_matter(content)
    assert meta == {"title": "Guide", "tags": ["a", "b"]}
    found = chunking.markdown("g.md", content)
    assert [c["scope"] for c in found] == [["Guide", "One"], ["Guide", "One", "Two"]]


def test_code_units():
    js = "export function a(x) { return '}'; }\nclass B {\n  m() { a(1); }\n}\n"
    assert [u[2] for u in chunking.units("javascript", js)] == ["a", "B"]
    assert [u[2] for u in chunking.units("python", "def f():\n  pass\n\nclass G:\n  pass\n")] == ["f", "G"]


def test_front_matter_and_sections(spark):
    df = spark.createDataFrame([("---\na: 1\n---\nbody",), ("body",)], "t string")
    out = [r[0] for r in df.select(text.front_matter_set("t", "a", F.lit("$2"))).collect()]
    assert out == ["---\na: $2\n---\nbody", "---\na: $2\n---\nbody"]
    once = df.select(text.upsert_section("t", "<!-- b -->", "<!-- e -->", F.lit("x")).alias("t"))
    twice = once.select(text.upsert_section("t", "<!-- b -->", "<!-- e -->", F.lit("y")).alias("t"))
    assert [r[0].count("<!-- b -->") for r in twice.collect()] == [1, 1]
    assert all("<!--" not in r[0] for r in twice.select(text.remove_section("t", "<!-- b -->", "<!-- e -->")).collect())


def test_gitignore(spark):
    df = spark.createDataFrame([("build/x.js",), ("src/a.log",), ("src/keep.log",), ("docs/a/b.md",)], "path string")
    out = dict(rows(df.select("path", ignored(F.col("path"), ["build/", "*.log", "!keep.log", "/docs/**/b.md"]))))
    assert out == {"build/x.js": True, "src/a.log": True, "src/keep.log": False, "docs/a/b.md": True}


def test_entrypoints(spark):
    data = [("bin/x.js", "f", ""), ("a.js", "handler", ""), ("a.js", "onClick", ""), ("a.js", "g", "export function g() {"), ("a.go", "Public", ""), ("a.js", "h", "function h() {"), ("tests/a.js", "h", "")]
    df = spark.createDataFrame(data, "path string, name string, text string")
    got = [r[0] for r in df.select(entrypoint_reason(F.col("path"), F.col("name"), F.col("text"))).collect()]
    assert got == ["entry file", "entry/handler name", "entry/handler name", "exported", "go exported", None, "test path"]


def test_bfs_against_python(spark):
    rng = random.Random(4)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(70)}
    links = spark.createDataFrame([(f"n{a:02}", f"n{b:02}", "calls", "resolved") for a, b in edges], "src string, dst string, kind string, conf string")
    want, frontier = {"n00": 0}, ["n00"]
    for depth in range(1, 5):
        frontier = [y for y in sorted({f"n{b:02}" for a, b in edges for x in frontier if x == f"n{a:02}"}) if y not in want]
        want.update(dict.fromkeys(frontier, depth))
    got = dict(rows(graph.bfs(links, spark.createDataFrame([("n00",)], "node string"), 4)))
    assert got == want


def test_cycles_and_example(spark):
    links = spark.createDataFrame([(a, b, "calls", "resolved") for a, b in ["ab", "bc", "ca", "cd", "dd", "de", "ed"]], "src string, dst string, kind string, conf string")
    found = rows(graph.cycles(links).select("size", F.array_join("members", "")))
    assert found == [(2, "de"), (3, "abc")]
    assert graph.example_cycle(links, ["a", "b", "c"]).first()["path"] == ["a", "b", "c", "a"]
    assert rows(graph.self_loops(links)) == [("calls", 1)]


def test_edges_to_links(spark):
    data = [
        ("calls", "resolved", "a", "f", "b", "g", "g", []), ("calls", "dispatch", "a", None, None, None, "h", ["c", "d"]),
        ("calls", "ambiguous", "a", "f", None, None, "k", ["e"]), ("calls", "external", "a", "f", None, None, "z", []), ("imports", "resolved", "a", None, "b", None, "b", []),
    ]
    schema = "kind string, conf string, from_path string, from_symbol string, to_path string, to_symbol string, ref_name string, candidates array<string>"
    edges = spark.createDataFrame(data, schema)
    base = {("a#f", "b#g"), ("a", "c#h"), ("a", "d#h"), ("a", "b")}
    assert {r[:2] for r in rows(graph.build_links(edges))} == base
    assert {r[:2] for r in rows(graph.build_links(edges, True))} == base | {("a#f", "e#k")}
    assert rows(graph.external_sources(edges)) == [("a#f",)]


def test_leiden_invariants(spark):
    triangles = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("d", "f", 1.0), ("c", "d", 1.0)]
    found = communities.leiden(triangles)
    assert len(set(found.values())) == 2 and found["a"] == found["c"] != found["d"]
    assert communities.leiden([]) == {}
    assert len(set(communities.leiden([("a", "b", 1.0), ("c", "d", 1.0)]).values())) == 2
    adj = spark.createDataFrame(triangles, "a string, b string, w double")
    members = communities.detect(adj)
    parts = communities.report(adj, members)
    assert parts["bridges"].count() == 1
    assert parts["modularity"].first()["q"] == pytest.approx(0.357)
    spread = communities.propagate(adj)
    assert spread.count() == 6


def test_cochange_rules(spark):
    commits = [("1", ["a", "b", "a"]), ("2", ["b", "a"]), ("3", ["a", "b"]), ("4", ["a", "c"]), ("5", [f"f{k}" for k in range(26)])]
    pairs = gitmetrics.commit_files(spark.createDataFrame(commits, "hash string, files array<string>"))
    edges = spark.createDataFrame([("b", "a")], "a string, b string")
    assert rows(gitmetrics.cochange(pairs, edges)) == [("a", "b", 3, 1.0, True)]
    assert gitmetrics.skipped_commits(pairs).first()[0] == 1


def test_disambiguate(spark):
    calls = spark.createDataFrame([(1, "a.ts", "go", False, "h1", ["x.ts", "y.ts"]), (2, "a.ts", "get", True, "h1", ["x.ts"])], "call_id int, from_path string, ref_name string, is_method boolean, content_hash string, candidates array<string>")
    defs = spark.createDataFrame([("go", "x.ts", [1.0, 0.0], "h2"), ("go", "y.ts", [0.0, 1.0], "h3"), ("get", "x.ts", [1.0, 0.0], "h4")], "name string, path string, embedding array<float>, content_hash string")
    sites = spark.createDataFrame([("h1", [1.0, 0.1])], "content_hash string, embedding array<float>")
    assert [r[:2] for r in rows(resolve.disambiguate(calls, defs, sites))] == [(1, "x.ts")]
    imports = spark.createDataFrame([("a.ts", "y")], "from_path string, stem string")
    assert rows(resolve.disambiguate(calls, defs, sites, imports)) == []


def test_dispatch_and_fields(spark):
    methods = spark.createDataFrame([("Base", "run", "b.h", "1-2", True, False), ("Kid", "run", "k.h", "1-2", False, True)], "type string, name string, path string, lines string, is_virtual boolean, is_override boolean")
    ancestors = spark.createDataFrame([("Kid", "Base", 1)], "name string, base string, depth int")
    calls = spark.createDataFrame([(1, "m.cpp", "run", "ambiguous", None, None, None, ["b.h", "k.h"], "p", None, "Owner")], "call_id int, from_path string, ref_name string, conf string, to_path string, to_lines string, to_symbol string, candidates array<string>, receiver string, receiver_type string, enclosing_class string")
    fields = spark.createDataFrame([("Owner", "p", "Base")], "class string, field string, type string")
    typed = resolve.field_receivers(calls, fields, ancestors)
    assert typed.first()["receiver_type"] == "Base"
    done = resolve.upgrade(typed, resolve.virtual_dispatch(typed, ancestors, methods), "dispatch").first()
    assert done["conf"] == "dispatch" and done["candidates"] == ["b.h", "k.h"]
    one = resolve.upgrade(typed, resolve.typed_methods(typed, methods), "resolved").first()
    assert (one["conf"], one["to_path"], one["to_symbol"]) == ("resolved", "b.h", "run")


def test_type_facts():
    cpp = "class Kid : public Base {\n  std::unique_ptr<Engine> engine_;\n  void run() override { engine_->go(); }\n  virtual void stop();\n};\n"
    facts = {(f["fact"], f["owner"], f["name"], f["detail"]) for f in extract.type_facts("k.h", "cpp", cpp)}
    assert {("base", "Kid", "Base", None), ("field", "Kid", "engine_", "Engine"), ("override", "Kid", "run", None), ("virtual", "Kid", "stop", None)} <= facts
    go = "type R interface {\n Read()\n}\nfunc (f *File) Read() {}\n"
    assert {(f["fact"], f["owner"], f["name"]) for f in extract.type_facts("f.go", "go", go)} == {("interface", "R", "Read"), ("method", "File", "Read")}


def test_drift_and_mutes(spark):
    schema = "note string, kind string, symbol string, path string, lines string, text string"
    old = spark.createDataFrame([("n", "symbol", "f", "a", "1-2", "f() { x }"), ("n", "symbol", "g", "a", "3-4", "g() { x }"), ("n", "file", None, "gone", None, "t"), ("n", "symbol", "same", "a", "1", "s() {}")], schema)
    new = spark.createDataFrame([("n", "symbol", "f", "a", "1-2", "f() { y }"), ("n", "symbol", "g", "b", "3-4", "g(z) { x }"), ("n", "symbol", "same", "a", "9", "s() {} // note")], schema)
    base, now = crosslinks.snapshot(old), crosslinks.snapshot(new)
    got = {(r["symbol"], r["grade"], r["severity"]) for r in crosslinks.drift(base, now).collect()}
    assert got == {("f", "body", "medium"), ("g", "signature", "high"), (None, "removed", "high")}
    muted = spark.createDataFrame([("n", "f")], "note string, symbol string")
    assert {r["symbol"] for r in crosslinks.drift(base, now, muted).collect()} == {"g", None}
    kept, flagged = crosslinks.sync(base, now)
    assert {r["grade"] for r in flagged.collect()} == {"body", "removed"} and kept.filter("symbol = 'g'").first()["path"] == "b"


def test_gates_and_grid(spark):
    now = spark.createDataFrame([("all", 0.90, 0.8), ("gate", 0.95, None)], "tier string, recall_1 double, mrr double")
    was = spark.createDataFrame([("all", 0.93, 0.8), ("gate", 0.95, 0.9)], "tier string, recall_1 double, mrr double")
    bad = rows(evaluate.compare_baseline(now, was).filter("regressed").select("tier", "metric"))
    assert bad == [("all", "recall_1")]
    assert evaluate.parse_grid("a=1,2;b=0.5") == [{"a": 1.0, "b": 0.5}, {"a": 2.0, "b": 0.5}]
    with pytest.raises(ValueError):
        evaluate.parse_grid("a=")


def test_scip_round_trip(tmp_path, spark):
    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    occurrence = field(1, bytes([4, 0, 3])) + field(2, b"pkg A#run().") + bytes([3 << 3, 1])
    document = field(1, b"a.ts") + field(2, occurrence)
    (tmp_path / "i.scip").write_bytes(field(2, document))
    found = files.read_scip(spark, str(tmp_path / "i.scip"))
    assert found.first().asDict() == {"path": "a.ts", "range": [4, 0, 3], "symbol": "pkg A#run().", "roles": 1}
    definitions, _ = files.scip_facts(found)
    assert rows(definitions) == [("pkg A#run().", "a.ts", 5)]


def test_version_pointer(tmp_path, spark):
    root = str(tmp_path / "base")
    sinks.write_version(spark.range(3).toDF("a"), root)
    sinks.write_version(spark.range(5).toDF("a"), root)
    assert sinks.read_version(spark, root).count() == 5


FILES = [
    ("src/a.py", 1, "from .b import helper\n\ndef alpha():\n    return helper(1) + beta()\n\ndef beta():\n    return 2\n" + "# pad\n" * 10),
    ("src/b.py", 1, "def helper(x):\n    return print(x)\n\ndef unused_thing():\n    return 0\n" + "# pad\n" * 10),
    ("notes/n.md", 1, "# Title\nSee [[m]] and src/b.py and the helper function used in many places of the code base, which is long enough.\n"),
    ("notes/m.md", 1, "# M\nAnother note with enough text to be kept as a chunk of its own in the index, really it has.\n"),
]


def frame(spark, data):
    return spark.createDataFrame(data, "path string, mtime_ms long, content string")


def test_index_refresh_equals_rebuild(spark):
    first = plan.build(frame(spark, FILES))
    assert first.counters["embedded"] == first.counters["chunks"]
    changed = [("src/b.py", 2, FILES[1][2].replace("unused_thing", "fresh_thing")), *FILES[:1], *FILES[2:3]]
    again = plan.build(frame(spark, changed), first)
    assert again.counters["skipped"] == 2 and again.counters["evicted"] == 1
    fresh = plan.build(frame(spark, changed))
    columns = ["kind", "conf", "from_path", "from_symbol", "to_path", "ref_name"]
    key = lambda i: sorted(map(str, i.edges.select(columns).collect()))
    assert key(again) == key(fresh)
    assert sorted(r["id"] for r in again.chunks.select("id").collect()) == sorted(r["id"] for r in fresh.chunks.select("id").collect())


def test_verbs(spark):
    index = plan.build(frame(spark, FILES))
    assert verbs.search(index, "helper", 3).first()["path"].startswith("src/")
    assert {r["from_symbol"] for r in verbs.callers(index, "helper").collect()} == {"alpha"}
    assert rows(verbs.impact(index, "helper").select("node")) == [("src/a.py#alpha",)]
    assert verbs.path_between(index, "alpha", "helper").first()["path"] == ["src/a.py#alpha", "src/b.py#helper"]
    assert "unused_thing" in {r["name"] for r in verbs.orphans(index).filter("class = 'likely_dead'").collect()}
    assert [r["from_path"] for r in verbs.backlinks(index, "notes/m.md").collect()] == ["notes/n.md"]
    assert verbs.outline(index, "src/a.py").count() >= 1
    assert verbs.cycles(index).count() == 0
    nodes, edges = verbs.graph_view(index, focus="helper")
    assert nodes.count() >= 2 and edges.count() >= 1
    assert verbs.connections(index, "notes/n.md").first()["path"] == "notes/m.md"
    links = verbs.code_links(index, index)
    assert {r["note"] for r in verbs.notes_for(links, index, "src/b.py").collect()} >= {"notes/n.md"}
    assert plan.status(index, 60_001).first()["files"] == 4
    assert verbs.similar(index, "src/a.py", 1, 2).count() == 2
    assert verbs.find(index, "helper").first()["path"] == "src/b.py"
    assert verbs.context(index, targets=["src/a.py:1"]).first()["confidence"] == "high"
    with pytest.raises(KeyError):
        verbs.impact(index, "nothing_here")


def test_walk(tmp_path, spark):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/b.js").write_text("x")
    (tmp_path / "c.png").write_bytes(b"1")
    assert [r["path"] for r in files.walk(spark, str(tmp_path)).collect()] == ["src/a.py"]
    listing = files.walk(spark, str(tmp_path))
    wanted = spark.createDataFrame([("src/a.py",), ("gone.py",), ("node_modules/b.js",)], "path string")
    found, missing = files.stat_paths(listing, wanted)
    assert found.count() == 1 and rows(missing) == [("gone.py",)]


def test_refresh_stream(tmp_path, spark):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"ts":"2024-01-01T00:00:00","path":"a","event":"add"}\n{"ts":"2024-01-01T00:00:01","path":"a","event":"unlink"}\n{"ts":"2024-01-01T00:00:01","path":"b","event":"change"}\n')
    stream = spark.readStream.schema("ts timestamp, path string, event string").json(str(source))
    seen = []
    done = watch.refresh_on_change(stream, lambda c, d: seen.append((rows(c), rows(d))), str(tmp_path / "cp"), once=True)
    done.awaitTermination(60)
    assert seen == [([("b",)], [("a",)])]
    batches = watch.change_batches(spark.read.schema("ts timestamp, path string, event string").json(str(source)), "30 seconds")
    assert batches.first()["paths"] == ["a", "b"]


def test_search_helpers():
    assert search.clamp_k(0) == 8 and search.clamp_k("12") == 12 and search.clamp_k(99) == 50 and search.clamp_k(None) == 8
    assert search.fanout(8) == 24 and search.fanout(2) == 16 and search.fanout(30) == 50
    assert tables.shared_folder.__doc__
