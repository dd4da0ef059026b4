"""Large groups: no join makes a row for each pair of a call and a site, and the results are those of all pairs."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import crosslinks, extract, graph, resolve


def _join_rows(plan) -> int:
    """The most rows that a join of a plan that has run gave."""
    name = plan.nodeName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else []
    below = max((_join_rows(p) for p in [*inner, *(plan.children().apply(k) for k in range(plan.children().size()))]), default=0)
    made = plan.metrics().get("numOutputRows") if "Join" in name else None
    return max(below, made.get().value() if made is not None and made.isDefined() else 0)


def _run(df):
    rows = df.collect()
    return rows, _join_rows(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def calls(spark):
    return spark.range(2000).select(F.col("id").alias("call_id"), F.lit("T").alias("receiver_type"), F.when(F.col("id") % 2 == 0, "m").otherwise("one").alias("ref_name"))


@pytest.fixture(scope="module")
def methods(spark):
    many = spark.range(1000).select(F.lit("T").alias("type"), F.lit("m").alias("name"), F.lit("a.go").alias("path"), F.lpad(F.col("id").cast("string"), 5, "0").alias("lines"))
    return many.union(spark.createDataFrame([("T", "one", "b.go", "7")], many.schema)).localCheckpoint()


def test_typed_methods_with_one_definition(calls, methods):
    rows, most = _run(resolve.typed_methods(calls, methods))
    assert {(r.call_id, r.to_path, r.to_lines) for r in rows} == {(k, "b.go", "7") for k in range(1, 2000, 2)} and most <= 4000


def test_calls_that_share_an_id_are_counted_together(spark, methods):
    calls = spark.createDataFrame([(1, "T", "one"), (1, "T", "m"), (2, "T", "one"), (3, None, "one")], "call_id long, receiver_type string, ref_name string")
    assert [tuple(r)[:3] for r in resolve.typed_methods(calls, methods).collect()] == [(2, "b.go", "7")]
    assert [tuple(r)[:3] for r in resolve.typed_methods(calls, methods, distinct_paths=True).collect()] == [(2, "b.go", "7")]


def test_typed_methods_with_one_path(calls, methods):
    rows, most = _run(resolve.typed_methods(calls, methods, distinct_paths=True))
    assert {(r.call_id, r.to_path, r.to_lines) for r in rows} == {(k, *(("b.go", "7") if k % 2 else ("a.go", "00000"))) for k in range(2000)} and most <= 4000


def test_classes_and_methods_of_one_file(calls, methods):
    classes = methods.select("type", F.lit("a.go").alias("path"))
    rows, most = _run(resolve.class_files(calls, classes, methods.select("name", "path", "lines")))
    assert {tuple(r)[:3] for r in rows} == {(k, "a.go", "00000") for k in range(0, 2000, 2)} and most <= 4000


def test_calls_carry_no_sites_but_their_candidates(spark):
    found = spark.range(400).select(F.col("id").alias("call_id"), F.lit("a.ts").alias("from_path"), F.when(F.col("id") % 2 == 0, "m").otherwise("n").alias("ref_name"), F.lit(None).cast("string").alias("local_target"))
    defs = spark.range(900).select(F.lit("m").alias("name"), F.when(F.col("id") < 600, "a.ts").otherwise("b.ts").alias("path"), F.lpad(F.col("id").cast("string"), 4, "0").alias("lines"))
    defs = defs.union(spark.createDataFrame([("n", "a.ts", "7")], defs.schema))
    df = resolve.resolve_calls(found, defs, spark.createDataFrame([("a.ts", "x", "b")], "from_path string, name string, stem string"))
    assert "sites" not in [f for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line for f in line.split()]
    assert {(r.ref_name, r.conf, r.to_path, r.to_lines, tuple(r.candidates)) for r in df.collect()} == {("m", "ambiguous", None, None, ("a.ts", "b.ts")), ("n", "resolved", "a.ts", "7", ())}
    bare = resolve.resolve_calls(found, defs, spark.createDataFrame([("a.ts", "m", "b")], "from_path string, name string, stem string"), listed=False)
    assert {(r.ref_name, r.conf, r.to_path, r.to_lines, len(r.candidates)) for r in bare.collect()} == {("m", "resolved", "b.ts", "0600", 0), ("n", "resolved", "a.ts", "7", 0)}


def test_notes_meet_the_best_sites_of_a_name(spark):
    notes = spark.range(300).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("path"), F.lit("fnName fnName other").alias("text"))
    sites = spark.range(1000).select(F.lit("fnName").alias("name"), F.concat(F.lit("m"), (F.col("id") % 30 + 10).cast("string")).alias("path"), F.col("id").alias("line_start"), F.col("id").alias("line_end"), F.lit("x").alias("text"))
    rows, most = _run(crosslinks.code_links(notes, sites, spark.createDataFrame([], "path string, text string"), cap=4))
    assert {(r.path, r.symbol, r.lines) for r in rows} == {(f"m{k + 10}", "fnName", min(f"{i}-{i}" for i in range(k, 1000, 30))) for k in range(4)}
    assert len(rows) == 1200 and most <= 1200


def test_chunks_meet_the_first_neighbours_of_a_symbol(spark):
    chunks = spark.range(300).select(F.col("id").alias("id"), F.lit("a").alias("path"), F.array(F.lit("f"), F.lit("g")).alias("symbols"))
    links = spark.range(1000).select(F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("src"), F.when(F.col("id") % 2 == 0, "a#f").otherwise("a#g").alias("dst"), F.lit("calls").alias("kind"))
    rows, most = _run(graph.context_for(chunks, links, 3))
    assert len(rows) == 300 and all(r.callers == ["s0000", "s0001", "s0002"] and r.callees is None for r in rows) and most <= 2400


def test_an_index_build_lists_candidates_last(spark, monkeypatch):
    from strandline.params import Params
    from strandline.plans import index

    held, resolve_calls = [], resolve.resolve_calls

    def spy(*args, **options):
        found = resolve_calls(*args, **options)
        held.append(found.agg(F.sum(F.size("candidates"))).first()[0])
        return found

    monkeypatch.setattr(resolve, "resolve_calls", spy)
    go = "package io\n\nfunc Read(p int) int {\n\treturn p\n}\n\nfunc use(x any) {\n\tx.Read(1)\n}\n"
    files = spark.createDataFrame([(f"io/f{k}.go", 1, go) for k in range(3)], "path string, mtime_ms long, content string")
    edges = index.build(files, params=Params(disambiguate=False)).edges.filter("ref_name = 'Read' AND conf = 'ambiguous'").collect()
    assert held == [0] and edges and all(r.candidates == [f"io/f{k}.go" for k in range(3)] for r in edges)


def test_links_outside_fences_without_a_shuffle(spark):
    text = "[[a]]\n \t~~~ x\n[[no]]\n\n```\r\n![[b|B]] and [[c#h]]\n~ ~~~\n```\n[[no]]\u2028```\n[[no]]"
    notes = spark.createDataFrame([("p", text), ("p", "```\n```\n[[d]]"), ("q", None)], "path string, content string")
    found = extract.wikilinks(notes)
    assert sorted(tuple(r) for r in found.collect()) == [("embeds", "p", 6, "b"), ("links", "p", 1, "a"), ("links", "p", 3, "d"), ("links", "p", 6, "c")]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_list_of_candidates_is_stored_once_a_task(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(resolve, "LISTED_BYTES", 4_000_000, raising=False)
    name = F.concat(F.lit("d"), F.sha1(F.col("id").cast("string")), F.lit("/N"), (F.col("id") % 20).cast("string"), F.lit(".md"))
    notes = spark.range(40_000).select(name.alias("path"))
    links = spark.range(800).select(F.col("id").cast("string").alias("from_path"), F.concat(F.lit("n"), (F.col("id") % 21).cast("string")).alias("target"))
    done = resolve.resolve_wikilinks(links, notes, joined=",")
    done.write.parquet(f"{tmp_path}/out")
    kept = spark.read.parquet(f"{tmp_path}/out")
    paths = {f"n{k}": ",".join(sorted(r.path for r in notes.filter(F.col("path").endswith(f"/N{k}.md")).collect())) for k in (0, 19)}
    rows = {r.from_path: r for r in kept.filter("target IN ('n0', 'n19', 'n20')").collect()}
    assert kept.count() == 800 and all(r.candidates == paths.get(r.target, "") and r.conf == ("external" if r.target == "n20" else "ambiguous") for r in rows.values())
    assert kept.agg(F.sum(F.length("candidates"))).first()[0] > 70_000_000 > 5 * sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    listed = resolve.resolve_wikilinks(links.limit(3), notes).collect()
    assert all(",".join(r.candidates) == rows[r.from_path].candidates for r in listed if r.target in paths)


def _shuffled(plan) -> int:
    """The most rows that a shuffle of a plan that has run wrote."""
    name = plan.nodeName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else []
    below = max((_shuffled(p) for p in [*inner, *(plan.children().apply(k) for k in range(plan.children().size()))]), default=0)
    made = plan.metrics().get("shuffleRecordsWritten")
    return max(below, made.get().value() if made.isDefined() else 0)


@pytest.mark.parametrize("distinct_paths", [False, True])
def test_calls_of_many_paths_are_not_shuffled(spark, calls, distinct_paths):
    methods = spark.createDataFrame([("T", "m", "a.go", "1"), ("T", "m", "b.go", "2"), ("T", "one", "b.go", "7")], "type string, name string, path string, lines string")
    few = calls.filter("ref_name = 'm'").union(spark.createDataFrame([(1, "T", "one"), (2, "T", "one"), (None, "T", "one")], "call_id long, receiver_type string, ref_name string"))
    found = resolve.typed_methods(few, methods, distinct_paths=distinct_paths)
    assert {(r.call_id, r.to_path, r.to_lines) for r in found.collect()} == {(1, "b.go", "7"), (None, "b.go", "7")}
    assert _shuffled(found._jdf.queryExecution().executedPlan()) <= 10
