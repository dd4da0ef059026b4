"""Receiver-type tiers from source text to edges, declared names, and refreshes that look at changed files only."""

import pytest
from pyspark.sql import functions as F

from strandline.functions import predicates, symbols
from strandline.operators import extract
from strandline.plans import index as plan

PAD = "// " + "padding " * 20 + "\n"
SOURCES = {
    "io/file.go": "package io\n\nfunc (f *File) Read(p []byte) (n int, err error) {\n\treturn f.inner(p), nil\n}\n\nfunc (f *File) inner(p []byte) int {\n\treturn 1\n}\n",
    "io/types.go": "package io\n\ntype Reader interface {\n\tRead(p []byte) (int, error)\n}\n\ntype File struct {\n\tname string\n}\n",
    "io/sock.go": "package io\n\nfunc (s *Sock) Read(p []byte) (n int, err error) {\n\treturn 2, nil\n}\n\nfunc (s *Sock) inner(p []byte) int {\n\treturn 3\n}\n",
    "cmd/main.go": "package main\n\nfunc use(r Reader, f *File) {\n\tr.Read(nil)\n\tf.inner(nil)\n\tvar s Sock\n\ts.Read(nil)\n}\n",
    "ui/shape.ts": PAD + "export interface Shape { area(): number }\n" + PAD,
    "ui/circle.ts": PAD + "export class Circle implements Shape {\n  area(): number { return 1; }\n  spin(): number { return 2; }\n}\n",
    "ui/square.ts": PAD + "export class Square implements Shape {\n  area(): number { return 3; }\n  spin(): number { return 4; }\n}\n",
    "ui/app.ts": PAD + "const api = { run() { return 1; }, stop: () => 2 };\nexport function start(s: Shape, c: Circle) {\n  s.area();\n  c.spin();\n  api.run();\n}\n",
    "eng/base.h": PAD + "class Base {\n public:\n  virtual void tick() { }\n  void halt() { }\n};\n",
    "eng/kid.h": PAD + "class Kid : public Base {\n public:\n  void tick() override { }\n  void halt() { }\n};\n",
    "eng/own.h": PAD + "class Owner {\n  std::unique_ptr<Base> base_;\n  Kid kid_;\n  void go() { base_->tick(); kid_.halt(); }\n};\n",
    "eng/make.cpp": PAD + "Kid* makeKid(int a) { return new Kid(); }\nvoid play() { auto k = makeKid(1); k->halt(); }\n",
}


def frame(spark, sources, time=1):
    return spark.createDataFrame([(p, time, t) for p, t in sources.items()], "path string, mtime_ms long, content string")


@pytest.fixture(scope="module")
def built(spark):
    return plan.build(frame(spark, SOURCES))


def calls(index):
    rows = index.edges.filter("kind = 'calls'").select("from_path", "from_symbol", "ref_name", "from_lines", "conf", "to_path", "candidates").collect()
    return {(r.from_path, r.from_symbol, r.ref_name, int(r.from_lines)): (r.conf, r.to_path, r.candidates) for r in rows}


def test_tiers_fire_on_source_text(built):
    got = calls(built)
    assert got["cmd/main.go", "use", "Read", 4] == ("dispatch", None, ["io/file.go", "io/sock.go"])
    assert got["cmd/main.go", "use", "inner", 5][:2] == ("resolved", "io/file.go")
    assert got["cmd/main.go", "use", "Read", 7][:2] == ("resolved", "io/sock.go")
    assert got["io/file.go", "Read", "inner", 4][:2] == ("resolved", "io/file.go")
    assert got["ui/app.ts", "start", "area", 4] == ("dispatch", None, ["ui/circle.ts", "ui/square.ts"])
    assert got["ui/app.ts", "start", "spin", 5][:2] == ("resolved", "ui/circle.ts")
    assert got["ui/app.ts", "start", "run", 6][:2] == ("resolved", "ui/app.ts")
    assert got["eng/own.h", "go", "tick", 5] == ("dispatch", None, ["eng/base.h", "eng/kid.h"])
    assert got["eng/own.h", "go", "halt", 5][:2] == ("resolved", "eng/kid.h")
    assert got["eng/make.cpp", "play", "halt", 3][:2] == ("resolved", "eng/kid.h")


def test_refresh_scans_changed_files_only_and_equals_a_rebuild(spark, built):
    changed = dict(SOURCES, **{"ui/circle.ts": SOURCES["ui/circle.ts"].replace("spin", "turn"), "eng/kid.h": SOURCES["eng/kid.h"].replace(" override", "")})
    del changed["io/sock.go"]
    rows = [(p, 2 if SOURCES[p] != t else 1, t) for p, t in changed.items()]
    files = spark.createDataFrame(rows, "path string, mtime_ms long, content string")
    again, fresh = plan.build(files, built), plan.build(files)
    assert again.counters["extracted"] == 2 and again.counters["evicted"] == 1 and calls(again) == calls(fresh)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(again.postings) == key(fresh.postings.select(*again.postings.columns))
    assert calls(again)["cmd/main.go", "use", "Read", 4] == ("dispatch", None, ["io/file.go"])
    # A targeted refresh of one path leaves the other changes for later.
    one = plan.refresh(files, built, spark.createDataFrame([("eng/kid.h",)], "path string"))
    assert one.counters["extracted"] == 1 and one.counters["evicted"] == 0
    assert ("ui/app.ts", "start", "spin", 5) in calls(one) and calls(one)["ui/app.ts", "start", "spin", 5][:2] == ("resolved", "ui/circle.ts")


def test_long_spans_lose_no_names(spark):
    wide = " " * 400
    cpp = f"class {wide} Kid : public {wide} Base {{\n virtual {wide} void{wide}run(int a);\n void stop({'int x, ' * 100}int y) override;\n std::map<int, {'long ' * 60}> table_;\n}};\n"
    facts = {(f["fact"], f["owner"], f["name"]) for f in extract.type_facts("k.h", "cpp", cpp)}
    assert {("base", "Kid", "Base"), ("virtual", "Kid", "run"), ("override", "Kid", "stop"), ("field", "Kid", "table_")} <= facts
    texts = [f"const f{wide}:{wide}Map<string, {'number | ' * 90}string>{wide}= async ({'a, ' * 120}b) => b", f"auto long{'er' * 300}(int q){wide}-> std::vector<{'int, ' * 90}int>{wide}{{ }}"]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(symbols.declared_callables("t").alias("n")).collect()]
    assert got == [["f"], ["long" + "er" * 300]]


def test_declared_names_and_predicates(spark):
    texts = {
        "function a(x) { return 1; }\nclass  B extends C {\n  m() { a(1); }\n}": (["a", "B", "m"], ["a", "B", "m"]),
        "const f = async (x: number): string => x; let g = 3; var h = function () {}; const k: T = y => y": (["f", "g", "h", "k"], ["f", "h", "k"]),
        "void Cache::write(int a) const {\n if (x) { y(); }\n}\nCache::Cache(int a) : a_(a), b_(f(a)) {\n}\nint proto(int);": (["write", "Cache"], ["write", "Cache"]),
        "export function* gen() {}\nsubclass Foo": (["gen"], ["gen"]),
        "arr.forEach(function (a) { for (int i = 0; i < 3; i++) { go(i); } })": ([], []),
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", symbols.declared_symbols("t").alias("s"), symbols.declared_callables("t").alias("c"))
    for r in df.collect():
        if "forEach" not in r.t:
            assert (r.s, r.c) == texts[r.t]
    paths = {"src/a.test.ts": True, "a/testing.py": False, "src/spec.rb": True, "a/b.spec.": False, "Test/x.js": True, "a\\e2e\\y.c": True, "contest.py": False, "x-spec.js": True}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", predicates.is_test_path(F.col("p")).alias("t")).collect()
    assert {r.p: r.t for r in got} == paths
