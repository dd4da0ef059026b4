"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from strandline.llm import ann, dedup, licenses, mixing, packing, quality, rules, sharding, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, bucket string, size int, root string, score double"


def prose(k, n=60):
    rng = np.random.default_rng(k)
    return " ".join(rng.choice(WORDS, n)) + f" mark{k}"


def table():
    rows = [(k, prose(k), "en", f"s{k % 3}") for k in range(40)]
    rows += [(100, prose(1), "en", "s1"), (101, prose(2).replace("mark2", "other"), "en", None), (102, None, "en", "s0"), (103, "", None, "s0")]
    rows += [(104, "x " * 5000, "en", "s9"), (None, prose(50), "en", "s1"), (None, None, None, None), (105, "one", "en", "s2")]
    rows += [(7, prose(7), "en", "s1")] * 2
    return [(*r, None, 1, "b", 2, "r", 0.5) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(t):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def classes(texts):
    bags = [bag(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = bags[i], bags[j]
            n, m = sum(a.values()), sum(b.values())
            common = sum((a & b).values())
            if (not n and not m) or (n + m and common >= 0.8 * (n + m - common) and common):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def test_near_duplicates_equal_brute_force(docs, none):
    rows = table()
    got = dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(set(classes([r[1] for r in rows])))
    label = classes([r[1] for r in rows])
    least = {}
    for r, c in zip(rows, label, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = sorted((str(r[0]), str(least.get(c))) for r, c in zip(rows, label, strict=True))
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in got) == want
    assert dedup.near_duplicates(none).count() == 0
    kept = dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label))


def test_a_chain_of_links_is_one_class(spark):
    """Neighbours are linked, ends are not: a class needs links between texts that are no centres."""
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(words[12 * k : 12 * k + 150])) for k in range(10)]
    got = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0}


def test_rules(docs, none):
    got = rules.apply_rules(docs)
    assert got.count() == len(table()) and rules.apply_rules(none).count() == 0
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[102]["n_words"] == 0 and by[102]["base_failed"] and not by[102]["kept"]
    assert by[104]["base_failed"] and by[0]["kept"]
    hosts = rules.host_verdicts(rules.document_counts(docs)).collect()
    assert {h["host"] for h in hosts} == {"s0", "s1", "s2", "s9", None}
    assert all(min(h["rate"], 0.3) <= h["shrunk_rate"] + 0.3 for h in hosts)


def test_a_bad_host_goes_whole(spark):
    """Hosts with a tenth of junk stay; one with three quarters goes with its good documents, two such as well."""
    rows = [(h * 100 + k, prose(h * 100 + k) if k % 10 else "# $ % & " * 30, f"h{h}") for h in range(20) for k in range(40)]
    for bad in ("bad", "worse"):
        rows += [(9000 + len(rows), prose(k) if k % 4 == 0 else prose(k) + " |" * 30, bad) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hosts = {h["host"]: h for h in rules.host_verdicts(rules.document_counts(docs)).collect()}
    assert {h for h, r in hosts.items() if r["host_failed"]} == {"bad", "worse"}
    assert hosts["bad"]["failed_rules"] == ["any", "symbols"] and 0.5 < hosts["bad"]["shrunk_rate"] < 0.75 == hosts["bad"]["rate"]
    got = rules.apply_rules(docs).collect()
    assert all(not r["kept"] for r in got if r["host"] in ("bad", "worse")) and sum(r["base_failed"] for r in got if r["host"] == "bad") == 0
    assert sum(r["kept"] for r in got) == 20 * 36


def test_licenses(spark, docs, none):
    assert licenses.scan_licenses(docs).count() == len(table()) and licenses.scan_licenses(none).count() == 0
    rows = [(1, "Ünder CC  BY, und General\nPublic-License. all RIGHTS reserved"), (2, None), (3, "cc byte")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = got[1]
    assert (first["n_words"], first["n_base"], first["first_word"], first["last_word"]) == (10, 3, 1, 7)
    assert first["base_labels"] == "cc-by,gpl,reserved" and got[2]["labels"] == "" and got[3]["n_base"] == 0 and got[2]["score"] == 0


def labels(spark, docs, label):
    rows = [(r["doc_id"], int(label(r["text"]))) for r in docs.select("doc_id", "text").collect() if r["doc_id"] is not None]
    return spark.createDataFrame(rows, f"doc_id long, {label.__name__} int")


@pytest.fixture(scope="module")
def marked(spark):
    rows = [(k, prose(k) + (" vile wretch" if k % 3 == 0 else ""), "s") for k in range(200)]
    return spark.createDataFrame([*rows, (None, None, None), (500, "", "s")], "doc_id long, text string, source string")


def test_toxicity(spark, marked, none):
    def toxic(t):
        return "vile" in (t or "")

    model = toxicity.fit(marked, labels(spark, marked, toxic))
    got = toxicity.score(marked, model)
    rows = got.join(marked.select("doc_id", "text"), "doc_id").collect()
    assert all(r["predicted"] == int(toxic(r["text"])) for r in rows if r["held_out"])
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert got.count() == 202 and all(0 <= r["score"] <= 1 for r in rows)
    kept = toxicity.drop_toxic(marked, model)
    assert kept.columns == marked.columns and kept.filter("text LIKE '%vile%'").count() == 0 and kept.filter("text IS NULL").count() == 1
    empty = toxicity.fit(none, labels(spark, none, toxic))
    assert toxicity.score(marked, empty).first()["score"] == 0.5 and toxicity.score(none, model).count() == 0


def test_quality(spark, marked, none):
    def quality_(t):
        return "vile" not in (t or "")

    quality_.__name__ = "quality"
    rows = [(k, prose(k) if k % 4 else " ".join(w.upper() + "!!" for w in prose(k).split())) for k in range(240)]
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(240)], "doc_id long, quality int")
    model = quality.fit(docs, marks)
    got = quality.score(docs, model).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in got if r["held_out"] and r["doc_id"] is not None)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.filter("text LIKE '%!!%'").count() == 0
    assert quality.score(none, model).count() == 0
    blind = quality.fit(docs, marks.filter("false"))
    assert quality.score(docs, blind).first()["score"] == 0.5


def test_sharding(docs, none):
    rows = table()
    got = sharding.shard_by_bytes(docs).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    total, done = sum(w[1] for w in want), 0
    for s in sorted({r["shard"] for r in got}):
        mine = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        for r in sorted(mine, key=lambda r: r["slot"]):
            assert done * 16 // total == s
            done += r["size"]
    ordered = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"])) if r["doc_id"] is not None]
    assert ordered == sorted(ordered) and sharding.shard_by_bytes(none).count() == 0


def test_sharding_with_a_hot_id(spark):
    rows = [(5, f"text {k}") for k in range(200)] + [(k, "t") for k in range(300)] + [(9, "same")] * 150
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 650
    for s in range(16):
        mine = sorted(r["slot"] for r in got if r["shard"] == s)
        assert mine == list(range(len(mine)))


def test_mixing(docs, none):
    rows = table()
    got = mixing.mix(docs).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += words(r[1])
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full, mix_total = set(), 1.5 * sum(size.values())
    while True:
        left = mix_total - sum(2 * size[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and left * weight[s] / open_weight > 2 * size[s]}
        if not over:
            break
        full |= over
    target = {s: 2 * size[s] if s in full else left * weight[s] / open_weight for s in order}
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    per = Counter()
    for r in mixed.collect():
        per[r["source"]] += words(r["text"])
    assert all(per[s] == taken[s] for s in order)
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))


def test_packing(docs, none):
    from tokenizers import Tokenizer

    rows, tk = table(), Tokenizer.from_file(packing.vocabulary_path())
    got = packing.pack(docs, window=256).collect()
    pieces = Counter()
    for r in rows:
        ids = np.array([*tk.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        for a in range(0, len(ids), 256):
            part = ids[a : a + 256]
            pieces[r[0], a, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == pieces
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    assert packing.pack(none).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16)).round(3)
    x[41] = x[40]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(400, None), (420, [0.0] * 16), (440, [float("nan")] + [1.0] * 15), (460, [None] + [1.0] * 15), (500, []), (20, x[20].tolist()), (None, x[3].tolist())]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), group_bytes=1000).collect()
    truth = x @ x.T
    asked = range(0, 300, 20)
    assert {r["query_id"] for r in got} == set(asked)
    hits = 0
    for q in asked:
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and q not in {r["vec_id"] for r in mine}
        hits += len({r["vec_id"] for r in mine} & set([j for j in np.lexsort((np.arange(300), -truth[q])) if j != q][:20]))
        assert all(r["score"] == pytest.approx(truth[q][r["vec_id"]], abs=1e-12) for r in mine)
    assert hits >= 0.9 * 20 * len(asked)
    few = ann.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"))
    assert few.count() == 2
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline_stages_keep_columns(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "minhash near-dedup", "source mixing", "packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == columns
        if k < 3:
            assert 0 < out.count() <= before
            before = out.count()
        docs = out
    assert docs.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 4096
