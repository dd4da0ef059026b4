"""Every operator on clashing column names, repeated rows, very long texts and unusual vectors."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import ann, dedup, licenses, mixing, packing, rules, sharding
from strandline.llm._ranges import RUN, numbered

#: Names that the operators use inside, as further columns of the input.
CLASHES = (
    "id", "hash", "id_null", "hash_null", "k_id", "k_hash", "k_source", "k_source_null", "row", "fp", "n", "bands", "bucket", "class_id", "class_size",
    "kept", "text_hash", "seeded", "size", "copies", "total", "part", "before", "nth", "whole", "extra", "taken", "target", "source_size", "times",
    "host", "n_words", "base_failed", "rate", "shard", "slot", "range", "step", "mixed", "bytes", "start", "length", "rank", "sequence_id", "offset",
    "labels", "detections", "score", "dims", "key", "vector", "code", "norm", "align", "query_id", "__run", "__hash", "__nth", "__id", "__k_id", "__whole", "__host",
)


def words(k, n=80):
    return " ".join(f"w{(k * 31 + i * i) % 997}" for i in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(k, words(k), f"s{k % 3}") for k in range(30)] + [(3, words(3), "s0")] * 3 + [(None, words(40), None), (None, None, None), (50, "", "s1"), (51, None, "s1")]
    rows += [(60, "z" * 300_000, "s2"), (61, "Licensed under the" + " " * 100_000 + "MIT License. " + "long text here " * 20_000, "s2"), (62, words(3), "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return rows, df.select("*", *(F.lit(f"x{k}").alias(c) for k, c in enumerate(CLASHES)))


def test_kept_rows_are_whole_rows(awkward):
    rows, df = awkward
    kept = dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert all(r[c] == f"x{k}" for r in got for k, c in enumerate(CLASHES))
    assert Counter(r.doc_id for r in got)[3] == 1 and 62 not in {r.doc_id for r in got} and {60, 61} <= {r.doc_id for r in got}
    assert len(got) == len({r[1] or "" for r in rows})


def test_mixed_rows_are_whole_rows(awkward):
    rows, df = awkward
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns
    got = mixed.collect()
    assert all(r[c] == f"x{k}" for r in got for k, c in enumerate(CLASHES))
    taken = sum(r["taken"] for r in mixing.mix(df).collect())
    assert sum(len((r.text or "").split()) for r in got) == taken > 0
    texts = {r[1] for r in rows}
    assert all(r.text in texts or any(t and t.startswith(r.text) for t in texts) for r in got)


def test_digests_ignore_further_columns(awkward):
    rows, df = awkward
    plain = df.select("doc_id", "text", "source")
    for run in (sharding.shard_by_bytes, lambda d: rules.apply_rules(d), lambda d: licenses.scan_licenses(d).drop("detections"), lambda d: packing.pack(d).drop("sequence_id", "offset", "sequence_tokens"), mixing.mix, dedup.near_duplicates):
        a, b = run(df), run(plain)
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    by = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert by[61].labels == "mit" and by[60].n_words == 1
    sizes = Counter((r.doc_id, r["size"], r.text_crc32) for r in sharding.shard_by_bytes(df).collect())
    assert sizes == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    pieces = [r for r in packing.pack(df).collect() if r.doc_id == 60]
    assert sum(r.length for r in pieces) == pieces[0].doc_tokens > 4096


def test_copies_are_numbered_in_runs(spark):
    rows = spark.createDataFrame([("a", 3), ("b", RUN + 5), ("c", 1), ("d", 3 * RUN)], "k string, copies long")
    for most in (3 * RUN, 1):
        got = {r.k: (r.n, r.low, r.high, r.d) for r in numbered(rows, "copies", "nth", most).groupBy("k").agg(
            F.count("*").alias("n"), F.min("nth").alias("low"), F.max("nth").alias("high"), F.count_distinct("nth").alias("d")).collect()}
        assert got == {"a": (3, 0, 2, 3), "b": (RUN + 5, 0, RUN + 4, RUN + 5), "c": (1, 0, 0, 1), "d": (3 * RUN, 0, 3 * RUN - 1, 3 * RUN)}


def test_ranges_that_follow_the_input_give_the_same_order(spark):
    rows = [(k * 7 % 1000, f"t{k}") for k in range(900)] + [(5, f"u{k}") for k in range(300)] + [(None, "n")] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = sharding.shard_by_bytes(df, ranges=4).collect()
    many = sharding.shard_by_bytes(df, ranges=4, range_rows=20).collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and len(one) == len(rows)


def test_a_third_of_all_rows_is_one_row(spark):
    rows = [(k, words(k)) for k in range(60)] + [(7, words(7))] * (RUN + 50)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    near = dedup.near_duplicates(df)
    assert near.count() == len(rows) and near.filter("kept").count() == 60
    assert near.filter("doc_id = 7").select("class_size").distinct().first()[0] == RUN + 51
    got = sharding.shard_by_bytes(df).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert sum(r.n for r in got) == len(rows) and all(r.m == r.n - 1 for r in got)
    assert mixing.mix(df).count() == len(rows) == packing.pack(df, window=512).select("doc_id").count()


def test_vectors_of_one_id_are_all_candidates(spark):
    rows = [(1, [1.0, 1.0]), (1, [5.0, 5.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [0.0, 2.0]), (40, [0.0, -2.0]), (3, [1.0, 2.0, 3.0]), (60, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *(F.lit("x").alias(c) for c in CLASHES))
    got = ann.nearest(df).collect()
    assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == 20), key=lambda r: r.rank)] == [(1, 5.0), (1, 1.0), (40, 0.0), (40, -0.0)]
    assert sorted(r.score for r in got if r.query_id == 40 and r.rank == 1) == [0.0, 10.0]
    assert [(r.vec_id, r.score) for r in got if r.query_id == 60] == [(3, 1.0)]


def test_groups_of_queries_give_the_same(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=8).round(3).tolist()) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(str, ann.nearest(df).collect())) == sorted(map(str, ann.nearest(df, group_bytes=200).collect()))
