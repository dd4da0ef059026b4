"""Array kernels and models against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import _text, ann, dedup, licenses, packing, quality, rules, toxicity
from strandline.llm._bpe import WordBpe

TEXTS = [
    "", "one", "a b c d", "The cat sat on the mat. The cat sat on the mat.\nline\nline\n\nline", "x" * 300, " \t\n ", "naïve Ünïcode — café 日本 😀",
    "a b a b a b a b", "Licensed under the Apache License, Version 2.0.\nAll rights reserved.", "\x0bq\x0c", "# $ % | <tag>",
]


def one_chunk(texts):
    return next(iter(_text.chunks(pa.array(texts, pa.string()), 1 << 30)))


def test_chunks_hold_whole_documents():
    texts = ["a" * n for n in (5, 0, 50, 3, 7)] + [None]
    parts = list(_text.chunks(pa.array(texts, pa.string()), 10))
    assert [p.first for p in parts][0] == 0 and parts[-1].last == len(texts)
    assert sum(len(p.data) for p in parts) == 65
    assert list(_text.chunks(pa.array([], pa.string()))) == []


def test_words_match_regex():
    found = _text.words(one_chunk(TEXTS), _text.SPACED)
    assert found.count.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in TEXTS]
    assert found.hash[found.doc_first[7]] == found.hash[found.doc_first[7] + 2]
    alone = _text.words(one_chunk(["b"]), _text.SPACED).hash[0]
    assert found.hash[found.doc_first[7] + 1] == alone


def plain_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
    }


def test_rule_counts():
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab \n#é") for _ in range(rng.randrange(80))) for _ in range(200)]
    got = rules.count_features(one_chunk(texts))
    for k, t in enumerate(texts):
        assert {n: int(v[k]) for n, v in got.items()} == plain_counts(t)


def bag(t):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_shingle_bags_are_multisets():
    texts = [t.lower() for t in TEXTS] + ["a b c d e f a b c d e f a b c d e"]
    doc, _, weight = dedup.shingle_bags(one_chunk(texts))
    for k, t in enumerate(texts):
        assert sorted(weight[doc == k].tolist()) == sorted(bag(t).values())


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(0)
    keys = _text.mix64(np.arange(400, dtype=np.uint64))
    w1, w2 = rng.integers(1, 6, 400), rng.integers(1, 6, 400)
    doc = np.repeat([0, 1], 400)
    slots = 4096
    sig = dedup.bag_minhash(doc, np.concatenate([keys, keys]), np.concatenate([w1, w2]), 2, slots)
    true = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / slots)


def test_license_suppression_and_labels():
    kept, base = licenses.scan(TEXTS[8].lower())
    assert [d[3] for d in kept] == ["apache-2.0", "reserved"] and [b[2] for b in base] == ["reserved"]
    assert licenses.scan("der ist mit die und")[0] == []
    assert [d[3] for d in licenses.scan("licensed under cc by-nc-sa 4.0")[0]] == ["cc-by-nc-sa-4.0"]
    assert [d[3] for d in licenses.scan("apache license" + " *\n" * 90 + "version 12.0")[0]] == ["apache-12.0"]
    assert [d[3] for d in licenses.scan("the gnu" + "\n//   " * 30 + "general public license, 2007")[0]] == ["gpl"]
    assert [d[3] for d in licenses.scan("mit" + " " * 40 + "license; gplv3; gpl 2; cc by ncaa")[0]] == ["mit", "gpl-3.0", "gpl-2.0", "cc-by"]
    many = [(0, 10, 5, "a", 0.5), (2, 8, 5, "b", 0.5), (2, 12, 1, "c", 0.5), (3, 6, 9, "d", 0.9)]
    assert [d[3] for d in licenses.suppress(many)] == ["a", "c", "d"]
    assert 200 < len(licenses.rules()) < 1000


def _written(tree, rng):
    """A text that a parsed pattern matches, look-arounds aside."""
    out = []
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out.append(chr(arg))
        elif name == "IN":
            out.append("7" if str(arg[0][0]) == "CATEGORY" else " " if str(arg[0][0]) == "NEGATE" else chr(arg[rng.randrange(len(arg))][1]))
        elif name == "BRANCH":
            out.append(_written(rng.choice(arg[1]), rng))
        elif name == "SUBPATTERN":
            out.append(_written(arg[-1], rng))
        elif name in ("MAX_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = arg
            out += [_written(body, rng) for _ in range(rng.randint(low, min(int(high), low + 1)))]
    return "".join(out)


def _plain_suppress(found):
    """Compares every two detections."""
    found = sorted(set(found))
    inside = lambda d, e: e[0] <= d[0] and d[1] <= e[1]
    stronger = lambda d, e: (e[2], e[1] - e[0]) > (d[2], d[1] - d[0])
    kept = [d for d in found if not any(inside(d, e) and stronger(d, e) for e in found)]
    return {(d[0], d[1], d[2]) for d in kept}


def test_license_gate_equals_no_gate_and_suppression_brute_force():
    rng = random.Random(4)
    rules_ = licenses.rules()
    single = [_written(re._parser.parse(r.pattern.pattern), rng) for r in rules_ for _ in range(3)]
    assert all(set(r.keywords) <= {k for k in r.keywords if k in t} for r, t in zip([r for r in rules_ for _ in range(3)], single, strict=True))
    mixed = [" ".join(rng.choice([*single, "some words", "\n# ", "2.0", "the"]) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    for t in [*single, *mixed]:
        found = [d for r in rules_ for d in licenses.detect(r, t)]
        assert licenses.scan(t)[0] == licenses.suppress(found)
        assert {(d[0], d[1], d[2]) for d in licenses.suppress(found)} == _plain_suppress(found)
    hit = sum(any(True for _ in licenses.detect(r, t)) for r, t in zip([r for r in rules_ for _ in range(3)], single, strict=True))
    assert hit > 0.95 * len(single)


def test_base_places_equal_brute_force():
    rng = random.Random(8)
    parts = ["cc", "by", "CC", "general", "public", "license", "all", "rights", "reserved", "ü", " ", "\n", "-", ".", "xx"]
    for _ in range(300):
        t = "".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(40)))
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        raw = t.encode().decode("latin-1")
        words = [m.group() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw)]
        want = sum(words[i : i + len(p.split())] == p.split() for p in licenses.PHRASES for i in range(len(words)))
        assert len(licenses.scan(raw)[1]) == want


@pytest.mark.parametrize("seed", range(3))
def test_bpe_equals_library(seed):
    bpe = WordBpe.load(packing.vocabulary_path())
    rng = random.Random(seed)
    letters = "abcdeéÉß '’.,!0123\n\tsSrRvVlLdDmM-ñ😀Σ日\x85\x1c"
    texts = TEXTS + ["<|endoftext|> it's", "'s 'S ,'s 'll'm 're5"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(400)]
    got = bpe.encode_batch(pa.array(texts))
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == bpe.reference.encode(t, add_special_tokens=False).ids


def test_long_words_equal_the_library():
    bpe = WordBpe.load(packing.vocabulary_path())
    rng = random.Random(9)
    for n in (127, 128, 129, 5000, 100_000, 1_000_000):
        t = "".join(rng.choice("abcdefghijklmnopé") for _ in range(n)) + " it's " + "=" * (n // 10)
        assert bpe.encode_batch(pa.array([t]))[0].tolist() == bpe.reference.encode(t, add_special_tokens=False).ids


def test_sequences_of_a_power_of_two_are_not_padded():
    plan = packing.Assignment({1024: 1, 4000: 1}, 4096)
    assert plan.place(1024, np.arange(1))[2].tolist() == [1024] and plan.place(4000, np.arange(1))[2].tolist() == [4096]


def test_packing_plan_places_every_piece_once():
    rng = np.random.default_rng(2)
    lengths = np.concatenate([rng.integers(1, 4097, 500), np.full(300, 77), np.full(5, 4096)])
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.Assignment(dict(zip(values.tolist(), counts.tolist(), strict=True)), 4096)
    used = {}
    for n, c in zip(values.tolist(), counts.tolist(), strict=True):
        sequence, offset, _ = plan.place(n, np.arange(c))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            used.setdefault(s, []).append((o, n))
    assert sorted(used) == list(range(plan.sequences))
    for pieces in used.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 4096
    assert lengths.sum() / (4096 * plan.sequences) > 0.95


def test_nnls_solves_a_small_system():
    a = np.array([[1.0, 0, 2], [0, 1, 1]])
    x = packing.nnls(a, np.array([40.0, 10.0]))
    assert np.allclose(a @ x, [40, 10], atol=1.0) and (x >= 0).all()
    combos, repeats = packing.solve_bins(np.array([0, 10, 0, 10, 0]), 3)
    used = np.zeros(5, int)
    for c, r in zip(combos, repeats, strict=True):
        for b in c:
            used[b] += r
    assert (used <= [0, 10, 0, 10, 0]).all() and (1, 3) not in combos and (3, 1) in combos


def test_ftrl_finds_the_marker():
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.2).astype(float)
    rows = [np.unique(np.append(rng.integers(1, 500, 30), [0] if t else [])).astype(int) for t in y]
    w, _ = toxicity.ftrl(rows, y, 500)
    assert w[0] == w.max() > 1 and (w == 0).sum() > 250


def test_quality_ngrams_stay_inside_documents():
    both = one_chunk(["abcdefgh", "zz"])
    alone = one_chunk(["abcdefgh"])
    for (b, ok), (b1, ok1) in zip(quality.ngram_buckets(both, 10), quality.ngram_buckets(alone, 10), strict=True):
        assert b[:8][ok[:8]].tolist() == b1[ok1].tolist() and not ok[8:].any()


def test_one_bit_search_matches_brute_force_and_skips_most_products():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 48))
    x = centres[rng.integers(0, 30, 9000)] + 0.3 * rng.normal(size=(9000, 48))
    x[100] = x[200]
    ids, keys = np.arange(9000), np.zeros(9000, np.int64)
    asked = ids[::45]
    bits, norm, align = ann.encode(x)
    codes = ann.unpacked(bits, align, 48)
    some = ann.Queries(np.arange(len(asked)), asked, keys[asked], x[asked], np.full(len(asked), -np.inf), 20)
    for at in range(0, 9000, 1500):
        part = slice(at, at + 1500)
        some.search(ids[part], keys[part], x[part], codes[part], norm[part], ann.slack(align[part], 48))
    truth, hits = x @ x.T, 0
    q, score, vec, _ = some.best
    for n, i in enumerate(asked):
        order = [j for j in np.lexsort((ids, -truth[i])) if j != i][:20]
        hits += len(set(order) & set(vec[q == n].tolist()))
        assert np.allclose(score[q == n], truth[i][vec[q == n]])
    assert hits >= 0.95 * 20 * len(asked) and some.reranked < 0.2 * 9000 * len(asked)
    error = codes @ some.turned.T - (truth[asked] / np.linalg.norm(x, axis=1) / some.norm[:, None]).T
    assert abs(error.mean()) < 0.02 and (np.abs(error) <= ann.slack(align, 48)[:, None]).mean() > 0.97


def test_crc_of_ids():
    assert _text.crc32_of_ids(pa.array([7, None])).tolist() == [zlib.crc32(b"7"), 0]


def test_rows_that_hold_only_the_query_itself_give_nothing():
    x = np.random.default_rng(4).normal(size=(3, 16))
    bits, norm, align = ann.encode(x)
    codes, ids, keys = ann.unpacked(bits, align, 16), np.arange(3) * 20, np.arange(3)
    some = ann.Queries(np.arange(1), ids[:1], keys[:1], x[:1], np.full(1, -np.inf), 20)
    some.search(ids[:1], keys[:1], x[:1], codes[:1], norm[:1], ann.slack(align[:1], 16))
    assert len(some.best[0]) == 0
    some.search(ids[1:], keys[1:], x[1:], codes[1:], norm[1:], ann.slack(align[1:], 16))
    assert sorted(some.best[2]) == [20, 40]
