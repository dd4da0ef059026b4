"""The language model against plain Python, and what its scores tell apart."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import _text, lm

SCHEMA = "doc_id long, text string, row long, part double, word string, others string, n_tokens int, times int"


def chunk_words(texts):
    return _text.words(next(iter(_text.chunks(pa.array(texts, pa.string()), 1 << 30))), _text.ALNUM)


def bucket(word, bits):
    return int(chunk_words([word]).hash[0] >> np.uint64(64 - bits))


def test_sides_do_not_cross_documents():
    token, around = lm.sides(chunk_words(["a b c", "", "d"]), 8)
    a, b, c, d = (bucket(w, 8) for w in "abcd")
    assert token.tolist() == [a, b, c, d]
    assert around.tolist() == [[256, 256, b, c], [256, a, c, 256], [a, b, 256, 256], [256, 256, 256, 256]]


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    token, around, negatives = rng.integers(0, 16, 20), rng.integers(0, 17, (20, 4)), rng.integers(0, 16, 6)

    def network():
        net = lm.Network(4, 3, 2)
        net.out = np.random.default_rng(1).normal(0, 0.5, net.out.shape)
        net.words, net.place = net.words.astype(float), net.place.astype(float)
        return net

    def loss(net):
        hidden = net.hidden(around)
        logits = np.concatenate([(net.out[token] * hidden).sum(axis=1, keepdims=True), hidden @ net.out[negatives].T], axis=1)
        return float((np.log(np.exp(logits).sum(axis=1)) - logits[:, 0]).sum())

    moved = {}

    class Spy(lm.Trainer):
        def _move(self, target, base, rows, grads):
            name = next(n for n in ("words", "out", "place") if getattr(self.net, n) is target)
            total = np.zeros(target.shape)
            np.add.at(total, rows, grads)
            moved[name] = total

    Spy(network(), 0.1, 0).step(token, around, negatives)
    moved["place"] = moved["place"] * len(token)  # positions move by the mean
    for name in moved:
        for at in [(0, 0), (3, 1), (2, 2)]:
            up, down = network(), network()
            getattr(up, name)[at] += 1e-5
            getattr(down, name)[at] -= 1e-5
            assert moved[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-3, abs=1e-4)


def test_sum_over_words_is_near_the_exact_one():
    rng = np.random.default_rng(5)
    net = lm.Network(10, 8)
    net.out = rng.normal(0, 0.3, net.out.shape).astype(np.float32)
    mass = rng.pareto(1.0, 1024)
    noise, share = lm.noise_buckets(mass)
    assert share.sum() == pytest.approx(1)
    around, token = rng.integers(0, 1025, (200, 4)), rng.integers(0, 1024, 200)
    hidden = net.hidden(around)
    exact = (net.out[token] * hidden).sum(axis=1) - np.log((np.exp(hidden @ net.out.T) * (mass / mass.sum())).sum(axis=1))
    assert np.abs(lm.token_scores(net, token, around, noise, share) - exact).mean() < 0.15


@pytest.mark.parametrize("head", [0, 4, 1000])
def test_scores_equal_plain_python(spark, head):
    texts = [f"A common text, of word{k} and word{k // 2} with rare{k % 7}" for k in range(60)]
    texts += [texts[0], texts[0], "", None, "lone", "long " * 30_000]
    rows = [(k, t, 1, 0.5, "x", "y", 2, 3) for k, t in enumerate(texts)] + [(None, "word3", 1, 0.5, "x", "y", 2, 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = lm.fit(docs, bits=8, dims=4, head=head)
    words = [re.findall(r"[a-z0-9]+", (r[1] or "").lower()) for r in rows]
    counts = Counter(w for doc in words for w in doc)
    total = sum(counts.values())
    assert model.counts.count() == model.distinct == len(counts) and model.total == total
    at = {w: bucket(w, 8) for w in counts}
    got = {r.doc_id: r for r in lm.score(docs, model).collect()}
    assert len(got) == len(rows)
    net = model.network
    for r, doc in zip(rows, words, strict=True):
        own, want = Counter(doc), 0.0
        for i, w in enumerate(doc if len(doc) < 1000 else []):
            around = [at[doc[j]] if 0 <= j < len(doc) else 256 for j in (i - 2, i - 1, i + 1, i + 2)]
            hidden = np.append(np.tanh(sum(net.words[b] * net.place[k] for k, b in enumerate(around)) + net.place[-1]), 1)
            others = sum(s * math.exp(float(net.out[b] @ hidden)) for b, s in zip(model.noise, model.noise_share, strict=True))
            q = (counts[w] - own[w] + lm.UNSEEN) / (total - len(doc) + lm.UNSEEN * (len(counts) + 1))
            want += math.log(q) + float(net.out[at[w]] @ hidden) - math.log(others)
        mine = got[r[0]]
        assert mine.n_tokens == len(doc)
        assert mine.mean_score == (pytest.approx(mine.score / len(doc)) if doc else None)
        if len(doc) < 1000:
            assert mine.score == pytest.approx(want, rel=1e-3, abs=1e-3)


def test_seen_text_scores_above_shuffled_text_and_repeated_above_single(spark):
    rng = random.Random(1)
    verbs, nouns = [f"verb{k}" for k in range(30)], [f"noun{k}" for k in range(60)]

    def sentence():
        a, b, v = rng.randrange(60), rng.randrange(60), rng.randrange(30)
        return f"the {nouns[a]} of {nouns[(a * 7) % 60]} will {verbs[v]} {nouns[(v * 2) % 60]} and {nouns[b]} again"

    texts = [" ".join(sentence() for _ in range(6)) + "".join(f" own{n}x{k}" for n in range(6)) for k in range(600)]
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, t) for k, t in enumerate(texts[:100])]
    model = lm.fit(spark.createDataFrame(rows, "doc_id long, text string"), bits=10)
    asked = rows + [(5000 + k, t) for k, t in enumerate(shuffled)]
    got = {r.doc_id: r.mean_score for r in lm.score(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert np.mean([got[k] > got[5000 + k] for k in range(600)]) > 0.95
    single, twice = [got[k] for k in range(100, 600)], [got[k] for k in range(100)]
    assert np.mean([np.mean(np.array(single) < t) for t in twice]) > 0.9


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(none, lm.fit(none)).count() == 0
