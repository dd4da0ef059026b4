"""Toxicity and quality models against plain re-computations, and on awkward tables."""

import math

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import _text, quality, toxicity

MASK = (1 << 64) - 1
TEXTS = ["a b c a b", "", "One two, three! two", "été café été café x", "w " * 50, "z" * 40_000 + " tail", "x"]


def mix(x):
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def chunk(texts):
    return next(iter(_text.chunks(pa.array(texts, pa.string()), 1 << 30)))


def word_hash(word):
    total = 0
    for k, b in enumerate(word.encode()):
        total = (total + (b + 1) * pow(0xD6E8FEB86659FD93, k, 1 << 64)) & MASK
    return mix(total)


def words(text, member):
    out, held = [], b""
    for b in [*text.encode(), 0x20]:
        if member[b]:
            held += bytes([b])
        elif held:
            out.append(held.decode())
            held = b""
    return out


def toxic_features(text, bits):
    h = [word_hash(w) for w in words(text, _text.ALNUM)]
    out = {mix(x) for x in h}
    for gap, salt in ((1, 0x2545F4914F6CDD1D), (2, 0x369DEA0F31A53F85)):
        out |= {mix((a * salt + b) & MASK) for a, b in zip(h, h[gap:], strict=False)}
    return {x & ((1 << bits) - 1) for x in out}


def test_toxicity_features_and_scores_equal_plain_python():
    doc, index = toxicity.features(chunk(TEXTS), 26)
    want = [toxic_features(t, 26) for t in TEXTS]
    for k in range(len(TEXTS)):
        assert set(index[doc == k].tolist()) == want[k]
    rng = np.random.default_rng(2)
    every = sorted(set().union(*want))
    weight = rng.normal(size=len(every)) * (rng.random(len(every)) < 0.5)
    held = {f: w for f, w in zip(every, weight.tolist(), strict=True) if w}
    model = toxicity.Model(np.array(list(held), np.int64), np.array(list(held.values())), -0.3, 26)
    got = model.score(chunk(TEXTS))
    for k, features in enumerate(want):
        total = -0.3 + sum(held.get(f, 0.0) for f in features)
        assert got[k] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9)


def test_ftrl_equals_plain_python():
    rng = np.random.default_rng(6)
    rows = [np.unique(rng.integers(0, 30, 6)) for _ in range(40)]
    y = (rng.random(40) < 0.4).astype(float)
    w, bias = toxicity.ftrl(rows, y, 30, epochs=3, seed=1)
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    z, n, order, bz, bn, plain_bias = [0.0] * 30, [0.0] * 30, np.random.default_rng(1), 0.0, 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((b + math.sqrt(n[i])) / a + l2)

    for _ in range(3):
        for k in order.permutation(40):
            plain_bias = -bz / ((b + math.sqrt(bn)) / a)
            ws = {i: weight(i) for i in rows[k].tolist()}
            g = 1 / (1 + math.exp(-(sum(ws.values()) + plain_bias))) - y[k]
            for i, wi in ws.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / a * wi
                n[i] += g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / a * plain_bias
            bn += g * g
    assert np.allclose(w, [weight(i) for i in range(30)]) and bias == pytest.approx(plain_bias)


def quality_buckets(text, bits):
    data, out = text.encode(), []
    for n in (3, 4, 5):
        for i in range(len(data) - n + 1):
            h = 0
            for b in data[i : i + n]:
                h = (h * 0x01000193 + b + 1) & 0xFFFFFFFF
            out.append((((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF) >> (32 - bits))
    found = words(text, _text.SPACED)
    h = [word_hash(w) for w in found]
    out += [mix(x) >> (64 - bits) for x in h]
    out += [mix(1 if a == b else (a * 0x2545F4914F6CDD1D + b) & MASK) >> (64 - bits) for a, b in zip(h, h[1:], strict=False)]
    return out


def test_quality_scores_equal_plain_python():
    rng = np.random.default_rng(4)
    difference = rng.normal(size=1 << 12).astype(np.float32)
    got = quality.Model(difference, 0.2, 12).score(chunk(TEXTS))
    for k, t in enumerate(TEXTS):
        at = quality_buckets(t, 12)
        logit = sum(float(difference[b]) for b in at) / (len(at) + quality.PRIOR) + 0.2
        assert got[k] == pytest.approx(1 / (1 + math.exp(-logit)), rel=1e-5)


def test_quality_training_equals_plain_python():
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(12):
        at = np.unique(rng.integers(0, 16, 5))
        times = rng.integers(1, 4, len(at)).astype(np.float32)
        rows.append((at, times / (times.sum() + np.float32(quality.PRIOR))))
    y = np.array([0, 1] * 6)
    difference, bias = quality.sgd(rows, y, 16, seed=3)
    order = np.random.default_rng(3)
    dims = quality.DIMS
    vectors = order.uniform(-1 / dims, 1 / dims, (16, dims)).astype(np.float32).tolist()
    layer, b, done, steps = [[-0.5] * dims, [0.5] * dims], [0.0, 0.0], 0, quality.EPOCHS * 12
    for _ in range(quality.EPOCHS):
        for i in order.permutation(12):
            rate = quality.RATE * (1 - done / steps)
            done += 1
            at, share = rows[i][0].tolist(), rows[i][1].tolist()
            mean = [sum(s * vectors[a][d] for a, s in zip(at, share, strict=True)) for d in range(dims)]
            logits = [sum(layer[c][d] * mean[d] for d in range(dims)) + b[c] for c in (0, 1)]
            e = [math.exp(x - max(logits)) for x in logits]
            g = [e[c] / sum(e) - (c == y[i]) for c in (0, 1)]
            back = [sum(layer[c][d] * g[c] for c in (0, 1)) for d in range(dims)]
            for c in (0, 1):
                layer[c] = [layer[c][d] - 0.1 * rate * g[c] * mean[d] for d in range(dims)]
                b[c] -= 0.02 * rate * g[c]
            for a, s in zip(at, share, strict=True):
                vectors[a] = [vectors[a][d] - rate * len(at) ** 0.5 * s * back[d] for d in range(dims)]
    want = [sum(vectors[a][d] * (layer[1][d] - layer[0][d]) for d in range(dims)) for a in range(16)]
    assert np.allclose(difference, want, atol=1e-4) and bias == pytest.approx(b[1] - b[0], abs=1e-4)


def test_clashing_columns_repeated_rows_and_long_texts(spark):
    schema = "doc_id long, text string, l_id long, y int, features int, feature int, weight double, bucket int, times int, score double, held_out string"
    rows = [(k, f"calm words number{k} here" + (" vile wretch" if k % 3 == 0 else ""), 1, 2, 3, 4, 0.5, 5, 6, 0.7, "h") for k in range(90)]
    rows += [rows[0], rows[0], (200, "vile " * 40_000, 1, 2, 3, 4, 0.5, 5, 6, 0.7, "h"), (None, None, 1, 2, 3, 4, 0.5, 5, 6, 0.7, "h"), (201, "", 1, 2, 3, 4, 0.5, 5, 6, 0.7, "h")]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(k, int(k % 3 == 0), int(k % 3 > 0)) for k in range(90)] + [(k, 1, 1) for k in range(1000, 9000)], "doc_id long, toxic int, quality int")
    for module, keep in ((toxicity, toxicity.drop_toxic), (quality, quality.keep_good)):
        # Labels whose documents are missing use up none of the bound.
        model = module.fit(docs, labels, max_train=100)
        got = module.score(docs, model)
        assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows)
        scores = {}
        for r in got.collect():
            scores.setdefault(r.doc_id, set()).add(r.score)
        assert all(len(s) == 1 for s in scores.values())
        kept = keep(docs, model)
        assert kept.schema == docs.schema
        vile = {r.doc_id for r in kept.collect()}
        assert {k for k in range(90) if k % 3} <= vile and 0 not in vile
