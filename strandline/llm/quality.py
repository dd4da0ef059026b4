"""Quality classifier: supervised subword embeddings trained by numpy stochastic gradient descent.

A text's vector is the mean of the learned vectors of its hashed features: character n-grams of 3
to 5 bytes, words, and pairs of neighbouring words, where a word that repeats the one before is
replaced by one mark (a back reference), so repetition is a feature whatever the words.  A softmax
layer over the vector gives the classes.  As the layer is linear, scoring needs one number for each
hash bucket: the difference of the two logits of its vector.

Fitted on at most ``MAX_TRAIN`` labelled rows (those with the least hash of their id); scoring covers
all rows and whole texts.

Defined results.  Null or empty text: the score of the bias alone.  Null ids count as the empty text
in the fold rule.  No labels, or labels of one kind: every score is that kind's share (0.5 without
labels).  Repeated ids are trained on once, by the least text, and each row is scored.  Empty table: no
rows.  Very long texts are read whole.  A score of exactly 0.5 is label 1.  The fit and the scores read
the named columns only, and ``keep_good`` passes rows on as they are, so further columns of any name do
no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import _text
from strandline.llm.toxicity import filtering, fold, labelled_sample, scorer
from strandline.sources.tables import spread

BITS = 17
DIMS = 8
MAX_TRAIN = 4096
EPOCHS = 5
RATE = 2.0
#: Featureless mass added to each text, which leaves very short texts near the bias.
PRIOR = 16
FOLDS, HELD_OUT = 3, 1
_U32 = np.uint32
_U64 = np.uint64


def ngram_buckets(part: _text.Chunk, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 3, 4, 5: the bucket of the n bytes from each position, and whether they lie in one document."""
    data = part.data.astype(_U32)
    n = len(data)
    room = np.repeat(part.offsets[1:], np.diff(part.offsets)) - np.arange(n)
    h = np.zeros(n, _U32)
    for k in range(5):
        if n <= k:
            return
        h[: n - k] = h[: n - k] * _U32(0x01000193) + data[k:] + _U32(1)
        if k >= 2:
            mixed = (h ^ (h >> _U32(15))) * _U32(0x2C1B3C6D)
            yield (mixed >> _U32(32 - bits)).astype(np.int32), room > k


def word_buckets(part: _text.Chunk, bits: int) -> tuple[np.ndarray, np.ndarray, _text.Words]:
    """Buckets of words and, from the second word of a document, of pairs (-1 at its first word)."""
    found = _text.words(part, _text.SPACED)
    shift = _U64(64 - bits)
    single = (_text.mix64(found.hash) >> shift).astype(np.int32)
    pair = np.full(len(single), -1, np.int32)
    if len(single) > 1:
        h = found.hash
        repeat = h[1:] == h[:-1]
        code = _text.mix64(np.where(repeat, _U64(1), h[:-1] * _U64(0x2545F4914F6CDD1D) + h[1:]))
        pair[1:] = (code >> shift).astype(np.int32)
        firsts = found.doc_first[:-1][found.count > 0]
        pair[firsts] = -1
    return single, pair, found


def _bag_batches(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << bits
        for batch in _text.slices(batches):
            offsets, data = _text.string_buffers(batch.column("text"))
            for k in range(batch.num_rows):
                text = data[offsets[k] : offsets[k + 1]]
                part = _text.Chunk(k, k + 1, text, np.array([0, len(text)]))
                parts = [b[ok] for b, ok in ngram_buckets(part, bits)]
                single, pair, _ = word_buckets(part, bits)
                seen = np.bincount(np.concatenate([*parts, single, pair[pair >= 0]]).astype(np.int64), minlength=size)
                at = np.flatnonzero(seen)
                rows = slice(k, k + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[rows],
                        batch.column("y")[rows],
                        pa.array([at.astype(np.int32)], pa.list_(pa.int32())),
                        pa.array([seen[at].astype(np.int32)], pa.list_(pa.int32())),
                    ],
                    ["doc_id", "y", "bucket", "times"],
                )

    return run


def sgd(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, seed: int = 11) -> tuple[np.ndarray, float]:
    """Train vectors and softmax layer; returns the logit difference of each bucket's vector and of the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / DIMS, 1.0 / DIMS, (size, DIMS)).astype(np.float32)
    layer = np.zeros((2, DIMS), np.float32)
    layer[1], layer[0] = 0.5, -0.5
    bias = np.zeros(2, np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            rate = RATE * (1 - done / steps)
            done += 1
            at, share = rows[i]
            if not len(at):
                continue
            v = vectors[at]
            mean = share @ v
            logits = layer @ mean + bias
            e = np.exp(logits - logits.max())
            g = e / e.sum()
            g[int(y[i])] -= 1
            back = layer.T @ g
            layer -= 0.1 * rate * np.outer(g, mean)
            bias -= 0.02 * rate * g
            vectors[at] = v - (rate * len(at) ** 0.5) * share[:, None] * back
    return vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0])


def _train(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ys, rows = [], [], []
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            ys += batch.column("y").to_pylist()
            for b, t in zip(batch.column("bucket"), batch.column("times"), strict=True):
                times = t.values.to_numpy().astype(np.float32)
                rows.append((b.values.to_numpy().copy(), times / (times.sum() + np.float32(PRIOR))))
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        y = np.array(ys, np.int64)[order]
        if len(y) and 0 < y.sum() < len(y):
            difference, bias = sgd([rows[k] for k in order], y, 1 << bits)
        else:
            share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
            difference, bias = np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([difference.astype(np.float32).tobytes()]), pa.array([bias])], ["difference", "bias"]
        )

    return run


class Model:
    """A logit difference for each bucket; pickled into the tasks that score (``4 << bits`` bytes)."""

    def __init__(self, difference: np.ndarray, bias: float, bits: int):
        self.difference, self.bias, self.bits = difference, bias, bits

    def score(self, part: _text.Chunk) -> np.ndarray:
        """Probability of label 1 for each document of a chunk."""
        sums, counts = np.zeros(part.rows), np.zeros(part.rows)
        for bucket, inside in ngram_buckets(part, self.bits):
            sums += _text.sum_by_doc(np.where(inside, self.difference[bucket], 0).astype(np.float64), part.offsets)
            counts += _text.sum_by_doc(inside.astype(np.int64), part.offsets)
        single, pair, found = word_buckets(part, self.bits)
        values = self.difference[single] + np.where(pair >= 0, self.difference[pair], 0)
        sums += _text.sum_by_doc(values.astype(np.float64), found.doc_first)
        counts += 2 * found.count - (found.count > 0)
        logit = sums / (counts + PRIOR) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35)))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_train: int = MAX_TRAIN,
    bits: int = BITS,
) -> Model:
    """Fit on at most ``max_train`` labelled rows, in one task."""
    sample = labelled_sample(docs, labels, label, FOLDS, HELD_OUT, max_train, id_col, text_col)
    bags = sample.mapInArrow(_bag_batches(bits), "doc_id long, y int, bucket array<int>, times array<int>")
    rows = bags.repartition(1).mapInArrow(_train(bits), "difference binary, bias double").collect()  # one row
    if not rows:
        return Model(np.zeros(1 << bits, np.float32), 0.0, bits)
    return Model(np.frombuffer(bytes(rows[0].difference), np.float32), rows[0].bias, bits)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    source = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    scored = source.mapInArrow(scorer(model, lower=False), "doc_id long, score double")
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are predicted good."""
    return spread(docs).mapInArrow(filtering(model, False, text_col, keep_high=True), docs.schema)
