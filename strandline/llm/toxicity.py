"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes (``BITS`` bits) of its words, of neighbouring word pairs
and of pairs with one word between; words are lower-cased runs of letters, digits and non-ASCII
characters.  Per-coordinate learning rates and L1 leave few weights, which every task gets.

The classifier is fitted on at most ``MAX_TRAIN`` labelled rows (those with the least hash of their
id); features seen in fewer than ``MIN_DOCS`` of them are left out.  Scoring covers all rows and
whole texts.

Defined results.  Null or empty text: the score of no features.  Null ids count as the empty text
in the fold rule.  No usable labels, or labels of one kind: every score is that kind's share (0.5
if there are no labels).  Repeated ids are trained on once, by the least text, and each row is scored.
Empty table: no rows.  Very long texts are read whole.  A score of exactly 0.5 is label 1.  The fit and
the scores read the named columns only, and ``drop_toxic`` passes rows on as they are, so further columns
of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import _text
from strandline.sources.tables import spread

BITS = 26
MAX_TRAIN = 8192
MIN_DOCS = 3
EPOCHS = 6
ALPHA, BETA, L1, L2 = 5.0, 1.0, 3.0, 0.0
FOLDS, HELD_OUT = 5, 0
_U64 = np.uint64
BIAS = -1


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bound: int, id_col: str, text_col: str
) -> DataFrame:
    """(doc_id, y, text) of at most ``bound`` labelled rows outside the held-out fold; labels without a row count for nothing."""
    present = docs.select(F.col(id_col).cast("long").alias("l_id"))
    ids = (
        labels.select(F.col(id_col).cast("long").alias("l_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("l_id").isNotNull() & F.col("y").isNotNull() & (fold(F.col("l_id"), folds) != held_out))
        .groupBy("l_id")
        .agg(F.max("y").alias("y"))
        .join(present, "l_id", "left_semi")
        .orderBy(F.xxhash64("l_id"), "l_id")
        .limit(bound)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return (
        texts.join(F.broadcast(ids), F.col("doc_id") == F.col("l_id"))  # at most ``bound`` rows
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.min("text").alias("text"))
    )


def features(part: _text.Chunk, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hashed feature) of words, pairs and skip pairs, repeats included."""
    found = _text.words(part, _text.ALNUM)
    doc, h = found.doc(), found.hash
    docs, hashes = [doc], [_text.mix64(h)]
    for gap, salt in ((1, 0x2545F4914F6CDD1D), (2, 0x369DEA0F31A53F85)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            docs.append(doc[gap:][same])
            hashes.append(_text.mix64(h[:-gap][same] * _U64(salt) + h[gap:][same]))
    mask = _U64((1 << bits) - 1)
    return np.concatenate(docs), (np.concatenate(hashes) & mask).astype(np.int64)


def _feature_batches(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches):
            for part in _text.chunks(pc.utf8_lower(batch.column("text"))):
                doc, index = features(part, bits)
                pairs = np.unique((doc << bits) | index)
                doc, index = pairs >> bits, pairs & ((1 << bits) - 1)
                ends = np.searchsorted(doc, np.arange(part.rows + 1)).astype(np.int32)
                rows = slice(part.first, part.last)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(index.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[rows], batch.column("y")[rows], lists], ["doc_id", "y", "features"]
                )

    return run


def ftrl(
    rows: list[np.ndarray], y: np.ndarray, size: int, epochs: int = EPOCHS, seed: int = 7
) -> tuple[np.ndarray, float]:
    """FTRL-proximal over binary features; the bias is not regularised."""
    z, n = np.zeros(size), np.zeros(size)
    bz = bn = 0.0
    rng = np.random.default_rng(seed)

    def weights(zi, ni):
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    bias = 0.0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            bias = -bz / ((BETA + np.sqrt(bn)) / ALPHA)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - y[i]
            g2 = g * g
            z[at] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g2
            bz += g - (np.sqrt(bn + g2) - np.sqrt(bn)) / ALPHA * bias
            bn += g2
    return weights(z, n), float(bias)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, ys, rows = [], [], []
    for batch in batches:
        ids += batch.column("doc_id").to_pylist()
        ys += batch.column("y").to_pylist()
        lists = batch.column("features")
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        rows += [values[ends[k] : ends[k + 1]].copy() for k in range(len(lists))]
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    rows, y = [rows[k] for k in order], np.array(ys, np.float64)[order]
    if len(y) and 0 < y.sum() < len(y):
        size = np.array([len(r) for r in rows])
        distinct, place, seen = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
        keep = seen >= MIN_DOCS
        new = np.cumsum(keep) - 1
        place = np.where(keep[place], new[place], -1)
        cut = np.concatenate([[0], np.cumsum(size)])
        rows = [(p := place[cut[k] : cut[k + 1]])[p >= 0] for k in range(len(rows))]
        w, bias = ftrl(rows, y, int(keep.sum()))
        some = np.flatnonzero(w)
        index, weight = np.append(distinct[keep][some], BIAS), np.append(w[some], bias)
    else:
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        index, weight = np.array([BIAS]), np.array([np.log(share / (1 - share))])
    yield pa.RecordBatch.from_arrays([pa.array(index.astype(np.int64)), pa.array(weight)], ["feature", "weight"])


class Model:
    """Nonzero weights by hashed feature; pickled into the tasks that score."""

    def __init__(self, index: np.ndarray, weight: np.ndarray, bias: float, bits: int):
        order = np.argsort(index)
        self.index, self.weight, self.bias, self.bits = index[order], weight[order], bias, bits
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[self.index & 0xFFFF] = True

    def score(self, part: _text.Chunk) -> np.ndarray:
        """Probability of label 1 for each document of a chunk of lower-cased text."""
        doc, index = features(part, self.bits)
        near = np.flatnonzero(self.sieve[index & 0xFFFF])
        total = np.full(part.rows, self.bias)
        if len(near) and len(self.index):
            pairs = np.unique((doc[near] << self.bits) | index[near])
            doc, index = pairs >> self.bits, pairs & ((1 << self.bits) - 1)
            at = np.minimum(np.searchsorted(self.index, index), len(self.index) - 1)
            hit = self.index[at] == index
            total += np.bincount(doc[hit], weights=self.weight[at[hit]], minlength=part.rows)
        return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_train: int = MAX_TRAIN,
    bits: int = BITS,
) -> Model:
    """Fit on at most ``max_train`` labelled rows, in one task; the weights that L1 leaves come back."""
    sample = labelled_sample(docs, labels, label, FOLDS, HELD_OUT, max_train, id_col, text_col)
    featured = sample.mapInArrow(_feature_batches(bits), "doc_id long, y int, features array<int>")
    rows = featured.repartition(1).mapInArrow(_train, "feature long, weight double").collect()
    bias = sum(r.weight for r in rows if r.feature == BIAS) if rows else 0.0
    kept = [r for r in rows if r.feature != BIAS]
    return Model(np.array([r.feature for r in kept], np.int64), np.array([r.weight for r in kept]), bias, bits)


def scorer(model, lower: bool = True):
    """A ``mapInArrow`` function that replaces the column text by the model's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches):
            text = pc.fill_null(batch.column("text"), "")
            text = pc.utf8_lower(text) if lower else text
            for part in _text.chunks(text):
                rows = slice(part.first, part.last)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[rows], pa.array(model.score(part))], ["doc_id", "score"]
                )

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    source = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    scored = source.mapInArrow(scorer(model), "doc_id long, score double")
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def filtering(model, lower: bool, text_col: str, keep_high: bool):
    """A ``mapInArrow`` function that keeps the whole rows whose label-1 score is on the wanted side of 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.slices(batches):
            text = pc.fill_null(batch.column(text_col), "")
            text = pc.utf8_lower(text) if lower else text
            high = [model.score(part) >= 0.5 for part in _text.chunks(text)]
            if high:
                yield batch.filter(pa.array(np.concatenate(high) == keep_high))

    return run


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted toxic."""
    return spread(docs).mapInArrow(filtering(model, True, text_col, keep_high=False), docs.schema)
