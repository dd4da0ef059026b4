"""Masked pseudo-likelihood: a bidirectional window network scores every token from both sides.

Tokens are lower-cased words.  The network sees ``SIDE`` words on the left and on the right of a masked
one through an embedding of each word's hash bucket (``1 << BITS`` of them, so frequent words have one
of their own), weighs them by position, and a tanh layer meets an output vector of every bucket:

    log P(word | sides) = log q(word) + s(word, sides) - log sum over words of q(v) exp(s(v, sides))

with q the word's share of all other documents.  ``score`` is the sum over a document's tokens, so a text
does not vouch for itself: a word's own occurrences in the document are taken out of its count, and a word
that no other document has counts ``UNSEEN``.  The sum over words is taken over the ``TOP`` largest buckets
and a seeded sample of the others, the same for all documents.

Everything is gathered over the whole corpus.  Counts of all distinct words (64-bit hashes) are a written
table that grows with the vocabulary; the ``HEAD`` most frequent go to the tasks, the others are joined.
The network is trained in numpy on every token, by sampled softmax with negatives drawn from the text
(so in proportion to q): each task trains on its own documents from the common weights, gives back the rows
it has moved, and rows are averaged by how often they were used, ``ROUNDS`` times.  What a task returns is
bounded by the size of the network, and their number follows the input.

Defined results.  Null or empty text, or one without words: 0 tokens, score 0, mean null.  Repeated
rows each count and each get their score; they are other documents to each other.  Ties in the order of
words go by hash.  Empty table: no rows.  Very long texts are read whole.  Only id and text are read, so
further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import _text
from strandline.llm._scratch import Scratch
from strandline.sources.tables import spread

BITS = 15
DIMS = 16
SIDE = 2
ROUNDS = 1
RATE = 0.1
BATCH = 1024
NEGATIVES = 64
TOP, SAMPLED = 64, 64
UNSEEN = 0.5
MOST = 60.0
HEAD = 65_536
HELD_WORDS = 1_000_000
SEED = 5
_U64 = np.uint64


def _lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, _text.Chunk, _text.Words]]:
    for batch in _text.slices(batches):
        text = pc.utf8_lower(pc.fill_null(batch.column("text"), ""))
        for part in _text.chunks(text):
            yield batch, part, _text.words(part, _text.ALNUM)


def _bucket(found: _text.Words, bits: int) -> np.ndarray:
    return (found.hash >> _U64(64 - bits)).astype(np.int64)


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) over all tokens; a word comes again when a task has seen ``HELD_WORDS`` others."""
    hashes, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for _, _, found in _lowered(batches):
        distinct, n = np.unique(found.hash.view(np.int64), return_counts=True)
        hashes.append(distinct)
        counts.append(n)
        held += len(distinct)
        if held > 2 * HELD_WORDS:
            distinct, n = _summed(hashes, counts)
            hashes, counts, held = [distinct], [n], len(distinct)
            if held > HELD_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(n)], ["word", "n"])
                hashes, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    distinct, n = _summed(hashes, counts)
    yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(n)], ["word", "n"])


def sides(found: _text.Words, bits: int, side: int = SIDE) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each token, buckets of its neighbours): ``1 << bits`` stands beyond a document's ends."""
    token = _bucket(found, bits).astype(np.int32)
    # Every document stands between ``side`` edges on either end of one array.
    rows = len(found.count)
    padded = np.full(len(token) + side * (rows + 1), 1 << bits, np.int32)
    at = np.arange(len(token)) + side * (1 + found.doc())
    padded[at] = token
    shifts = [*range(-side, 0), *range(1, side + 1)]
    around = np.empty((len(token), 2 * side), np.int32)
    for k, shift in enumerate(shifts):
        around[:, k] = padded[at + shift]
    return token, around


@dataclass
class Network:
    """Weights: input rows (the last for a document's edge), output rows with their bias, positions, hidden bias."""

    bits: int = BITS
    dims: int = DIMS
    side: int = SIDE
    words: np.ndarray = field(init=False)
    out: np.ndarray = field(init=False)
    place: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        rng = np.random.default_rng(SEED)
        size = 1 << self.bits
        self.words = rng.normal(0, 0.3, (size + 1, self.dims)).astype(np.float32)
        self.out = np.zeros((size, self.dims + 1), np.float32)  # the last column is the bias
        self.place = np.ones((2 * self.side + 1, self.dims), np.float32) / (2 * self.side)  # the last row is the hidden bias
        self.place[-1] = 0

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """The tanh layer with a one for the bias."""
        out = np.empty((len(around), self.dims + 1), self.words.dtype)
        out[:, -1] = 1
        total = np.zeros((len(around), self.dims), self.words.dtype)
        total += self.place[-1]
        for k in range(2 * self.side):
            part = self.words.take(around[:, k], axis=0)
            part *= self.place[k]
            total += part
        np.tanh(total, out=out[:, :-1])
        return out

    def table(self) -> np.ndarray:
        """All rows, one under the other, of ``dims + 1`` columns."""
        wide = lambda a: np.pad(a, ((0, 0), (0, 1)))
        return np.concatenate([wide(self.words), self.out, wide(self.place)])

    def take(self, rows: np.ndarray, values: np.ndarray) -> None:
        """Set rows of ``table()``."""
        n, m = len(self.words), len(self.out)
        for target, low, high in ((self.words, 0, n), (self.out, n, n + m), (self.place, n + m, n + m + len(self.place))):
            mine = (rows >= low) & (rows < high)
            target[rows[mine] - low] = values[mine][:, : target.shape[1]]


class Trainer:
    """Sampled softmax by row-wise Adagrad; counts how often each row of the network's table was used."""

    def __init__(self, network: Network, rate: float, seed: int):
        self.net, self.rate, self.rng = network, rate, np.random.default_rng(seed)
        size = len(network.words) + len(network.out) + len(network.place)
        self.used = np.zeros(size)
        self.speed = np.full(size, 1e-2)
        self.loss = self.tokens = 0.0

    def _move(self, target: np.ndarray, base: int, rows: np.ndarray, grads: np.ndarray) -> None:
        order = np.argsort(rows)
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        total = np.add.reduceat(grads.take(order, axis=0), first, axis=0)
        times, rows = np.diff(np.append(first, len(rows))), rows[first]
        self.used[base + rows] += times
        speed = self.speed[base + rows] + np.einsum("ij,ij->i", total, total) / total.shape[1]
        self.speed[base + rows] = speed
        total *= (self.rate / np.sqrt(speed)).astype(total.dtype)[:, None]
        target[rows] -= total

    def step(self, token: np.ndarray, around: np.ndarray, negatives: np.ndarray) -> None:
        net, n = self.net, len(token)
        hidden = net.hidden(around)
        good, bad = net.out.take(token, axis=0), net.out.take(negatives, axis=0)
        own = np.exp(np.minimum(np.einsum("ij,ij->i", good, hidden), MOST))
        share = hidden @ bad.T
        np.minimum(share, MOST, out=share)
        np.exp(share, out=share)
        total = share.sum(axis=1)
        total += own
        own /= total
        share /= total[:, None]
        self.loss -= float(np.log(own + 1e-30).sum())
        self.tokens += n
        own -= 1
        good *= own[:, None]
        inner = (good + share @ bad)[:, : net.dims]
        inner *= 1 - hidden[:, : net.dims] ** 2
        place = np.empty_like(net.place)
        grads = np.empty((2 * net.side, n, net.dims), inner.dtype)
        for k in range(2 * net.side):
            np.multiply(inner, net.place[k], out=grads[k])
            place[k] = np.einsum("ij,ij->j", inner, net.words.take(around[:, k], axis=0))
        place[-1] = inner.sum(axis=0)
        first = len(net.words)
        against = share.T @ hidden
        hidden *= own[:, None]
        self._move(net.out, first, np.concatenate([token, negatives]), np.concatenate([hidden, against]))
        self._move(net.words, 0, around.T.ravel(), grads.reshape(-1, net.dims))
        self._move(net.place, first + len(net.out), np.arange(len(place)), place / n)

    def learn(self, token: np.ndarray, around: np.ndarray) -> None:
        """One pass over the tokens of a chunk in random order."""
        order = self.rng.permutation(len(token))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            negatives = token[self.rng.integers(0, len(token), NEGATIVES)]
            self.step(token[some], around[some], negatives)


def _train_batches(network: Network, rate: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        from pyspark import TaskContext

        context = TaskContext.get()
        trainer = Trainer(copy.deepcopy(network), rate, seed * 1_000_003 + (context.partitionId() if context else 0))
        for _, _, found in _lowered(batches):
            token, around = sides(found, network.bits, network.side)
            if len(token):
                trainer.learn(token, around)
        rows = np.flatnonzero(trainer.used)
        values = trainer.net.table()[rows].astype(np.float64) * trainer.used[rows][:, None]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows), pa.array(trainer.used[rows]), *(pa.array(v) for v in values.T)],
            ["row", "used", *(f"v{k}" for k in range(values.shape[1]))],
        )

    return run


@dataclass
class Model:
    """The network, how q is made, and what the sum over words is taken over.

    ``counts`` is the written table (word, n) of all words, ``head`` and ``head_n`` its most frequent ones
    in order of the hash, ``total`` the tokens and ``distinct`` the words of the corpus; ``noise`` are
    buckets and ``noise_share`` what each stands for.
    """

    network: Network
    counts: DataFrame
    head: np.ndarray
    head_n: np.ndarray
    total: int
    distinct: int
    noise: np.ndarray
    noise_share: np.ndarray


def noise_buckets(mass: np.ndarray, top: int = TOP, sampled: int = SAMPLED) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) whose weighted sum estimates one over all buckets: the largest ones, and a sample of the rest."""
    if mass.sum() == 0:
        return np.zeros(1, np.int64), np.ones(1)
    mass = mass / mass.sum()
    order = np.argsort(-mass, kind="stable")
    large, rest = order[:top], order[top:]
    left = mass[rest].sum()
    if left <= 0:
        return large, mass[large]
    drawn = np.random.default_rng(SEED).choice(rest, sampled, p=mass[rest] / left)
    return np.concatenate([large, drawn]), np.concatenate([mass[large], np.full(sampled, left / sampled)])


def fit(
    docs: DataFrame, text_col: str = "text", bits: int = BITS, dims: int = DIMS, side: int = SIDE, head: int = HEAD,
    rounds: int = ROUNDS, rate: float = RATE,
) -> Model:
    """Count the words of all documents, then train on all tokens."""
    scratch = Scratch(docs.sparkSession)
    source = spread(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    words = source.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = scratch.save(words, "words")
    network = Network(bits, dims, side)
    columns = [f"v{k}" for k in range(dims + 1)]
    kinds = ", ".join(["row long", "used double", *(f"{c} double" for c in columns)])
    for step in range(rounds):
        moved = source.mapInArrow(_train_batches(network, rate / (1 + step), step), kinds)
        means = moved.groupBy("row").agg(*((F.sum(c) / F.sum("used")).cast("float").alias(c) for c in columns))
        found = means.toArrow()  # at most a row for each of the network's
        values = np.stack([found[c].to_numpy() for c in columns], axis=1) if found.num_rows else np.zeros((0, dims + 1))
        network.take(found["row"].to_numpy(), values)
    first = words.orderBy(F.desc("n"), "word").limit(head).toArrow()  # at most ``head`` rows
    order = np.argsort(first["word"].to_numpy())
    buckets = words.groupBy(F.shiftrightunsigned("word", 64 - bits).alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
    mass = np.zeros(1 << bits)
    mass[buckets["bucket"].to_numpy()] = buckets["n"].to_numpy()
    noise, share = noise_buckets(mass)
    return Model(
        network, words, first["word"].to_numpy()[order], first["n"].to_numpy()[order], int(mass.sum()), words.count(), noise, share
    )


def token_scores(network: Network, token: np.ndarray, around: np.ndarray, noise: np.ndarray, share: np.ndarray) -> np.ndarray:
    """s(token, sides) - log of the sum over words, for each token."""
    out = np.empty(len(token))
    against, share = np.ascontiguousarray(network.out[noise].T), share.astype(np.float32)
    for k in range(0, len(token), BATCH):
        part = slice(k, k + BATCH)
        hidden = network.hidden(around[part])
        others = hidden @ against
        np.minimum(others, MOST, out=others)
        np.exp(others, out=others)
        out[part] = np.einsum("ij,ij->i", network.out.take(token[part], axis=0), hidden) - np.log(others @ share)
    return out


def _score_batches(network: Network, head: np.ndarray, head_n: np.ndarray, noise: np.ndarray, share: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part, found in _lowered(batches):
            token, around = sides(found, network.bits, network.side)
            value = _text.sum_by_doc(token_scores(network, token, around, noise, share), found.doc_first)
            # Distinct words of each document with how often they occur there.
            doc, word = found.doc(), found.hash.view(np.int64)
            both = _text.mix64(found.hash + _text.mix64(doc.astype(_U64)))  # one number for word and document
            order = np.argsort(both)
            both = both[order]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
            times, at = np.diff(np.append(first, len(both))), order[first]
            again = np.argsort(doc[at], kind="stable")
            times, doc, word = times[again], doc[at][again], word[at][again]
            at = np.minimum(np.searchsorted(head, word), max(len(head) - 1, 0))
            known = head[at] == word if len(head) else np.zeros(len(word), bool)
            value += np.bincount(doc[known], times[known] * np.log(np.maximum(head_n[at[known]] - times[known], 0) + UNSEEN), part.rows)
            ends = np.searchsorted(doc[~known], np.arange(part.rows + 1)).astype(np.int32)
            rows = slice(part.first, part.last)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row")[rows], batch.column("doc_id")[rows], pa.array(found.count.astype(np.int64)), pa.array(value),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(word[~known])),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(times[~known].astype(np.int32))),
                ],
                ["row", "doc_id", "n_tokens", "part", "others", "times"],
            )

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, score, mean_score) of each row of the corpus that the model was fitted on.

    A row that was not counted there is scored as if it had been: no count falls below none.
    """
    named = F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    source = spread(docs.select(*named)).withColumn("row", F.monotonically_increasing_id())
    run = _score_batches(model.network, model.head, model.head_n, model.noise, model.noise_share)
    # Written, so that rows keep their numbers and texts are read once.
    kinds = "row long, doc_id long, n_tokens long, part double, others array<long>, times array<int>"
    parts = Scratch(docs.sparkSession).save(source.mapInArrow(run, kinds), "parts")
    others = parts.select("row", F.explode(F.arrays_zip("others", "times")).alias("o")).select(
        "row", F.col("o.others").alias("word"), F.col("o.times").alias("times")
    )
    elsewhere = F.greatest(F.coalesce("n", F.lit(0)) - F.col("times"), F.lit(0)) + UNSEEN
    rest = others.join(model.counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log(elsewhere)).alias("rest"))
    # The share of the other documents' tokens, with ``UNSEEN`` for each of their words.
    size = F.log(F.greatest(F.lit(model.total) - F.col("n_tokens"), F.lit(0)) + UNSEEN * (model.distinct + 1))
    total = parts.drop("others", "times").join(rest, "row", "left").withColumn(
        "score", F.col("part") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * size
    )
    return total.select(
        "doc_id", "n_tokens", "score", F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens")).alias("mean_score")
    )
