"""Approximate nearest neighbours by inner product: randomly rotated one-bit codes with reranking.

A vector is rotated by a fixed random rotation; its code is the sign of each coordinate, packed into
bytes.  With the correction scalar (the product of the unit vector with its own code) the code gives an
unbiased estimate of the unit vector's inner product with a rotated query.  The estimate's error has a
bound that falls with the square root of the dimension, ``EPSILON`` deviations of it are the slack.  A
candidate is reranked by its exact product only if its estimate plus slack reaches the k-th best exact
product that is known by then; no other vector is multiplied with the query.

Codes are computed once and written beside the vectors; vectors then stay where they lie.  Queries go
to them in groups of at most ``GROUP_BYTES``, one broadcast each, and a task gives back the k best of
its rows for each query.  Before that the same search over one row in ``FLOOR_SHARE`` gives each query
a floor, the k-th best there: all rows are searched afterwards, but a task returns no product below the
floor, so what is shuffled is about k * ``FLOOR_SHARE`` rows a query, however many tasks there are.

Defined results.  Null, zero and empty vectors and vectors with null or non-finite components take no
part; a query's candidates are the vectors of its own length.  Rows equal in id and vector are one; rows
that repeat an id with another vector are candidates of their own, and queries of their own with ranks
of their own.  Fewer candidates than k: all.  Ties go to the smaller id.  Null ids take no part.  Empty
table: no rows.  Only the id and vector columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm._scratch import Scratch

K = 20
EVERY = 20
BLOCK = 4096
EPSILON = 2.4
GROUP_BYTES = 16_000_000
FLOOR_SHARE = 64
SOME = 256
SEED = 17


@cache
def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """A random rotation: the orthogonal factor of a Gaussian matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, norms, correction scalars) of vectors (rows)."""
    norm = np.linalg.norm(vectors, axis=1)
    unit = (vectors / norm[:, None]) @ rotation(vectors.shape[1])
    align = np.abs(unit).sum(axis=1) / math.sqrt(vectors.shape[1])  # product with the own code, about 0.8
    return np.packbits(unit >= 0, axis=1), norm, align


def slack(align: np.ndarray, dims: int) -> np.ndarray:
    """``EPSILON`` deviations of the estimate for a unit vector and a unit query."""
    return EPSILON * np.sqrt(np.maximum(1 - align**2, 0)) / align / math.sqrt(max(dims - 1, 1))


def unpacked(bits: np.ndarray, align: np.ndarray, dims: int) -> np.ndarray:
    """The codes' vectors, scaled so that their product with a rotated unit query estimates the unit vector's."""
    signs = np.unpackbits(bits, axis=1, count=dims).astype(np.float32) * 2 - 1
    return signs / (math.sqrt(dims) * align[:, None]).astype(np.float32)


class Queries:
    """Up to ``SOME`` queries of one length, their floors, and the k best products so far."""

    def __init__(self, number: np.ndarray, ids: np.ndarray, keys: np.ndarray, vectors: np.ndarray, floor: np.ndarray, k: int):
        self.number, self.ids, self.keys, self.vectors, self.floor, self.k = number, ids, keys, vectors, floor, k
        self.norm = np.linalg.norm(vectors, axis=1)
        self.turned = ((vectors / self.norm[:, None]) @ rotation(vectors.shape[1])).astype(np.float32)
        self.best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.reranked = 0

    def search(self, ids: np.ndarray, keys: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norm: np.ndarray, room: np.ndarray) -> None:
        """Take the nearest of some vectors, by their unpacked codes and slack, into ``best``."""
        guess = codes @ self.turned.T
        guess *= norm[:, None].astype(np.float32)
        # Without a floor yet, the exact products of the likeliest give one.
        blind = np.flatnonzero(np.isneginf(self.floor))
        if len(blind) and len(ids) > 2 * self.k:
            likely = np.argpartition(-guess[:, blind], 2 * self.k, axis=0)[: 2 * self.k]
            self._rerank(likely.T.ravel(), np.repeat(blind, 2 * self.k), ids, keys, vectors)
            guess[likely, blind[None, :]] = -np.inf
        bound = guess + (room * norm).astype(np.float32)[:, None]
        q, row = np.nonzero(bound.T >= (self.floor / self.norm)[:, None].astype(np.float32))
        self._rerank(row, q, ids, keys, vectors)

    def _rerank(self, row: np.ndarray, q: np.ndarray, ids: np.ndarray, keys: np.ndarray, vectors: np.ndarray) -> None:
        own = (ids[row] == self.ids[q]) & (keys[row] == self.keys[q])
        row, q = row[~own], q[~own]
        if not len(q):
            return
        # One query's rows at a time stay in the cache; a row's sum does not depend on its place.
        exact = np.empty(len(row))
        cut = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        for low, high in zip(cut, np.append(cut[1:], len(q)), strict=True):
            some = vectors.take(row[low:high], axis=0)
            some *= self.vectors[q[low]]
            some.sum(axis=1, out=exact[low:high])
        self.reranked += len(row)
        high = exact >= self.floor[q]
        new = q[high], exact[high], ids[row][high], keys[row][high]
        if not len(new[0]):
            return
        q, score, vec, key = (np.concatenate([a, b]) for a, b in zip(self.best, new, strict=True))
        order = np.lexsort((key, vec, -score, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order, q, place = order[place < self.k], q[place < self.k], place[place < self.k]
        self.best = q, score[order], vec[order], key[order]
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[order][last])


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column, or the bytes and offsets of a binary one."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), ends
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def _matrix(column: pa.Array, pick: np.ndarray, width: int) -> np.ndarray:
    """Rows ``pick``, all of one width."""
    values, ends = _rows(column)
    return values[ends[pick][:, None] + np.arange(width)]


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds code, norm and align to (id, key, dims, vector)."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(at, BLOCK)
            dims = batch.column("dims").to_numpy()
            code: list[bytes] = [b""] * batch.num_rows
            norm, align = np.zeros((2, batch.num_rows))
            for d in np.unique(dims):
                pick = np.flatnonzero(dims == d)
                bits, norm[pick], align[pick] = encode(_matrix(batch.column("vector"), pick, int(d)))
                for k, row in zip(pick, bits, strict=True):
                    code[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "key", "dims", "vector")), pa.array(code, pa.binary()), pa.array(norm), pa.array(align)],
                ["id", "key", "dims", "vector", "code", "norm", "align"],
            )


def _search_batches(sent, k: int):
    """Searches a task's rows with a broadcast group: {dims: (number, id, key, vector, floor) of its queries}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = {
            d: [Queries(*(c[at : at + SOME].copy() for c in columns), k) for at in range(0, len(columns[0]), SOME)]
            for d, columns in sent.value.items()
        }
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                dims = batch.column("dims").to_numpy()
                for d in np.unique(dims).tolist():
                    if d not in groups:
                        continue
                    pick = np.flatnonzero(dims == d)
                    ids, keys, norm, align = (batch.column(c).to_numpy()[pick] for c in ("id", "key", "norm", "align"))
                    vectors = _matrix(batch.column("vector"), pick, d)
                    codes = unpacked(_matrix(batch.column("code"), pick, -(-d // 8)), align, d)
                    for some in groups[d]:
                        some.search(ids, keys, vectors, codes, norm, slack(align, d))
        for some in (q for group in groups.values() for q in group):
            q, score, vec, key = some.best
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.number[q]), pa.array(some.ids[q]), pa.array(vec), pa.array(key), pa.array(score)],
                ["q", "query_id", "vec_id", "key", "score"],
            )

    return run


_FOUND = "q long, query_id long, vec_id long, key long, score double"


def nearest(
    table: DataFrame, every: int = EVERY, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row whose id is divisible by ``every``."""
    spark = table.sparkSession
    scratch = Scratch(spark)
    value = F.col(vector_col).cast("array<double>")
    sound = (
        F.col(id_col).isNotNull()
        & F.coalesce(F.size(value) > 0, F.lit(False))
        & F.coalesce(F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
        & F.coalesce(F.exists(value, lambda x: x != 0), F.lit(False))
    )
    clean = table.filter(sound).select(F.col(id_col).cast("long").alias("id"), value.alias("vector"))
    clean = clean.dropDuplicates(["id", "vector"]).select("id", F.xxhash64("vector").alias("key"), F.size("vector").alias("dims"), "vector")
    kinds = "id long, key long, dims int, vector array<double>, code binary, norm double, align double"
    coded = scratch.save(clean.mapInArrow(_encode_batches, kinds), "coded")
    asked = coded.filter(F.col("id") % every == 0).select("id", "key", "dims", "vector")
    need = asked.agg(F.sum(F.lit(8).cast("long") * (F.col("dims") + 4)).alias("bytes")).first().bytes or 0
    groups = 1 + need // group_bytes
    found = []
    for g in range(groups):
        mine = asked.filter(F.pmod(F.xxhash64("id", "key"), F.lit(groups)) == g)
        rows = mine.orderBy("id", "key").toArrow().combine_chunks()  # about ``group_bytes``
        columns = _query_columns(rows)
        sample = coded.filter(F.pmod(F.xxhash64("key", "id"), F.lit(FLOOR_SHARE)) == 0)
        sent = spark.sparkContext.broadcast(columns)
        ranked = _ranked(sample.mapInArrow(_search_batches(sent, k), _FOUND), k).filter(F.col("rank") == k)
        for r in ranked.select("q", "score").collect():  # a row for each query of the group
            for number, _, _, _, floor in columns.values():
                floor[number == r.q] = r.score
        sent = spark.sparkContext.broadcast(columns)
        near = coded.mapInArrow(_search_batches(sent, k), _FOUND)
        found.append(near if groups == 1 else scratch.save(near, f"near-{g}"))
    ranked = [_ranked(near, k).select("query_id", "rank", "vec_id", "score") for near in found]
    out = ranked[0]
    for more in ranked[1:]:
        out = out.union(more)
    return out


def _query_columns(rows: pa.Table) -> dict[int, tuple[np.ndarray, ...]]:
    """(number, id, key, vector, floor) of a group's queries by their length; numbers count through the group."""
    dims = rows["dims"].to_numpy()
    out = {}
    for d in np.unique(dims):
        pick = np.flatnonzero(dims == d)
        column = rows["vector"].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        floor = np.full(len(pick), -np.inf)
        out[int(d)] = (pick, rows["id"].to_numpy()[pick], rows["key"].to_numpy()[pick], _matrix(column, pick, int(d)), floor)
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
