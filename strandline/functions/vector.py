"""Vector expressions over ARRAY columns, and a block kernel for many queries."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 for null vectors, vectors of different length and zero vectors."""
    scale = norm(a) * norm(b)
    sound = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (scale > 0)
    return F.when(sound, dot(a, b) / scale).otherwise(F.lit(0.0))


def l2_normalise(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x.cast("double") / n))).otherwise(a)


@cache
def _bucket_sums(dims: int):
    """A UDF from word hashes to signed bucket counts, normalised; one pass over the words."""
    @F.pandas_udf("array<double>")
    def run(hashes: pd.Series) -> pd.Series:
        out = []
        for row in hashes:
            h = np.asarray([] if row is None else row, np.int64)
            counts = np.bincount(h % dims, np.where(h >= 0, 1.0, -1.0), dims)
            length = np.sqrt((counts * counts).sum())
            out.append(counts / length if length > 0 else counts)
        return pd.Series(out)

    return run


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """Default embedder: words hashed into signed buckets, normalised; no model and no network."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return _bucket_sums(dims)(F.transform(words, lambda w: F.xxhash64(w)))


class Best:
    """The n best rows of each query so far, ties at the n-th place to the smaller id; scores rounded to ``digits`` first."""

    def __init__(self, n: int, digits: int | None):
        self.n, self.digits, self.kind = n, digits, None
        self.q, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, score: np.ndarray, ids: np.ndarray, kind: pa.DataType) -> None:
        """Take scores (rows x queries) in; minus infinity takes no part."""
        self.kind = kind
        if self.digits is not None:
            score = np.floor(score * 10.0**self.digits + 0.5) / 10.0**self.digits
        rows = len(ids)
        least = np.partition(score, rows - self.n, axis=0)[rows - self.n] if rows > self.n else np.full(score.shape[1], -np.inf)
        row, q = np.nonzero((score >= least) & (score > -np.inf))
        value = np.concatenate([self.score, score[row, q]])
        q = np.concatenate([self.q, q])
        name = ids[row] if self.ids is None else np.concatenate([self.ids, ids[row]])
        order = np.lexsort((np.unique(name, return_inverse=True)[1], -value, q))
        q = q[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < self.n
        self.q, self.score, self.ids = q[keep], value[order][keep], name[order][keep]

    def columns(self) -> list[pa.Array]:
        return [pa.array(self.ids, self.kind), pa.array(self.score)]


def nearest_rows(sent, n: int, digits: int | None, skip_equal: bool):
    """A ``mapInArrow`` function over (id, v): (query_id, id, similarity), the n best rows of the task for each query.

    ``sent`` is a broadcast Arrow table (query_id, query_vector).  Cosine as above; ties at the n-th place
    go to the smaller id.
    """
    def lists(column):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        size = np.diff(column.offsets.to_numpy())
        sound = column.is_valid().to_numpy(zero_copy_only=False)
        return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1], np.where(sound, size, -1)

    def matrix(values, start, pick, dims):
        rows = values[start[pick][:, None] + np.arange(dims)].astype(np.float64)
        length = np.sqrt((rows * rows).sum(axis=1))
        return np.divide(rows, length[:, None], out=np.zeros_like(rows), where=(length > 0)[:, None])

    def run(batches):
        asked = sent.value
        count = asked.num_rows
        q_ids = asked["query_id"].to_numpy()
        values, start, size = lists(asked["query_vector"]) if count else (None, None, np.zeros(0, int))
        groups = {int(d): np.flatnonzero(size == d) for d in np.unique(size) if d > 0}
        queries = {d: matrix(values, start, at, d) for d, at in groups.items()}
        best = Best(n, digits)
        step = max(1, 4_000_000 // max(count, 1))
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            values, start, size = lists(batch.column("v"))
            for low in range(0, batch.num_rows if count else 0, step):
                part = np.arange(low, min(low + step, batch.num_rows))
                sim = np.zeros((len(part), count))
                for d, at in groups.items():
                    mine = np.flatnonzero(size[part] == d)
                    if len(mine):
                        sim[np.ix_(mine, at)] = np.nan_to_num(matrix(values, start, part[mine], d) @ queries[d].T)
                if skip_equal:
                    sim[ids[part][:, None] == q_ids[None, :]] = -np.inf
                best.add(sim, ids[part], batch.column("id").type)
        if len(best.q):
            yield pa.RecordBatch.from_arrays([asked["query_id"].combine_chunks().take(pa.array(best.q)), *best.columns()], ["query_id", "id", "similarity"])

    return run
