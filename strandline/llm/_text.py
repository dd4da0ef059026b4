"""Array kernels over whole texts, used inside ``mapInArrow`` functions.

Texts arrive as Arrow string columns.  Kernels look at the UTF-8 bytes of a *chunk* (a run of
whole documents of about ``CHUNK_BYTES``), so memory is bounded by the chunk size or by the
longest single document, whichever is larger.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 500_000
SLICE_ROWS = 1000

_U64 = np.uint64
_GOLDEN = _U64(0x9E3779B97F4A7C15)
_M1 = _U64(0xBF58476D1CE4E5B9)
_M2 = _U64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = x + _GOLDEN
    x = (x ^ (x >> _U64(30))) * _M1
    x = (x ^ (x >> _U64(27))) * _M2
    return x ^ (x >> _U64(31))


@dataclass
class Chunk:
    """Whole documents ``first .. last-1`` of a batch: their bytes and the offsets of each in them."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column with nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return ends - ends[0], raw[ends[0] : ends[-1]]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches in runs of few rows, so that derived columns stay small; freed memory goes back between batches."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
        release()


def release() -> None:
    """Give freed pages back to the system: workers live as long as their executor and share its memory."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a column into runs of whole documents of about ``size`` bytes."""
    offsets, data = string_buffers(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield Chunk(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def byte_class(is_member) -> np.ndarray:
    return np.array([bool(is_member(b)) for b in range(256)])


#: Words are maximal runs of bytes other than space and the controls 9-13.
SPACED = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words are maximal runs of ASCII letters, digits and bytes of non-ASCII characters.
ALNUM = byte_class(lambda b: b >= 0x80 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)
#: A-Z to a-z, other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_R = _U64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i < n, grown on demand and kept for the worker's lifetime."""
    have = len(_powers.get("up", ()))
    if have < n:
        n = max(n, CHUNK_BYTES + 65_536)
        inverse = pow(int(_R), -1, 1 << 64)
        for name, base in (("up", int(_R)), ("down", inverse)):
            table = np.empty(n, _U64)
            table[0] = 1
            filled = 1
            while filled < n:  # doubling: the second half is the first one times R**filled
                take = min(filled, n - filled)
                table[filled : filled + take] = table[:take] * _U64(pow(base, filled, 1 << 64))
                filled += take
            _powers[name] = table
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of a chunk: byte spans, 64-bit hashes and the first word of each document."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray | None
    doc_first: np.ndarray  # rows + 1 entries

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.doc_first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc_first) - 1), self.count)


def words(chunk: Chunk, member: np.ndarray, lower: bool = False, hashed: bool = True) -> Words:
    """Maximal runs of ``member`` bytes that do not cross documents."""
    data, n = chunk.data, len(chunk.data)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return Words(zero, zero, np.zeros(0, _U64), np.zeros(chunk.rows + 1, np.int64))
    inside = member[data]
    cut = np.zeros(n + 1, bool)
    cut[chunk.offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    digest = None
    if hashed:
        up, down = _power_tables(n + 1)
        total = np.empty(n + 1, _U64)
        total[0] = 0
        letters = LOWER[data] if lower else data
        np.cumsum((letters.astype(_U64) + _U64(1)) * up[:n], out=total[1:])
        digest = mix64((total[end] - total[start]) * down[start])
    return Words(start, end, digest, np.searchsorted(start, chunk.offsets))


def ngrams(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window of n words, first window of each document).

    A document with fewer than n words but at least one gives a single window of all its words.
    """
    count, first = found.count, found.doc_first
    per_doc = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    doc_first = np.concatenate([[0], np.cumsum(per_doc)])
    total = int(doc_first[-1])
    if total == 0:
        return np.zeros(0, _U64), doc_first
    doc = np.repeat(np.arange(len(count)), per_doc)
    at = first[doc] + (np.arange(total) - doc_first[doc])
    padded = np.concatenate([found.hash, np.zeros(n, _U64)])
    short = count[doc] < n
    out = np.zeros(total, _U64)
    for k in range(n):
        part = padded[at + k]
        if short.any():
            part = np.where(short & (k >= count[doc]), _U64(0), part)
        out = out * _U64(0x5851F42D4C957F2D) + part
    return mix64(out), doc_first


def sum_by_doc(values: np.ndarray, doc_first: np.ndarray) -> np.ndarray:
    """Sums of consecutive values by document; empty documents get 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[doc_first[1:]] - total[doc_first[:-1]]


def crc32_of_ids(ids: pa.Array) -> np.ndarray:
    """zlib CRC-32 of each id written as decimal text (null: of the empty text)."""
    import zlib

    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) for i in ids.to_pylist()], np.int64)
