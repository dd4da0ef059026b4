"""Packing documents into token windows: non-negative least squares over a length histogram.

Texts become token ids of a public BPE vocabulary plus an end id, cut at every full window; what is
left of each is a piece shorter than a window.  From the histogram of piece lengths:

1. Shallow combinations of up to ``DEPTH`` length bins that fill a window are enumerated, and
   non-negative least squares gives how often each is to be repeated so that the bins are used up.
2. The counts are rounded down, and lowered where they ask for more pieces than there are.
3. The residual pieces are packed greedily: longest first into the fullest window they fit.

The plan depends on the histogram alone (at most ``window`` numbers), so it is made on the driver;
each piece finds its sequence from its rank among the pieces of its length, which comes from prefix
sums over buckets, whose number follows the number of pieces.  A third of all documents having one
length spreads over the buckets.

A sequence is padded to the window, except one whose tokens number a power of two, which stands as it
is; ``sequence_tokens`` is the length after that.

Defined results.  Null or empty text: the end id alone.  Repeated rows: each is packed.  Null ids
stay null.  Empty table: no rows.  Ties go by (doc_id, start, crc).  Only the id and text columns are
read, so further columns of any name do no harm.  Very long texts, and texts that are one very long
word, are read whole; time grows with their length, not its square.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import _text
from strandline.llm._bpe import WordBpe
from strandline.llm._ranges import numbered, with_prefix_sums
from strandline.llm._scratch import Scratch
from strandline.sources.tables import spread

WINDOW = 4096
END_ID = 2
BIN = 32
DEPTH = 3
BUCKETS = 64
BUCKET_ROWS = 200_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _piece_batches(vocabulary: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.load(vocabulary)
        for batch in _text.slices(batches):
            ids = batch.column("doc_id").to_pylist()
            for part in _text.chunks(batch.column("text"), _CHUNK):
                out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "crc", "tokens")}
                texts = batch.column("text")[part.first : part.last]
                for k, tokens in enumerate(bpe.encode_batch(pc.fill_null(texts, ""))):
                    raw = np.append(tokens, end_id).astype("<u4")
                    for start in range(0, len(raw), window):
                        piece = raw[start : start + window]
                        out["doc_id"].append(ids[part.first + k])
                        out["start"].append(start)
                        out["length"].append(len(piece))
                        out["crc"].append(zlib.crc32(piece.tobytes()))
                        out["tokens"].append(len(raw))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.int64()) for v in out.values()],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return run


_CHUNK = 1_000_000


def combinations(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of 1 to ``depth`` bin numbers (1..bins) whose sum is ``bins``."""
    out: list[tuple[int, ...]] = []

    def extend(so_far: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            out.append(so_far)
            return
        room = depth - len(so_far)
        for b in range(min(most, left), 0, -1):
            if b * room < left:
                break
            extend((*so_far, b), left - b, b)

    extend((), bins, bins)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Minimise |a x - b| over x >= 0 by coordinate descent on the normal equations.

    Ends when no count moves by a quarter of a sequence, or with a warning after ``rounds`` sweeps:
    counts are rounded down and checked against the histogram, so pieces lose no place by that.
    """
    gram, x = a.T @ a, np.zeros(a.shape[1])
    slope = -(a.T @ b)
    scale = np.diag(gram)
    for _ in range(rounds):
        moved = 0.0
        for j in np.flatnonzero((x > 0) | (slope < -1e-9)):
            new = max(0.0, x[j] - slope[j] / scale[j])
            if new != x[j]:
                slope += gram[:, j] * (new - x[j])
                moved = max(moved, abs(new - x[j]))
                x[j] = new
        if moved < 0.25:
            break
    else:
        warnings.warn(f"least squares still moved by {moved:.2f} sequences after {rounds} sweeps", stacklevel=2)
    return x


Plan = list[tuple[dict[int, int], int]]


def solve_bins(counts: np.ndarray, depth: int = DEPTH) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """(combination, repeats): whole repeats that never use more of a bin than ``counts[bin]`` (bins from 1)."""
    bins = len(counts) - 1
    combos = combinations(bins, depth)
    matrix = np.zeros((bins, len(combos)))
    for j, combo in enumerate(combos):
        for b in combo:
            matrix[b - 1, j] += 1
    solved = np.floor(nnls(matrix, counts[1:].astype(float)) + 1e-9).astype(np.int64)
    left = counts.copy()
    repeats = np.zeros(len(combos), np.int64)
    for j in np.argsort(-solved, kind="stable"):
        if solved[j] == 0:
            break
        need = np.bincount(combos[j], minlength=bins + 1)
        used = np.flatnonzero(need)
        repeats[j] = min(solved[j], int((left[used] // need[used]).min()))
        left[used] -= repeats[j] * need[used]
    return combos, repeats


def greedy(counts: dict[int, int], window: int) -> Plan:
    """Best fit, longest first, over a histogram: packs with equal contents are handled together."""
    open_packs: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms = np.zeros(window + 1, bool)
    closed: Plan = []

    def put(room: int, pack: dict[int, int], times: int) -> None:
        if room == 0:
            closed.append((pack, times))
        else:
            open_packs.setdefault(room, []).append((pack, times))
            rooms[room] = True

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                most = window // length
                if left >= most:
                    put(window - most * length, {length: most}, left // most)
                    left -= left // most * most
                else:
                    put(window - left * length, {length: left}, 1)
                    left = 0
                continue
            room = int(fits[0]) + length
            pack, times = open_packs[room].pop()
            if not open_packs[room]:
                rooms[room] = False
            fill = min(room // length, left)
            take = min(times, left // fill)
            if take < times:
                put(room, pack, times - take)
            put(room - fill * length, {**pack, length: pack.get(length, 0) + fill}, take)
            left -= take * fill
    for packs in open_packs.values():
        closed += packs
    return closed


class Assignment:
    """Sequence and slot of the piece with a given rank among those of its length; bounded by the plan's size."""

    def __init__(self, histogram: dict[int, int], window: int, bin_size: int = BIN, depth: int = DEPTH):
        self.window, self.bin_size = window, bin_size
        self.segments: dict[int, list[tuple[int, int, int, int, int]]] = {}
        self.plan: Plan = []
        self.sequences = 0
        full = histogram.get(window, 0)
        lengths = sorted((n for n in histogram if 0 < n < window), reverse=True)
        left = {n: histogram[n] for n in lengths}
        used = dict.fromkeys(lengths, 0)
        if full:
            self._add({window: 1}, full, {window: 0})
        bins = window // bin_size
        counts = np.zeros(bins + 1, np.int64)
        of_bin: dict[int, list[int]] = {}
        for n in lengths:
            b = -(-n // bin_size)
            counts[b] += left[n]
            of_bin.setdefault(b, []).append(n)  # longest first
        if lengths:
            combos, repeats = solve_bins(counts, depth)
            for j in np.flatnonzero(repeats):
                self._spend(combos[j], int(repeats[j]), of_bin, left, used)
        for pack, times in greedy({n: c for n, c in left.items() if c}, window):
            self._add(pack, times, used)

    def _spend(self, combo, times: int, of_bin, left, used) -> None:
        """Take the longest pieces left of each bin, in runs in which every slot has one length."""
        while times:
            pack: dict[int, int] = {}
            for b in combo:
                n = next(n for n in of_bin[b] if left[n] > pack.get(n, 0))
                pack[n] = pack.get(n, 0) + 1
            run = min(times, *(left[n] // m for n, m in pack.items()))
            for n, m in pack.items():
                left[n] -= run * m
            self._add(pack, run, used)
            times -= run

    def _add(self, pack: dict[int, int], times: int, used: dict[int, int]) -> None:
        at, tokens = 0, sum(n * many for n, many in pack.items())
        for n in sorted(pack, reverse=True):
            self.segments.setdefault(n, []).append((used[n], pack[n], self.sequences, at, tokens))
            used[n] += pack[n] * times
            at += pack[n] * n
        self.sequences += times

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence_id, offset, tokens of the sequence with its padding) of the pieces of one length with these ranks."""
        table = np.array(self.segments[length], np.int64)
        k = np.searchsorted(table[:, 0], rank, "right") - 1
        begin, many, sequence, at, tokens = table[k].T
        inside = rank - begin
        padded = np.where(tokens & (tokens - 1) == 0, tokens, self.window)
        return sequence + inside // many, at + inside % many * length, padded


def _place_batches(assignment: Assignment):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset, padded = np.zeros((3, len(length)), np.int64)
            order = np.argsort(length, kind="stable")
            values, begins = np.unique(length[order], return_index=True)
            for n, rows in zip(values, np.split(order, begins[1:]), strict=True):
                if len(rows):
                    sequence[rows], offset[rows], padded[rows] = assignment.place(int(n), rank[rows])
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset), pa.array(padded)],
                [*names, "sequence_id", "offset", "sequence_tokens"],
            )

    return run


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    vocabulary: str | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    source = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    pieces = scratch.save(
        source.mapInArrow(_piece_batches(vocabulary or vocabulary_path(), window, end_id), _PIECE), "pieces"
    )
    buckets = max(BUCKETS, pieces.count() // BUCKET_ROWS)
    # Equal rows are counted first and numbered afterwards.
    keys = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    counted = pieces.groupBy(*keys).agg(F.count("*").alias("copies"))
    counted = scratch.save(
        counted.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int")),
        "counted",
    )
    scratch.drop("pieces")
    histogram = counted.groupBy("length").agg(F.sum("copies").alias("n"), F.max("copies").alias("most")).collect()  # at most ``window`` rows
    assignment = Assignment({r["length"]: r["n"] for r in histogram}, window)
    ranked = with_prefix_sums(
        counted, ["length"], ["bucket"], ["doc_id", "start", "ids_crc32", "doc_tokens"], {"before": "copies"}
    )
    each = numbered(ranked, "copies", "nth", max((r["most"] for r in histogram), default=0))
    each = each.select(*keys, (F.col("before") + F.col("nth")).alias("rank"))
    return each.mapInArrow(
        _place_batches(assignment), f"{_PIECE}, sequence_id long, offset long, sequence_tokens long"
    )
