"""Byte-pair encoding of many words at once, for vocabularies with word ends (``</w>``).

Splits text as the vocabulary file says (lower case; contractions, runs of letters, single digits,
runs of other characters; blanks dropped) and applies its merges to the distinct words of a chunk as
numpy arrays.  Characters outside a checked range send their text through the ``tokenizers`` library;
words of more than ``LONG_WORD`` bytes go through its model, whose time does not grow with the square.
Merging all leftmost occurrences of the lowest-ranked pair at a time equals merging one by one, as a
pair made by a merge always ranks after it.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa

from strandline.llm._text import mix64

_U64 = np.uint64
_SPACE, _LETTER, _DIGIT, _OTHER, _HARD = range(5)
CACHE_WORDS = 500_000
LONG_WORD = 128
_LOADED: dict[str, WordBpe] = {}


def _character_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each code point below 65536; those that need normalising are hard."""
    kinds, lower = np.full(65536, _HARD, np.uint8), np.arange(65536, dtype=np.uint32)
    for cp in range(65536):
        c = chr(cp)
        category = unicodedata.category(c)
        if 0x0300 <= cp and not 0x2010 <= cp <= 0x2030 and not 0x20A0 <= cp <= 0x20BF and not 0x0400 <= cp <= 0x045F:
            continue
        small = c.lower()
        if category == "Cn" or unicodedata.combining(c) or unicodedata.normalize("NFC", c) != c or len(small) != 1:
            continue
        lower[cp] = ord(small)
        if c.isspace():
            # Python counts the separators 0x1C-0x1F as blanks; the pattern does not.
            kinds[cp] = _HARD if 0x1C <= cp <= 0x1F or cp == 0x85 else _SPACE
        elif category[0] == "L":
            kinds[cp] = _LETTER
        elif category[0] == "N":
            kinds[cp] = _DIGIT
        else:
            kinds[cp] = _OTHER
    return kinds, lower


def _byte_symbols() -> dict[int, str]:
    """Byte-level vocabularies write bytes as printable characters."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], model["merges"]
        self.reference = Tokenizer.from_file(path)
        self.special = [t.content for t in self.reference.get_added_tokens_decoder().values()]
        symbols = _byte_symbols()
        self.symbols = np.array([ord(symbols[b]) for b in range(256)], np.uint32)
        self.inner = np.array([vocab[symbols[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[symbols[b] + "</w>"] for b in range(256)], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.width = max(vocab.values()) + 1
        # Open addressing with a fixed number of probes: slot -> key, rank.
        keys = left * self.width + right
        self.bits = 19
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, len(keys), np.int32)
        at = self._slot(keys)
        pending = np.arange(len(keys))
        self.probes = 0
        while len(pending):
            self.probes += 1
            place = at[pending]
            free = self.slot_key[place] == -1
            _, first = np.unique(place, return_index=True)
            chosen = np.zeros(len(pending), bool)
            chosen[first] = True
            chosen &= free
            take = pending[chosen]
            self.slot_key[at[take]], self.slot_rank[at[take]] = keys[take], take
            pending = pending[~chosen]
            at[pending] = (at[pending] + 1) & ((1 << self.bits) - 1)
        self.merged = np.append(merged, -1).astype(np.int32)
        self.none = len(keys)
        self.kinds, self.lower = _character_tables()
        self.cache = np.zeros(0, _U64), np.zeros(0, np.int32), np.zeros(1, np.int64)

    @classmethod
    def load(cls, path: str) -> WordBpe:
        """One copy for each Python worker."""
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys.astype(_U64)) >> _U64(64 - self.bits)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.width + right
        at = self._slot(keys)
        rank = np.where(self.slot_key[at] == keys, self.slot_rank[at], self.none)
        open_ = np.flatnonzero((self.slot_key[at] != keys) & (self.slot_key[at] != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[at[open_]]
            hit = found == keys[open_]
            rank[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return rank

    def encode_words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each word) of byte spans; words are merged in groups of like length."""
        size = end - start
        lists = np.empty(len(size), np.int64)
        out, where, total = [], np.zeros(len(size), np.int64), 0
        order = np.argsort(size, kind="stable")
        cut, long = 0, int(np.searchsorted(size[order], LONG_WORD, "right"))
        for row in order[long:]:
            word = self.symbols[data[start[row] : end[row]]].tobytes().decode("utf-32-le")
            ids = np.array([t.id for t in self.reference.model.tokenize(word)], np.int32)
            lists[row], where[row] = len(ids), total
            total += len(ids)
            out.append(ids)
        while cut < long:
            longest_first = size[order[cut]]
            stop = int(np.searchsorted(size[order[:long]], longest_first + max(1, longest_first // 4), "left"))
            stop = min(stop, cut + max(1, 4_000_000 // max(int(longest_first), 1)))
            rows = order[cut:stop]
            ids, count = self._merge(data, start[rows], size[rows])
            lists[rows] = count
            where[rows] = total + np.cumsum(count) - count
            total += len(ids)
            out.append(ids)
            cut = stop
        flat = np.concatenate(out) if out else np.zeros(0, np.int32)
        first = np.concatenate([[0], np.cumsum(lists)])
        gather = np.repeat(where - first[:-1], lists) + np.arange(first[-1])
        return flat[gather], first

    def _cached(self, digest: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        """``encode_words`` for words with sorted hashes, keeping up to ``CACHE_WORDS`` of earlier chunks."""
        known, k_ids, k_first = self.cache
        at = np.minimum(np.searchsorted(known, digest), max(len(known) - 1, 0))
        hit = known[at] == digest if len(known) else np.zeros(len(digest), bool)
        miss = np.flatnonzero(~hit)
        new_ids, new_first = self.encode_words(data, start[miss], end[miss])
        size = np.empty(len(digest), np.int64)
        begin = np.empty(len(digest), np.int64)
        size[miss], begin[miss] = np.diff(new_first), len(k_ids) + new_first[:-1]
        old = at[hit]
        size[hit], begin[hit] = k_first[old + 1] - k_first[old], k_first[old]
        pool = np.concatenate([k_ids, new_ids])
        first = np.concatenate([[0], np.cumsum(size)])
        ids = pool[np.repeat(begin - first[:-1], size) + np.arange(first[-1])]
        if len(known) + len(miss) > CACHE_WORDS:
            self.cache = digest, ids, first
        elif len(miss):
            words = np.concatenate([known, digest[miss]])
            order = np.argsort(words, kind="stable")
            sizes = np.concatenate([np.diff(k_first), np.diff(new_first)])
            begins = np.concatenate([k_first[:-1], len(k_ids) + new_first[:-1]])
            sizes, begins = sizes[order], begins[order]
            firsts = np.concatenate([[0], np.cumsum(sizes)])
            gather = np.repeat(begins - firsts[:-1], sizes) + np.arange(firsts[-1])
            self.cache = words[order], pool[gather], firsts
        return ids, first

    def _merge(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = int(size.max())
        column = np.arange(width)
        inside = column < size[:, None]
        raw = data[np.minimum(start[:, None] + column, len(data) - 1)]
        ids = np.where(column == size[:, None] - 1, self.final[raw], self.inner[raw])
        count = size.copy()
        ranks = np.full((len(size), max(width - 1, 0)), self.none, np.int32)
        if width > 1:
            both = inside[:, 1:]
            ranks[both] = self._ranks(ids[:, :-1][both], ids[:, 1:][both])
        done_ids: list[np.ndarray] = []
        done_rows: list[np.ndarray] = []
        result_count = np.zeros(len(size), np.int64)
        active = np.arange(len(size))
        while len(active):
            best = ranks.min(axis=1) if ranks.shape[1] else np.full(len(active), self.none)
            live = best < self.none
            if not live.all():
                rest = ~live
                shape = np.arange(ids.shape[1]) < count[rest][:, None]
                done_ids.append(ids[rest][shape])
                done_rows.append(active[rest])
                result_count[active[rest]] = count[rest]
                active, ids, count, ranks, best = active[live], ids[live], count[live], ranks[live], best[live]
                if not len(active):
                    break
            # The leftmost place of the lowest rank of each word; further places come in later rounds.
            at = (ranks == best[:, None]).argmax(axis=1)
            row = np.arange(len(active))
            ids[row, at] = self.merged[best]
            columns = np.arange(ids.shape[1])
            shifted = columns + (columns > at[:, None])
            ids = np.take_along_axis(ids, np.minimum(shifted, ids.shape[1] - 1), axis=1)
            count -= 1
            pair = np.arange(ranks.shape[1])
            moved = pair + (pair > at[:, None])
            ranks = np.take_along_axis(ranks, np.minimum(moved, ranks.shape[1] - 1), axis=1)
            ranks[pair >= (count - 1)[:, None]] = self.none
            before = at > 0
            ranks[row[before], at[before] - 1] = self._ranks(ids[row[before], at[before] - 1], ids[row[before], at[before]])
            after = at < count - 1
            ranks[row[after], at[after]] = self._ranks(ids[row[after], at[after]], ids[row[after], at[after] + 1])
        rows = np.concatenate(done_rows)
        flat = np.concatenate(done_ids)
        ends = np.cumsum(result_count[rows])
        begins = np.zeros(len(size), np.int64)
        begins[rows] = ends - result_count[rows]
        first = np.cumsum(result_count) - result_count
        gather = np.repeat(begins - first, result_count) + np.arange(len(flat))
        return flat[gather], result_count

    def encode_batch(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text, without special tokens."""
        texts = column.to_pylist()
        out: list[np.ndarray | None] = [None] * len(texts)
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        lengths = np.array([len(c) for c in codes], np.int64)
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        kinds = np.where(flat < 65536, self.kinds[np.minimum(flat, 65535)], _HARD)
        first = np.concatenate([[0], np.cumsum(lengths)])
        hard = np.concatenate([[0], np.cumsum(kinds == _HARD)])
        easy = hard[first[1:]] == hard[first[:-1]]
        easy &= np.array([not any(s in t for s in self.special) for t in texts], bool)
        for k in np.flatnonzero(~easy):
            out[k] = np.array(self.reference.encode(texts[k], add_special_tokens=False).ids, np.int64)
        keep = np.repeat(easy, lengths)
        flat, kinds = flat[keep], kinds[keep]
        easy_rows = np.flatnonzero(easy)
        first = np.concatenate([[0], np.cumsum(lengths[easy_rows])])
        for k, ids in zip(easy_rows, self._encode_easy(self.lower[flat], kinds, first), strict=True):
            out[k] = ids
        return out

    def _encode_easy(self, flat: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        n, rows = len(flat), len(first) - 1
        if n == 0:
            return [np.zeros(0, np.int64)] * rows
        edge = np.zeros(n + 4, bool)
        edge[first] = True
        new = np.ones(n, bool)
        new[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT) | edge[1:n]
        # Contractions: an apostrophe that begins a token, followed by s, t, m, d, re, ve or ll.
        quote = np.flatnonzero((flat == 39) & new)
        if len(quote):
            padded, pad_edge = np.concatenate([flat, np.zeros(3, flat.dtype)]), edge
            a, b = padded[quote + 1], padded[quote + 2]
            a = np.where(pad_edge[quote + 1] | (quote + 1 >= n), 0, a)
            b = np.where(pad_edge[quote + 2] | (quote + 2 >= n), 0, b)
            single = np.isin(a, [ord(c) for c in "stmd"])
            double = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | (
                (a == ord("l")) & (b == ord("l"))
            )
            hit = quote[single | double]
            reach = np.where(single[single | double], 2, 3)
            new[hit + 1] = False
            after = hit + reach
            inside = after < n
            new[after[inside]] = True
        new &= kinds != _SPACE
        start = np.flatnonzero(new)
        stops = new | (kinds == _SPACE) | edge[:n]
        boundary = np.append(np.flatnonzero(stops), n)
        end = boundary[np.searchsorted(boundary, start, "right")]
        # Distinct words by a 64-bit hash of their code points.
        up, down = _powers(n + 1)
        total = np.concatenate([np.zeros(1, _U64), np.cumsum((flat.astype(_U64) + _U64(1)) * up[:n])])
        digest = mix64((total[end] - total[start]) * down[start] + (end - start).astype(_U64) * _U64(0x9E3779B97F4A7C15))
        distinct, example, word = np.unique(digest, return_index=True, return_inverse=True)
        # UTF-8 of the distinct words only.
        s, e = start[example], end[example]
        span = e - s
        gather = np.repeat(s - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
        points = flat[gather].astype(np.uint32)
        data, width = _utf8(points)
        byte_end = np.cumsum(width)[np.cumsum(span) - 1]
        byte_start = np.concatenate([[0], byte_end[:-1]])
        ids, at = self._cached(distinct, data, byte_start, byte_end)
        many = np.diff(at)[word]
        ends = np.cumsum(many)
        stream = ids[np.repeat(at[word] - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cut = np.searchsorted(start, first)
        token = np.concatenate([[0], ends])[cut]
        return [stream[token[k] : token[k + 1]] for k in range(rows)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    from strandline.llm._text import _power_tables

    return _power_tables(n)


def _utf8(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of code points below 65536 and how many each takes."""
    width = 1 + (points >= 0x80) + (points >= 0x800)
    begin = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    one, two, three = width == 1, width == 2, width == 3
    out[begin[one]] = points[one]
    out[begin[two]] = 0xC0 | (points[two] >> 6)
    out[begin[two] + 1] = 0x80 | (points[two] & 63)
    out[begin[three]] = 0xE0 | (points[three] >> 12)
    out[begin[three] + 1] = 0x80 | ((points[three] >> 6) & 63)
    out[begin[three] + 2] = 0x80 | (points[three] & 63)
    return out, width
