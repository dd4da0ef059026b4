"""License scans: ordered signature rules behind a keyword gate, with interval containment suppression.

Every rule is a regular expression with a label, a priority and the keywords that must all occur in
a text before it is tried.  Rules are written by hand (``_license_rules``) and tried on the whole text
with A-Z lower-cased; between two words anything but a word may stand, however long.  Where detections overlap, one that lies inside the interval of another
is suppressed when the other has the higher priority, or the same priority and the longer interval;
the score is the best confidence left.

Base phrases (``PHRASES``) are places where their words stand consecutively; words are maximal runs
of letters, digits and non-ASCII characters.  Their labels always stay.

Defined results.  Null or empty text: no words, no labels, score 0.  Labels are distinct, sorted and
comma-joined; none gives the empty string.  Equal places of equal priority and different labels all
stay.  Repeated rows each get their result.  Empty table: no rows.  Very long texts are read whole.
Only the id and text columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import _text
from strandline.llm._license_rules import RULES
from strandline.sources.tables import spread

#: Base phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# A text is matched as latin-1 of its UTF-8 bytes, so every byte of a non-ASCII character is a word byte.
_W = r"0-9a-z\x80-\xff"
_GAP = rf"(?:[^{_W}]++)"
_BEGIN, _END = rf"(?<![{_W}])", rf"(?![{_W}])"
_NUMBER = r"(\d+(?:\.\d+)*)"
#: "version 2.0", "v3" or a number right after the name, but no year.
_VERSION = rf"(?:[^{_W}]*+(?:version|ver|v)[^{_W}]*+{_NUMBER}|[ -]?(?!(?:19|20)\d\d(?!\d)){_NUMBER})"


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern[str]
    stem: str
    confidence: float
    priority: int
    keywords: tuple[str, ...]


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order: higher priorities first."""
    out = []
    for line in RULES.strip().split("\n"):
        label, confidence, priority, keywords, pattern = (part.strip() for part in line.split(" | ", 4))
        pattern = pattern.replace(" ", _GAP).replace("{v}", f"{_VERSION}?").replace("{V}", _VERSION).replace("{e}", _END)
        out.append(
            Rule(re.compile(_BEGIN + pattern + _END), label, int(confidence) / 100, int(priority), tuple(keywords.split(",")))
        )
    return tuple(sorted(out, key=lambda r: -r.priority))


@cache
def _base_patterns() -> tuple[tuple[re.Pattern[str], str, str], ...]:
    gap = rf"[^{_W}]+"
    return tuple(
        (re.compile(_BEGIN + gap.join(p.split()) + _END), label, max(p.split(), key=len)) for p, label in PHRASES.items()
    )


@cache
def _gate():
    """Automaton over all keywords of rules and base phrases."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for w in sorted({k for r in rules() for k in r.keywords} | {k for _, _, k in _base_patterns()}):
        automaton.add_word(w, w)
    automaton.make_automaton()
    return automaton


@cache
def _gated_rules() -> tuple[tuple[frozenset[str], Rule], ...]:
    return tuple((frozenset(r.keywords), r) for r in rules())


def detect(rule: Rule, text: str) -> Iterator[tuple[int, int, int, str, float]]:
    """(start, end, priority, label, confidence) of a rule's places."""
    for m in rule.pattern.finditer(text):
        version = next((g for g in m.groups() if g), None)
        label = rule.stem if not version else f"{rule.stem}-{version if '.' in version else version + '.0'}"
        yield m.start(), m.end(), rule.priority, label, rule.confidence


def suppress(found: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """Drop detections (start, end, priority, label, confidence) inside a stronger or, at equal priority, longer one."""
    kept: list[tuple[int, int, int, str, float]] = []
    starts, reach = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for priority in sorted({d[2] for d in found}, reverse=True):
        tier = sorted({d for d in found if d[2] == priority}, key=lambda d: (d[0], -d[1], d[3]))
        far, fresh = -1, []
        for d in tier:
            k = int(np.searchsorted(starts, d[0], "right")) - 1
            if far < d[1] and (k < 0 or reach[k] < d[1]):
                fresh.append(d)
            far = max(far, d[1])
        kept += fresh
        ordered = sorted((d[0], d[1]) for d in kept)
        starts = np.array([s for s, _ in ordered], np.int64)
        reach = np.maximum.accumulate(np.array([e for _, e in ordered], np.int64)) if ordered else starts
    return sorted(kept)


def scan(text: str) -> tuple[list[tuple[int, int, int, str, float]], list[tuple[int, int, str]]]:
    """(detections left, base places as (start, end, label)) of a lower-cased latin-1 text."""
    hits = {w for _, w in _gate().iter(text)}
    base = [(m.start(), m.end(), label) for p, label, key in _base_patterns() if key in hits for m in p.finditer(text)]
    found = [d for needs, rule in _gated_rules() if needs <= hits for d in detect(rule, text)]
    return suppress(found), base


_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, detections array<struct<start_byte:long,end_byte:long,label:string,confidence:double>>"
)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(
        pa.struct(
            [("start_byte", pa.int64()), ("end_byte", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())]
        )
    )
    for batch in _text.slices(batches):
        for part in _text.chunks(batch.column("text")):
            lowered = _text.LOWER[part.data]
            found = _text.words(_text.Chunk(part.first, part.last, lowered, part.offsets), _text.ALNUM, hashed=False)
            whole = lowered.tobytes().decode("latin-1")
            out: dict[str, list] = {k: [] for k in ("n_base", "first", "last", "base", "labels", "score", "spans")}
            for k in range(part.rows):
                a, b = int(part.offsets[k]), int(part.offsets[k + 1])
                kept, base = scan(whole[a:b])
                own = found.start[found.doc_first[k] : found.doc_first[k + 1]] - a
                at = np.searchsorted(own, [s for s, _, _ in base]) if base else None
                names = {label for _, _, label in base}
                out["n_base"].append(len(base))
                out["first"].append(int(at.min()) if base else None)
                out["last"].append(int(at.max()) if base else None)
                out["base"].append(",".join(sorted(names)))
                out["labels"].append(",".join(sorted(names | {d[3] for d in kept})))
                out["score"].append(max((d[4] for d in kept), default=0.6 if base else 0.0))
                out["spans"].append(
                    [{"start_byte": d[0], "end_byte": d[1], "label": d[3], "confidence": d[4]} for d in kept]
                )
            rows = slice(part.first, part.last)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id")[rows],
                    pa.array(found.count.astype(np.int64)),
                    pa.array(out["n_base"], pa.int64()),
                    pa.array(out["first"], pa.int64()),
                    pa.array(out["last"], pa.int64()),
                    pa.array(out["base"], pa.string()),
                    pa.array(out["labels"], pa.string()),
                    pa.array(out["score"], pa.float64()),
                    pa.array(out["spans"], kind),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
            )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with its words, base places, labels, score and the detections left."""
    source = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return source.mapInArrow(_scan_batches, _SCHEMA)
