"""Quality rules by host: failures of each rule aggregated by domain, rates shrunk by an empirical beta prior.

Words are maximal runs of characters other than space and the controls 9-13.  Each document gets
its counts, the failures of ``RULES`` and a base verdict (too short, or too repetitive).

The failures of each rule, and of any rule, are summed by domain.  A rule's beta prior is fitted by the
method of moments to the rates of the domains that do not mostly fail it (all, if every one does), so a
few bad domains do not speak for the others.  A domain's shrunk rate is its posterior mean.  It fails
when that passes the rule's limit: ``DEVIATIONS`` standard deviations of the prior above its mean, and
half of its documents at least.  All documents of a domain that fails any rule go.

Defined results.  Null or empty text: zero counts, base failed.  Null domain: a domain of its own.
Equal rates everywhere: the prior has ``flat_strength`` pseudo-documents at the mean.  A rate or ratio
exactly at its limit passes.  Empty table: no rows.  Repeated rows count as often as they occur.  Very
long texts are read whole.  Only the named columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import _text
from strandline.llm._scratch import Scratch
from strandline.sources.tables import spread

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
MAJORITY = 0.5
DEVIATIONS = 3.0
FLAT_STRENGTH = 10.0
_SYMBOL = _text.byte_class(lambda b: chr(b) in "#*$%&|<>")
_IN_LINE = _text.byte_class(lambda b: b != 10)


def _repeated_words(found: _text.Words, rows: int) -> np.ndarray:
    """Words per document inside three-word windows that occur at least twice in it."""
    window, first = _text.ngrams(found, 3)
    covered = np.zeros(len(found.start) + 3, bool)
    if len(window):
        doc = np.repeat(np.arange(rows), np.diff(first))
        order = np.lexsort((window, doc))
        h, d = window[order], doc[order]
        same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        twice = np.zeros(len(h), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = order[twice]
        at = found.doc_first[doc[hit]] + hit - first[doc[hit]]
        for k in range(3):
            covered[at + k] = True
    return _text.sum_by_doc(covered[: len(found.start)].astype(np.int64), found.doc_first)


def _lines(part: _text.Chunk, found: _text.Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those among them that equal an earlier line of their document."""
    lines = _text.words(part, _IN_LINE)
    has_word = np.searchsorted(found.start, lines.end) > np.searchsorted(found.start, lines.start)
    doc, digest = lines.doc()[has_word], lines.hash[has_word]
    order = np.lexsort((digest, doc))
    doc, digest = doc[order], digest[order]
    again = np.zeros(len(doc), bool)
    again[1:] = (doc[1:] == doc[:-1]) & (digest[1:] == digest[:-1])
    return tuple(np.bincount(d, minlength=part.rows).astype(np.int64) for d in (doc, doc[again]))


def count_features(part: _text.Chunk) -> dict[str, np.ndarray]:
    found = _text.words(part, _text.SPACED)
    n_lines, n_dup_lines = _lines(part, found)
    letters = (_text.SPACED[part.data] & ((part.data & 0xC0) != 0x80)).astype(np.int64)
    return {
        "n_words": found.count.astype(np.int64),
        "word_chars": _text.sum_by_doc(letters, part.offsets),
        "n_symbols": _text.sum_by_doc(_SYMBOL[part.data].astype(np.int64), part.offsets),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": _repeated_words(found, part.rows),
        "n_lines": n_lines,
    }


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Rules by name, true where a document fails.
RULES: dict[str, str] = {
    "short": f"n_words < {MIN_WORDS}",
    "repetitive": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": f"100 * n_symbols > {MAX_SYMBOL_PERCENT} * n_words",
    "repeated lines": f"100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines",
}
BASE = ("short", "repetitive")


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _text.slices(batches):
        for part in _text.chunks(batch.column("text")):
            counted = count_features(part)
            rows = slice(part.first, part.last)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[rows], batch.column("host")[rows], *(pa.array(counted[c]) for c in _COUNTS)],
                ["doc_id", "host", *_COUNTS],
            )


def document_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """(doc_id, host, the counts, base_failed) of each row."""
    named = F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text")
    source = spread(docs.select(*named))
    counted = source.mapInArrow(
        _count_batches, "doc_id long, host string, " + ", ".join(f"{c} long" for c in _COUNTS)
    )
    return counted.withColumn("base_failed", F.expr(" OR ".join(f"({RULES[r]})" for r in BASE)))


def host_rates(
    counted: DataFrame, majority: float = MAJORITY, deviations: float = DEVIATIONS, flat_strength: float = FLAT_STRENGTH
) -> DataFrame:
    """(host, rule, n_docs, n_failed, rate, shrunk_rate, rate_limit, rule_failed): a row for each host and rule."""
    rules = {**RULES, "any": " OR ".join(f"({r})" for r in RULES.values())}
    sums = {name: F.sum(F.expr(rule).cast("long")) for name, rule in rules.items()}
    hosts = counted.groupBy("host").agg(F.count("*").alias("n_docs"), F.create_map(
        *(c for name, value in sums.items() for c in (F.lit(name), value))
    ).alias("failed"))
    rates = hosts.select("host", "n_docs", F.explode("failed").alias("rule", "n_failed"))
    rates = rates.withColumn("rate", F.col("n_failed") / F.col("n_docs"))
    most = F.when(F.col("rate") <= majority, F.col("rate"))
    prior = rates.groupBy("rule").agg(
        F.coalesce(F.avg(most), F.avg("rate")).alias("mean"), F.coalesce(F.var_pop(most), F.var_pop("rate")).alias("spread")
    )
    moments = F.col("mean") * (1 - F.col("mean")) / F.col("spread") - 1
    prior = prior.withColumn(
        "strength", F.when((F.col("spread") > 1e-12) & (moments > 0), moments).otherwise(F.lit(flat_strength))
    )
    shrunk = (F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    limit = F.greatest(F.lit(majority), F.col("mean") + deviations * F.sqrt("spread"))
    return (
        rates.join(F.broadcast(prior), "rule")  # a row for each rule
        .withColumn("shrunk_rate", shrunk)
        .withColumn("rate_limit", limit)
        .withColumn("rule_failed", F.col("shrunk_rate") > F.col("rate_limit"))
        .drop("mean", "spread", "strength")
    )


def host_verdicts(counted: DataFrame, **options) -> DataFrame:
    """(host, n_docs, n_failed, rate, shrunk_rate, failed_rules, host_failed): a row for each host; rates of any rule."""
    broken = F.sort_array(F.collect_list(F.when(F.col("rule_failed"), F.col("rule"))))  # at most one for each rule
    return (
        host_rates(counted, **options)
        .groupBy("host", "n_docs")
        .agg(*(F.max(F.when(F.col("rule") == "any", F.col(c))).alias(c) for c in ("n_failed", "rate", "shrunk_rate")),
             broken.alias("failed_rules"))
        .withColumn("host_failed", F.size("failed_rules") > 0)
    )


def apply_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **options
) -> DataFrame:
    """The counts of each row with its host's shrunk rate and the verdict ``kept``."""
    # Texts are read once: hosts and verdicts both come from the written counts.
    counted = Scratch(docs.sparkSession).save(document_counts(docs, id_col, text_col, host_col), "counts")
    hosts = host_verdicts(counted, **options).select(F.col("host").alias("__host"), "shrunk_rate", "failed_rules", "host_failed")
    joined = counted.join(hosts, F.col("host").eqNullSafe(F.col("__host")), "left").drop("__host")
    return joined.withColumn("kept", ~(F.col("base_failed") | F.coalesce("host_failed", F.lit(False))))


#: DuckDB: the same rows for the query over ``documents`` with hosts from ``source``.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^ \t-\r]+') AS ws FROM d),
windows AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, i AS p FROM twice UNION ALL SELECT rid, i + 1 FROM twice UNION ALL SELECT rid, i + 2 FROM twice)
  GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
dups AS (
  SELECT rid, count(*) AS lines, count(*) - count(DISTINCT line) AS n
  FROM lines WHERE regexp_matches(line, '[^ \t-\r]') GROUP BY rid),
c AS (
  SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[ \t-\r]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(dups.lines, 0) AS n_lines
  FROM w LEFT JOIN covered USING (rid) LEFT JOIN dups USING (rid)),
b AS (
  SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repetitive, 100 * n_symbols > 10 * n_words AS symbols,
    100 * n_dup_lines > 30 * n_lines AS repeated FROM c),
r AS (
  SELECT source, count(*) AS n, unnest([
    {'rule': 'short', 'f': sum(short::INT)}, {'rule': 'repetitive', 'f': sum(repetitive::INT)},
    {'rule': 'symbols', 'f': sum(symbols::INT)}, {'rule': 'repeated', 'f': sum(repeated::INT)},
    {'rule': 'any', 'f': sum((short OR repetitive OR symbols OR repeated)::INT)}]) AS x
  FROM b GROUP BY source),
h AS (SELECT source, n, x.rule AS rule, x.f AS f, x.f / n AS r FROM r),
p AS (
  SELECT rule, coalesce(avg(r) FILTER (r <= 0.5), avg(r)) AS m, coalesce(var_pop(r) FILTER (r <= 0.5), var_pop(r)) AS v
  FROM h GROUP BY rule),
q AS (SELECT *, CASE WHEN v > 1e-12 AND m * (1 - m) / v - 1 > 0 THEN m * (1 - m) / v - 1 ELSE 10.0 END AS s FROM p),
g AS (
  SELECT source, bool_or((f + m * s) / (n + s) > greatest(0.5, m + 3.0 * sqrt(v))) AS host_failed
  FROM h JOIN q USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed,
  NOT (short OR repetitive OR host_failed) AS kept
FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source
"""
