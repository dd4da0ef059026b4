"""Mixing sources to target weights: capped water-filling and seeded repetition.

Sources ordered by code point (null last) weigh 3, 1, 2, repeating.  The mix is ``SHARE`` of all
words.  Capped water-filling: every source gets its weight's part of the mix, targets above
``MAX_EPOCHS`` times the source's size stop there and the excess is shared again by weight among the
others, until no target is above its cap.  That fixed point is one water level: target = min(cap,
weight * level), found by ordering sources by cap / weight and one pass of prefix sums.

A source takes floor(target / size) whole repetitions of every text and, in an order seeded by id and
text, one more of each text until the rest of its target is used; the text at the cut gives its first
words only (a fractional repetition), so a source's words equal its target rounded down, within 1.

DataFrame operations only.  The order inside a source is cut into ranges of the seeded hash whose
number follows the input, so a source, or an id, with a third of all rows stays spread; equal rows are
counted first.  Sources, however many, are ranked and summed in ranges as well.

Defined results.  Null or empty text: size 0, nothing taken.  Null source: a source, ordered last.
Null ids: ids like others.  Repeated rows stand one after another in the order, equal hashes go by size
and text.  Empty table: no rows.  Very long texts are read whole.  ``mix`` reads the named columns only
and ``mixed_rows`` carries the input's columns in one struct, so further columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._ranges import in_ranges, largest, matched, numbered, with_prefix_sums
from strandline.llm._scratch import Scratch

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_EPOCHS = 2
SEED = "strandline-mix"
RANGE_ROWS = 200_000


def water_fill(scratch: Scratch, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS,
               share_percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (source, source_size) to (source, source_size, target); one row a source."""
    cycle = F.array(*map(F.lit, weights))
    by_name = [F.col("source").asc_nulls_last()]
    sized = in_ranges(scratch, sizes.withColumn("one", F.lit(1)), by_name, "sources")
    named = with_prefix_sums(sized, [], ["part"], by_name, {"rank": "one"}).withColumn(
        "weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    )
    capped = named.drop("part").withColumn("cap", F.col("source_size") * max_epochs)
    capped = capped.withColumn("full_at", F.col("cap") / F.col("weight"))
    by_level = [F.col("full_at"), F.col("rank")]
    ordered = in_ranges(scratch, capped, by_level, "levels")
    whole = ordered.agg(F.sum("weight").alias("w"), F.sum("source_size").alias("s")).first()
    filled = with_prefix_sums(ordered, [], ["part"], by_level, {"full": "cap", "used": "weight"}).withColumn(
        "level", (F.lit((whole.s or 0) * share_percent / 100) - F.col("full")) / (F.lit(whole.w or 0) - F.col("used"))
    )
    # The first source (by cap / weight) whose cap the level does not reach fixes the level.
    fits = filled.filter(F.col("cap") >= F.col("weight") * F.col("level"))
    final = fits.agg(F.min(F.struct("full_at", "rank", "level")).alias("f")).first().f
    target = F.col("cap").cast("double")
    if final is not None:
        reached = F.col("cap") <= F.col("weight") * F.lit(final.level)
        target = F.when(reached, target).otherwise(F.col("weight") * F.lit(final.level))
    return ordered.select("source", "source_size", target.alias("target"))


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """(doc_id, source, text_hash, seeded, size, copies): distinct rows with how often each occurs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).alias("source"),
        F.xxhash64(text).alias("text_hash"),
        F.md5(F.concat(F.lit(seed + ":"), own, F.lit(":"), F.md5(text))).alias("seeded"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
    )
    return rows.groupBy("doc_id", "source", "text_hash", "seeded", "size").agg(F.count("*").alias("copies"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED
) -> DataFrame:
    """(doc_id, source, text_hash, nth, size, source_size, target, whole, extra, taken) of each row.

    ``whole`` repetitions of the text and its first ``extra`` words; ``nth`` numbers repeated rows from 1.
    """
    return _mix(docs, id_col, text_col, source_col, seed)[0]


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> tuple[DataFrame, int]:
    """The rows of ``mix`` and how often an equal row occurs at most."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(_measured(docs, id_col, text_col, source_col, seed), "rows")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    targets = scratch.save(water_fill(scratch, sizes), "targets")
    scratch.keep("rows", "targets")
    seeded = rows.withColumn("total", F.col("size") * F.col("copies"))
    # The first hex digits of the seeded hash, two or as many as the rows ask for, cut a source's order into ranges.
    digits, count = 2, rows.count()
    while 16**digits * RANGE_ROWS < count:
        digits += 1
    seeded = seeded.withColumn("part", F.substring("seeded", 1, digits))
    placed = with_prefix_sums(seeded, ["source"], ["part"], ["seeded", "size", "text_hash"], {"before": "total"})
    named = targets.withColumnRenamed("source", "named")
    joined = placed.join(named, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    most = largest(rows, "copies")
    each = numbered(joined, "copies", "nth", most)
    goal = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = goal - whole * F.col("source_size")
    start = F.col("before") + F.col("nth") * F.col("size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    taken = each.select(
        "doc_id", "source", "text_hash", (F.col("nth") + 1).alias("nth"), "size", "source_size", "target",
        whole.alias("whole"), extra.alias("extra"), (whole * F.col("size") + extra).alias("taken"),
    )
    return taken, most


def _keys(source, doc_id, text_hash) -> dict:
    return {"k_source": (source, ""), "k_id": (doc_id, 0), "k_hash": (text_hash, 0)}


def mixed_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED
) -> DataFrame:
    """The mix itself: rows of ``docs`` repeated as often as taken; a fractional repetition holds its first words."""
    taken, most = _mix(docs, id_col, text_col, source_col, seed)
    taken = matched(
        taken.filter("taken > 0").select("source", "doc_id", "text_hash", "whole", "extra", "size"),
        _keys(F.col("source").cast("string"), F.col("doc_id"), F.col("text_hash")),
    )
    keys = [c for k in _keys(F.lit(0), F.lit(0), F.lit(0)) for c in (k, f"{k}_null")]
    taken = taken.groupBy(*keys).agg(
        F.sum(F.col("whole") + (F.col("extra") == F.col("size")).cast("long")).alias("whole"),
        F.max(F.when(F.col("extra") < F.col("size"), F.col("extra")).otherwise(F.lit(0))).alias("part"),
    )
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    own = _keys(F.col(source_col).cast("string"), F.col(id_col).cast("long"), text_hash)
    rows = matched(docs.select(F.struct("*").alias("row"), *(v.alias(k) for k, (v, _) in own.items())),
                   _keys(*(F.col(k) for k in own)))
    joined = rows.dropDuplicates(keys).join(taken, keys).select("row", "k_id", "k_hash", "whole", "part")
    # Words with the blanks before them: joined again, the first ones are a prefix of the text.
    pieces = F.regexp_extract_all(F.col("row")[text_col], F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(pieces, F.lit(1), F.col("part").cast("int")), "")
    times = F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)
    repeated = numbered(joined.withColumn("times", times), "times", "nth", MAX_EPOCHS * most + 1, ["k_id", "k_hash"])
    text = F.when(F.col("nth") >= F.col("whole"), head).otherwise(F.col("row")[text_col])
    return repeated.select(F.col("row").withField(f"`{text_col}`", text).alias("row")).select("row.*").select(*(F.col(f"`{c}`") for c in docs.columns))


#: DuckDB: the same rows for the query over ``documents``.
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, text,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS BIGINT) AS size,
    md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS seeded
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * 2 AS cap FROM n),
f AS (
  SELECT *, coalesce(sum(cap) OVER earlier, 0)::DOUBLE AS filled,
    (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0))::DOUBLE AS opened,
    (sum(source_size) OVER () * 150)::DOUBLE / 100 AS mix
  FROM w WINDOW earlier AS (
    ORDER BY cap::DOUBLE / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (mix - filled) / opened AS level FROM f),
g AS (SELECT arg_min(level, (cap::DOUBLE / weight, rk)) AS final FROM l WHERE cap >= weight * level),
t AS (
  SELECT source, source_size,
    CASE WHEN final IS NULL OR cap <= weight * final THEN cap::DOUBLE ELSE weight * final END AS target FROM l, g),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS whole,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.seeded, d.size, d.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(whole * size
  + greatest(0, least(size, CAST(floor(target) AS BIGINT) - whole * source_size - before)) AS BIGINT) AS taken
FROM p
"""
