"""Sharding by size: global prefix sums of byte sizes from bucket totals, cut at equal targets.

Order: doc_id (nulls first), then the hash of the text.  Sizes are UTF-8 bytes of the text (null:
none) plus 1.  A row goes to shard floor(bytes before it * shards / all bytes), so shards are
contiguous and differ from the target by less than the row at each cut.  Law ``bytes``.

DataFrame operations only.  The order's buckets are ranges of doc_id between quantiles, cut again at
equal steps of the id where the input is large; an id that fills several quantiles is split further by
the text's hash; equal rows are counted first and numbered afterwards in runs, so a third of all rows
being one id, one text or one row stays spread.

Defined results.  Null text: size 1, crc32 0.  Null ids and repeated rows: rows like others.  Ties in
the order: by size and crc32.  Empty table: no rows.  Very long texts: one row each, whatever a shard's
target.  Only the id and text columns are read, so further columns of any name do no harm.
``grown_shard`` is null, as the law is not ``key``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._ranges import largest, numbered, with_prefix_sums
from strandline.llm._scratch import Scratch

SHARDS = 16
RANGES = 256
RANGE_ROWS = 200_000


def shard_by_bytes(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    share = [k / ranges for k in range(1, ranges)]
    seen = ids.agg(  # ``ranges`` numbers
        F.percentile_approx("doc_id", share, 10 * ranges).alias("cuts"),
        F.count("*").alias("rows"),
        F.min("doc_id").alias("low"),
        F.max("doc_id").alias("high"),
    ).first()
    cuts = sorted(seen.cuts or [])
    hot = sorted({c for a, c in zip(cuts, cuts[1:]) if a == c})
    distinct = sorted(set(cuts))
    # Ranges: the number of cuts at or below the id, from a literal array of bounded length.
    literal = F.array(*(F.lit(c).cast("long") for c in distinct)) if distinct else F.array().cast("array<long>")
    below = F.size(F.filter(literal, lambda c: c <= F.col("doc_id")))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    mixed = F.xxhash64("size", "text_crc32")
    is_hot = F.col("doc_id").isNull() | (F.col("doc_id").isin(hot) if hot else F.lit(False))
    rows = rows.select(
        "*",
        mixed.alias("mixed"),
        F.when(F.col("doc_id").isNull(), -1).otherwise(below).alias("range"),
        F.when(is_hot, F.shiftright(mixed, 56)).otherwise(F.lit(-1000)).alias("part"),
        (F.col("size") * F.col("copies")).alias("bytes"),
        # A hot id orders before the other ids of its range: cuts are at ids, so it is the least one there.
        F.when(is_hot, 0).otherwise(1).alias("rank_in_range"),
    )
    steps, step = seen.rows // (ranges * range_rows), F.lit(0)
    if steps > 1:
        edges = F.array(*(F.lit(float(c)) for c in (seen.low or 0, *distinct, seen.high or 0)))
        low, high = F.get(edges, F.col("range")), F.get(edges, F.col("range") + 1)
        along = (F.col("doc_id").cast("double") - low) / (high - low) * steps
        step = F.when((F.col("range") >= 0) & (high > low), F.least(F.floor(along), F.lit(steps - 1))).otherwise(0)
    saved = Scratch(spark).save(rows.withColumn("step", step.cast("long")), "rows")
    total = saved.agg(F.sum("bytes").alias("b")).first().b
    placed = with_prefix_sums(
        saved, [], ["range", "rank_in_range", "step", "part"], ["doc_id", "mixed", "size", "text_crc32"],
        {"bytes_before": "bytes", "rows_before": "copies"},
    )
    each = numbered(placed, "copies", "nth", largest(saved, "copies")).select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("bytes_before") + F.col("nth") * F.col("size")).alias("start"),
        (F.col("rows_before") + F.col("nth")).alias("position"),
    )
    # Start * shards / total without overflow: decimals hold 38 digits.
    shard = F.expr(f"cast((cast(start as decimal(25,0)) * {shards}) div {max(total or 1, 1)} as int)")
    each = each.withColumn("shard", shard)
    first = each.groupBy("shard").agg(F.min("position").alias("first_position"))  # a row for each shard
    return each.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("position") - F.col("first_position")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
