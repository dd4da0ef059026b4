"""Global orders without a global sort in one task, by DataFrame operations alone.

Rows are dealt to buckets that are contiguous in the order; sums inside a bucket come from a window
over that bucket, and what lies before it from a prefix sum over the buckets' totals, whose number is
a parameter and not the data's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm._scratch import Scratch

#: Copies of a row that one array may hold.
RUN = 4096


def with_prefix_sums(
    rows: DataFrame, group: list[str], bucket: list[str], order: list[str | Column], sums: dict[str, str]
) -> DataFrame:
    """Add, for each (new name: column), the sum over the earlier rows of the same group.

    ``group`` may be empty: one order of all rows.  ``bucket`` columns order before ``order`` and split a group into contiguous parts; the totals
    table has a row for each group and bucket and is broadcast only if Spark's own size check says so.
    """
    keys = [*group, *bucket]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys).agg(*(F.sum(c).alias(f"__t_{n}") for n, c in sums.items()))
    totals = totals.select(
        *(F.col(k).alias(f"__k_{k}") for k in keys),
        *(F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums),
    )
    local = rows.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__i_{n}") for n, c in sums.items()))
    matched = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        matched = term if matched is None else matched & term
    return local.join(totals, matched).select(
        *rows.columns, *((F.col(f"__b_{n}") + F.col(f"__i_{n}")).alias(n) for n in sums)
    )


def numbered(rows: DataFrame, copies: str, name: str, most: int, by: list[str] | None = None) -> DataFrame:
    """Each row ``copies`` (at most ``most``) times, numbered from 0 in a new column ``name``.

    Numbers come in runs of ``RUN``, and where a row can have more copies than that its runs are dealt
    out by the columns ``by`` (all, if not given) and the run, so the copies of one row are neither one
    array nor one task's.
    """
    columns = [*rows.columns, name]
    last = F.col(copies) - 1
    runs = rows.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / RUN))))
    if most > RUN:
        runs = runs.repartition(*(by or rows.columns), "__run")
    begin = F.col("__run") * RUN
    return runs.withColumn(name, F.explode(F.sequence(begin, F.least(last, begin + RUN - 1)))).select(*columns)


def largest(rows: DataFrame, column: str) -> int:
    """The largest value of a column of a written table; 0 without rows."""
    return rows.agg(F.max(column).alias("m")).first().m or 0


def in_ranges(scratch: Scratch, rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Written, with a column ``part``: ranges of rows that are contiguous in the order, for ``with_prefix_sums``."""
    return scratch.save(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)


def matched(rows: DataFrame, keys: dict[str, tuple[Column, object]]) -> DataFrame:
    """Rows with key columns that hold no nulls: each key, its default where null, and whether it is null.

    Equal keys are then plain equalities, so a distinct and a join by them need one shuffle between them.
    """
    out = {}
    for name, (value, default) in keys.items():
        out[name] = F.coalesce(value, F.lit(default))
        out[f"{name}_null"] = value.isNull()
    return rows.withColumns(out)
