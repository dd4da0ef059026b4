"""Live refresh: debounced change batches, a busy gate, periodic sweeps; batch twins of the windows.

A batch closes after ``gap`` of quiet in event time; the stream emits it once the watermark has
passed.  ``TIMESTAMP_NTZ`` columns are cast, as watermarks need an instant.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def change_batches(events: DataFrame, gap: str = "30 seconds", late: str = "1 minute", key: str | None = None) -> DataFrame:
    """(key, start, end, paths, n): distinct paths of (ts, path, event) by session window; batch or stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    by = [F.session_window("ts", gap).alias("w"), *([key] if key else [])]
    grouped = rows.groupBy(*by).agg(F.sort_array(F.collect_set("path")).alias("paths"), F.count("*").alias("n"))
    return grouped.select(*([key] if key else []), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "paths", "n")


def sessions_by_gap(events: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """(key, start, n): the batch twin by lag and running count; a gap of exactly the limit opens a new session."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.withColumn("at", at).withColumn("before", F.lag("at").over(order))
    opens = F.col("before").isNull() | (F.col("at") - F.col("before") >= gap_seconds * 1_000_000)
    rows = rows.withColumn("session", F.sum(opens.cast("int")).over(order))
    return rows.groupBy(key, "session").agg(F.min("at").alias("start"), F.max("at").alias("last"), F.count("*").alias("n"))


def sweeps(events: DataFrame, every: str = "5 minutes", late: str = "1 minute") -> DataFrame:
    """(start, n, paths): tumbling windows for full sweeps."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", every).alias("w")).agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths") if not rows.isStreaming else F.approx_count_distinct("path").alias("paths")).select(F.col("w.start").alias("start"), "n", "paths")


def live_holders(beats: DataFrame, now: str, stale: str = "150 seconds") -> DataFrame:
    """(holder, last, alive): whether a watcher's last heartbeat is recent enough."""
    last = beats.groupBy("holder").agg(F.max(F.col("ts").cast("timestamp")).alias("last"))
    limit = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {stale}")
    return last.withColumn("alive", F.col("last") >= limit)


def last_events(batch: DataFrame) -> DataFrame:
    """(path, event): the last event of each path of a micro-batch; unlinks are evictions."""
    return batch.groupBy("path").agg(F.max_by("event", F.struct("ts", "event")).alias("event"))


class Busy(RuntimeError):
    """The source stayed in the middle of an operation: the batch is not committed and comes again."""


def wait_until_free(busy: Callable[[], bool], poll: float = 1.0, patience: float = 600.0) -> float:
    """Seconds waited until ``busy`` says no; ``Busy`` after ``patience`` of them."""
    waited = 0.0
    while busy():
        if waited >= patience:
            raise Busy
        time.sleep(poll)
        waited += poll
    return waited


def refresh_on_change(
    events: DataFrame, refresh: Callable[[DataFrame, DataFrame], None], checkpoint: str, busy: Callable[[], bool] = lambda: False, once: bool = False,
    poll: float = 1.0, patience: float = 600.0, stale_tables: tuple[str, ...] = (),
) -> StreamingQuery:
    """Call ``refresh(changed, deleted)`` for each micro-batch, then drop what is cached of ``stale_tables``.

    While the source is busy the batch waits and events gather for the next one; the stream goes on.
    """

    def run(batch: DataFrame, _: int) -> None:
        wait_until_free(busy, poll, patience)
        last = last_events(batch).persist()
        try:
            if last.limit(1).count():
                refresh(last.filter("event <> 'unlink'").select("path"), last.filter("event = 'unlink'").select("path"))
                for name in stale_tables:
                    batch.sparkSession.catalog.refreshTable(name)
        finally:
            last.unpersist()

    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
