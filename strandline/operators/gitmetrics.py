"""Version-history metrics: co-change coupling and hotspots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import floor_to
from strandline.params import DEFAULTS, Params


def commit_files(commits: DataFrame) -> DataFrame:
    """(hash, file): distinct files of each commit."""
    return commits.select("hash", F.explode(F.array_distinct("files")).alias("file"))


def usable(pairs: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Without commits of more files than the limit, so the self join below is bounded by it."""
    sizes = pairs.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") <= params.metrics_max_commit_files)
    return pairs.join(sizes.select("hash"), "hash", "left_semi")


def skipped_commits(pairs: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    sizes = pairs.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") > params.metrics_max_commit_files)
    return sizes.agg(F.count("*").alias("skipped_large_commits"))


def cochange(pairs: DataFrame, edge_pairs: DataFrame | None = None, limit: int | None = None, params: Params = DEFAULTS) -> DataFrame:
    """(a, b, count, confidence, call_edge): files that change together; pairs without a call edge first."""
    rows = usable(pairs.distinct(), params)
    freq = rows.groupBy("file").agg(F.count("*").alias("freq"))
    # The files of a commit are at most ``metrics_max_commit_files``: pairs are made inside a bounded array.
    files = rows.groupBy("hash").agg(F.sort_array(F.collect_list("file")).alias("files"))
    each = files.select(F.posexplode("files").alias("at", "a"), "files").select(
        "a", F.explode(F.slice("files", F.col("at") + 2, F.size("files"))).alias("b")
    )
    support = each.groupBy("a", "b").agg(F.count("*").alias("count")).filter(F.col("count") >= params.cochange_min_support)
    joined = support.join(freq.withColumnsRenamed({"file": "a", "freq": "fa"}), "a").join(freq.withColumnsRenamed({"file": "b", "freq": "fb"}), "b")
    rows = joined.withColumn("confidence", floor_to(F.col("count") / F.least("fa", "fb"), 2))
    if edge_pairs is None:
        rows = rows.withColumn("call_edge", F.lit(None).cast("boolean"))
    else:
        known = edge_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("call_edge", F.lit(True))
        rows = rows.join(known, ["a", "b"], "left").withColumn("call_edge", F.coalesce("call_edge", F.lit(False)))
    rows = rows.select("a", "b", "count", "confidence", "call_edge")
    first = F.when(F.col("call_edge") == False, 0).otherwise(1)  # noqa: E712  null is neither
    ordered = rows.orderBy(first, F.desc("confidence"), F.desc("count"), "a", "b")
    return ordered.limit(limit) if limit else ordered


def call_edge_pairs(edges: DataFrame) -> DataFrame:
    """(a, b): files joined by resolved, inferred or dispatch calls, candidates included."""
    calls = edges.filter("kind = 'calls' AND conf IN ('resolved', 'inferred', 'dispatch')")
    targets = F.when(F.col("conf") == "dispatch", F.col("candidates")).otherwise(F.array("to_path"))
    pairs = calls.select(F.col("from_path").alias("s"), F.explode(targets).alias("t")).filter("t IS NOT NULL AND s <> t")
    return pairs.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()


def hotspots(pairs: DataFrame, loc: DataFrame, limit: int | None = 20, params: Params = DEFAULTS) -> DataFrame:
    """(file, revisions, loc, score): commits of a file times its lines; files without lines are left out."""
    revisions = usable(pairs.distinct(), params).groupBy("file").agg(F.count("*").alias("revisions"))
    rows = revisions.join(loc, "file").withColumn("score", F.col("revisions") * F.col("loc"))
    ordered = rows.select("file", "revisions", "loc", "score").orderBy(F.desc("score"), "file")
    return ordered.limit(limit) if limit else ordered
