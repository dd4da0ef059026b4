"""Stored tables: scans, point lookups, manifests, upserts, postings, and cuts of lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where it is unset and one machine runs all."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="cut-"))


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: iterations keep a short lineage that survives executors."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """The table itself where its plan has no shuffle, so that reading it again costs a scan; else ``cut``."""
    return cut(df) if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan" else df


_thread = threading.local()


def _made() -> list[str]:
    """Paths that this thread has cut and not deleted, in order."""
    if not hasattr(_thread, "paths"):
        _thread.paths = []
    return _thread.paths


def scoped(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function whose result is written, and whose own tables are deleted then: rounds leave nothing behind."""

    @wraps(make)
    def run(*args, **options) -> DataFrame:
        paths = _made()
        mark = len(paths)
        out = cut(make(*args, **options))
        jvm, conf = out.sparkSession._jvm, out.sparkSession._jsc.hadoopConfiguration()
        for path in paths[mark:-1]:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        del paths[mark:-1]
        return out

    return run


def spread(rows: DataFrame) -> DataFrame:
    """A scan with fewer splits than the cluster has cores is dealt to all of them.

    Splits are some megabytes at least, so what is shuffled is a few megabytes a core; larger scans, and
    plans that shuffle anyway, stay as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    planned = rows._jdf.queryExecution()
    if planned.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return rows
    return rows.repartition(cores) if planned.toRdd().getNumPartitions() < cores else rows


#: Rows of a side that goes to every task.
SMALL_ROWS = 1_000_000


def broadcast_if_small(rows: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """Sent to every task if it is at most so many rows, counted; else joined by a shuffle."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def manifest(chunks: DataFrame) -> DataFrame:
    """(path, mtime_ms): the newest finite time of each path."""
    return chunks.filter(F.col("mtime_ms").isNotNull()).groupBy("path").agg(F.max("mtime_ms").alias("mtime_ms"))


def diff_manifest(listing: DataFrame, known: DataFrame) -> DataFrame:
    """(path, state): ``changed`` (new or another time), ``unchanged`` or ``deleted``."""
    a, b = listing.select("path", F.col("mtime_ms").alias("now")), known.select("path", F.col("mtime_ms").alias("was"))
    state = (
        F.when(F.col("now").isNull(), "deleted")
        .when(F.col("was").isNull() | (F.col("now") != F.col("was")), "changed")
        .otherwise("unchanged")
    )
    return a.join(b, "path", "full").select("path", state.alias("state"))


def upsert(stored: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """The stored rows of other keys, and the new ones: delete by key, then append."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def evict(stored: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    return stored.join(gone.select(key).distinct(), key, "left_anti").select(*stored.columns)


def chunks_of(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.filter(F.col("path") == path).orderBy("line_start")


def chunk_at(chunks: DataFrame, path: str, line: int) -> DataFrame:
    """The chunk that covers a line, else the file's first."""
    covers = (F.col("line_start") <= line) & (F.col("line_end") >= line)
    return chunks.filter(F.col("path") == path).orderBy(F.desc(covers), "line_start").limit(1)


def split_by_cache(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks with a cached vector, chunks without) by content hash."""
    vectors = cache.select("content_hash", "embedding").filter("content_hash IS NOT NULL").dropDuplicates(["content_hash"])
    rows = chunks.drop("embedding")
    return rows.join(vectors, "content_hash"), rows.join(vectors, "content_hash", "left_anti")


def write_meta(spark: SparkSession, values: dict[str, str], root: str) -> None:
    """Replace the key-value table below a folder; readers see the old or the new one."""
    from strandline.sources.sinks import write_version

    write_version(spark.createDataFrame(sorted(values.items()), "key string, value string"), root)


def read_meta(spark: SparkSession, root: str) -> dict[str, str]:
    from strandline.sources.sinks import read_version

    return meta_map(read_version(spark, root))


def exists(spark: SparkSession, root: str) -> bool:
    """Whether a version of a table was ever written below a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def upsert_edges(stored: DataFrame, new: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges of other files, and the new ones of these: keyed by ``from_path``."""
    gone = paths.select(F.col("path").alias("from_path"))
    return evict(stored, gone, "from_path").unionByName(new, allowMissingColumns=True)


def meta_map(meta: DataFrame) -> dict[str, str]:
    """The key-value table on the driver; a row for each of a handful of keys."""
    return {r["key"]: r["value"] for r in meta.collect()}


def reextract_paths(edges: DataFrame, changed: DataFrame, deleted: DataFrame, declared: DataFrame) -> DataFrame:
    """Paths whose edges must be made again: changed ones, and those whose edges depend on changed or deleted ones.

    An edge depends on a path it targets or lists as candidate, and on a name that a changed file
    declares (calls: symbols; links and embeds: note keys).  Imports trigger nothing.
    """
    touched = changed.select("path").union(deleted.select("path")).distinct()
    live = edges.filter(F.col("kind") != "imports").select("kind", "from_path", "to_path", "ref_name", "candidates")
    by_target = live.join(touched, F.col("to_path") == F.col("path"), "left_semi").select("from_path")
    listed = live.select("from_path", F.explode("candidates").alias("candidate"))
    by_candidate = listed.join(touched, F.col("candidate") == F.col("path"), "left_semi").select("from_path")
    names = declared.join(changed.select("path").distinct(), "path", "left_semi").select("name").distinct()
    by_name = live.join(names, F.col("ref_name") == F.col("name"), "left_semi").select("from_path")
    found = by_target.union(by_candidate).union(by_name).select(F.col("from_path").alias("path"))
    return found.union(changed.select("path")).distinct().join(deleted.select("path"), "path", "left_anti")


# Lexical index


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def postings(chunks: DataFrame, id_col: str = "id", text_col: str = "fts_text", only: DataFrame | None = None) -> DataFrame:
    """(term, id, tf, doc_len): one row for each term of a chunk, of those in ``only`` (term) where given."""
    words = chunks.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("words"))
    each = words.select("id", F.size("words").alias("doc_len"), F.explode("words").alias("term"))
    if only is not None:
        each = each.join(broadcast_if_small(only.select("term").distinct()), "term", "left_semi")
    return each.groupBy("term", "id", "doc_len").agg(F.count("*").alias("tf")).select("term", "id", "tf", "doc_len")


def refresh_postings(stored: DataFrame, changed: DataFrame, deleted: DataFrame, id_col: str = "id", text_col: str = "fts_text") -> DataFrame:
    """Stored postings with those of deleted ids gone and those of changed chunks made again; others are not read as text."""
    gone = changed.select(F.col(id_col).alias("id")).union(deleted.select(F.col(id_col).alias("id")))
    return evict(stored, gone, "id").unionByName(postings(changed, id_col, text_col))


def corpus_stats(chunks: DataFrame, text_col: str = "fts_text") -> DataFrame:
    """(n_docs, avg_len): one row."""
    length = F.regexp_count(F.lower(F.col(text_col)), F.lit("[a-z0-9]+"))
    return chunks.agg(F.count("*").alias("n_docs"), F.avg(length).alias("avg_len"))


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in an order."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("__n = 1").drop("__n")
