"""Evaluation runs over an index: metrics of a golden table and the drops against a baseline.

Every run gives (metrics, regressions): a metric regresses when it falls by more than the run's tolerance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.vector import hash_embedding
from strandline.operators import evaluate, search
from strandline.params import DEFAULTS, Params
from strandline.plans import verbs
from strandline.plans.index import Index

#: How far a metric may fall.
TOLERANCE = {"retrieval": 0.02, "edges": 0.02, "orphans": 0.005, "disambiguation": 0.02}


def _gate(metrics: DataFrame, baseline: DataFrame | None, kind: str, tiers: tuple[str, ...] = ("all",)) -> tuple[DataFrame, DataFrame | None]:
    if baseline is None:
        return metrics, None
    compared = evaluate.compare_baseline(metrics, baseline, TOLERANCE[kind], tiers)
    return metrics, compared.filter("regressed")


def run_retrieval(index: Index, golden: DataFrame, baseline: DataFrame | None = None, k: int = 10, vectors: DataFrame | None = None, params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame | None]:
    """Recall, MRR and section hits of (query, paths, lines, tier), all queries in one plan."""
    asked = golden.select(F.col("query").alias("query_id"), "query").distinct()
    if vectors is None:
        dims = F.size(F.first("embedding", ignorenulls=True))
        width = index.chunks.agg(dims.alias("n")).first().n or 64
        vectors = asked.select("query_id", hash_embedding(F.col("query"), width).alias("query_vector"))
    hits = search.search_batch(index.chunks, index.postings, index.stats, asked, vectors, min(max(k, 1), 50), params=params)
    ranks = evaluate.golden_ranks(golden, hits.select(F.col("query_id").alias("query"), "rank", "path", "lines"))
    return _gate(evaluate.retrieval_metrics(ranks), baseline, "retrieval", ("all", "gate"))


def run_edges(index: Index, golden: DataFrame, baseline: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Recall of golden edges (from, symbol, kind, to) by language and overall."""
    metrics = evaluate.edge_metrics(evaluate.edge_tally(golden, index.edges)).withColumnRenamed("ext", "tier")
    return _gate(metrics, baseline, "edges")


def run_orphans(index: Index, golden: DataFrame, baseline: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Accuracy of the dead-code classes of (path, symbol, expect)."""
    metrics = evaluate.orphan_metrics(golden, verbs.orphans(index)).withColumn("tier", F.lit("all"))
    return _gate(metrics, baseline, "orphans")


def run_disambiguation(index: Index, golden: DataFrame, baseline: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Precision, recall and abstention of promoted calls against (from_path, symbol, expect)."""
    promoted = index.edges.filter("kind = 'calls' AND conf = 'inferred'").select("from_path", F.col("ref_name").alias("symbol"), "to_path").distinct()
    metrics = evaluate.disambiguation_metrics(golden, promoted).withColumn("tier", F.lit("all"))
    return _gate(metrics, baseline, "disambiguation")
