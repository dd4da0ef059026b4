"""Query parameters with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # The defaults that results depend on.
    max_chars: int = 2000
    min_chars: int = 100
    overlap_chars: int = 400
    max_file_bytes: int = 262_144
    embed_batch: int = 32
    max_embed_chars: int = 6000
    rerank_candidates: int = 24
    rerank_max_chars: int = 2000
    bm25_boost: int = 3
    test_penalty: float = 0.5
    find_candidates: int = 200
    centrality_weight: float = 0.15
    centrality_k: float = 8.0
    centrality_tie_eps: float = 1e-6
    context_cap: int = 5
    related_notes_cap: int = 8
    metrics_window: int = 1000
    cochange_min_support: int = 3
    metrics_max_commit_files: int = 25
    conn_k: int = 12
    conn_graph_weight: float = 0.25
    conn_graph_hops: int = 2
    conn_fusion: bool = True
    cross_link_cap: int = 15
    context_k: int = 5
    margin_high: float = 0.30
    margin_low: float = 0.08
    disambiguate: bool = True
    disambiguate_threshold: float = 0.55
    disambiguate_margin: float = 0.05
    fts_weight: float = 0.0
    fts_weight_symbol: float = 1.0
    fts_weight_mixed: float = 1.0
    rrf_k: int = 60
    bm25_k1: float = 1.2
    bm25_b: float = 0.75


DEFAULTS = Params()
NOTES = Params(max_chars=1500, min_chars=80, overlap_chars=200, max_embed_chars=2000)


def embedding_identity(model: str, backend: str = "http", dtype: str | None = None) -> str:
    """Namespace of cached vectors: in-process models carry backend and dtype, served ones their name."""
    return f"{model}|{backend}|{dtype}" if backend == "transformers" else model
