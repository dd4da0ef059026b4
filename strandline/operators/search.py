"""Hybrid search: vector top-k, BM25, reciprocal-rank fusion, priors, rerank, tie-breaks, margins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import predicates, symbols, text
from strandline.functions.vector import Best, cosine, nearest_rows
from strandline.params import DEFAULTS, Params
from strandline.sources.tables import broadcast_if_small, cut, tokens


def clamp_k(k: object, default: int = 8, most: int = 50) -> int:
    """Integer part of k, the default for anything false, then 1..most."""
    try:
        n = int(k)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        n = 0
    return min(max(n or default, 1), most)


def fanout(limit: int, rerank: bool = False, params: Params = DEFAULTS) -> int:
    extra = min(50, params.rerank_candidates) if rerank else 0
    return min(50, max(3 * limit, 16, extra))


def lexical_weight(kind: str, params: Params = DEFAULTS) -> float:
    """Weight of the lexical branch: a bare symbol, a question with identifiers, plain language."""
    return {"symbol": params.fts_weight_symbol, "mixed": params.fts_weight_mixed}.get(kind, params.fts_weight)


def query_kind(queries: DataFrame, column: str = "query") -> DataFrame:
    q = F.col(column)
    kind = F.when(predicates.is_symbol_query(q), "symbol").when(predicates.has_identifier(q), "mixed").otherwise("plain")
    return queries.withColumn("kind", kind)


def prefilter(chunks: DataFrame, path_prefix: str | None = None, language: str | None = None) -> DataFrame:
    """Applied to both branches before ranking; the prefix is literal."""
    if path_prefix:
        chunks = chunks.filter(F.col("path").startswith(path_prefix))
    return chunks.filter(F.col("language") == language) if language else chunks


def vector_top(chunks: DataFrame, query: Column, n: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, similarity, vec_rank): flat cosine scan; the sort is a bounded top-k in every task."""
    scored = chunks.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), query).alias("similarity"))
    top = scored.orderBy(F.desc("similarity"), "id").limit(n)
    return top.withColumn("vec_rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")))


def vector_top_batch(
    chunks: DataFrame, queries: DataFrame, n: int, id_col: str = "id", vector_col: str = "embedding", digits: int | None = None,
    skip_equal: bool = False, group_bytes: int = 16_000_000,
) -> DataFrame:
    """(query_id, id, similarity, vec_rank): the n nearest of every query vector (query_id, query_vector), by cosine.

    Queries go to the chunks in groups of about ``group_bytes``, one broadcast each; a task multiplies
    blocks of rows with a group and gives back the n best of its rows, ties by id included.  Similarity
    is rounded to ``digits`` before ranking; ``skip_equal`` leaves out the chunk whose id is the query's.
    """
    spark = chunks.sparkSession
    asked = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
    need = asked.agg(F.sum(8 * (F.size("query_vector") + 8)).alias("b")).first().b or 0
    groups, out = 1 + need // group_bytes, None
    kinds = dict(chunks.dtypes)
    rows = chunks.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    schema = f"query_id {dict(queries.dtypes)['query_id']}, id {kinds[id_col]}, similarity double"
    for g in range(groups):
        mine = asked if groups == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)
        sent = spark.sparkContext.broadcast(mine.toArrow().combine_chunks())
        found = rows.mapInArrow(nearest_rows(sent, n, digits, skip_equal), schema)
        out = found if out is None else out.union(found)
    return ranked(out, "similarity", "vec_rank", n, ["query_id"])


#: Cells of a table of terms by queries that goes to every task.
MOST_CELLS = 4_000_000


def bm25_top_batch(
    docs: DataFrame, queries: DataFrame, n: int, id_col: str = "id", text_col: str = "fts_text", digits: int = 6, params: Params = DEFAULTS
) -> DataFrame:
    """(query_id, id, score, fts_rank): the n best texts of every query (query_id, query) by BM25, without postings.

    Asked terms go to the texts: a first pass counts in how many texts each stands, a second multiplies
    blocks of texts with a table of terms by queries and gives back the n best of each task.  Nothing is
    shuffled but counts and those.  Queries go in groups whose table has at most ``MOST_CELLS`` cells;
    scores are rounded to ``digits`` before ranking.
    """
    spark = docs.sparkSession
    pairs = cut(query_terms(queries))
    size = pairs.agg(F.count_distinct("term").alias("t"), F.count_distinct("query_id").alias("q")).first()
    groups = 1 + size.t * size.q // MOST_CELLS
    rows = docs.select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    schema = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(docs.dtypes)[id_col]}, score double"
    out = None
    for g in range(groups):
        asked = (pairs if groups == 1 else pairs.filter(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)).toArrow()
        terms, ids = asked["term"].combine_chunks().dictionary_encode(), asked["query_id"].combine_chunks().dictionary_encode()
        sent = spark.sparkContext.broadcast(terms.dictionary)
        counts = rows.mapInArrow(term_counts(sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a term
        held = {r.term: r.n for r in counts}
        n_docs, length = held.get(-1, 0), held.get(-2, 0)
        df = np.array([held.get(k, 0) for k in range(len(terms.dictionary))], float)
        idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        table = np.zeros((len(terms.dictionary), len(ids.dictionary)))
        table[terms.indices.to_numpy(), ids.indices.to_numpy()] = 1.0
        table *= idf[:, None]
        whole = spark.sparkContext.broadcast((terms.dictionary, ids.dictionary, table, length / n_docs if n_docs else 1.0))
        found = rows.mapInArrow(bm25_rows(whole, n, digits, params.bm25_k1, params.bm25_b), schema)
        out = found if out is None else out.union(found)
    return ranked(out, "score", "fts_rank", n, ["query_id"])


def _term_cells(batch: pa.RecordBatch, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times, words of each row) of the asked terms in a batch of word lists."""
    words = batch.column("words")
    start = words.offsets.to_numpy()
    at = pc.index_in(words.values.slice(start[0], start[-1] - start[0]), value_set=terms).fill_null(-1).to_numpy()
    length = np.diff(start)
    row = np.repeat(np.arange(batch.num_rows), length)
    cell, times = np.unique(row[at >= 0] * len(terms) + at[at >= 0], return_counts=True)
    return cell // max(len(terms), 1), cell % max(len(terms), 1), times, length


def term_counts(sent):
    """A ``mapInArrow`` function over (id, words): in how many rows each asked term stands; -1 rows, -2 words."""

    def run(batches):
        total, rows, words = np.zeros(len(sent.value), np.int64), 0, 0
        for batch in batches:
            _, term, _, length = _term_cells(batch, sent.value)
            total += np.bincount(term, minlength=len(total))
            rows, words = rows + batch.num_rows, words + int(length.sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(total[at], [rows, words]))], ["term", "n"])

    return run


def bm25_rows(sent, n: int, digits: int, k1: float, b: float):
    """A ``mapInArrow`` function over (id, words): (query_id, id, score), the n best rows of the task for each query."""

    def run(batches):
        terms, asked, table, mean = sent.value
        best, step = Best(n, digits), max(1, MOST_CELLS // max(len(terms), 1))
        for whole in batches:
            for low in range(0, whole.num_rows if len(terms) else 0, step):
                batch = whole.slice(low, step)
                row, term, times, length = _term_cells(batch, terms)
                weight = np.zeros((batch.num_rows, len(terms)))
                weight[row, term] = times * (k1 + 1) / (times + k1 * (1 - b + b * length[row] / mean))
                score = weight @ table
                score[score <= 0] = -np.inf
                best.add(score, batch.column("id").to_numpy(zero_copy_only=False), batch.column("id").type)
        if len(best.q):
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(best.q)), *best.columns()], ["query_id", "id", "score"])

    return run


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(item_id, id) of texts (id, text) that contain a passage (item_id, passage) as it stands.

    Inner words of a passage are words of every text that contains it, so texts meet passages by the
    passage's longest inner word and are compared then; passages without one meet every text.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))
    inner = words(F.col("passage"))
    inner = F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0)))
    longest = F.get(F.array_sort(inner, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a))
                                 .otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0))), F.lit(0))
    keyed = cut(passages.select("item_id", "passage", longest.alias("word")))
    few = broadcast_if_small(keyed.filter("word IS NOT NULL"))
    texts = docs.select("id", "text", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    met = texts.join(few, "word").filter(F.contains("text", "passage")).select("item_id", "id")
    short = keyed.filter("word IS NULL")
    if not short.limit(1).count():
        return met
    return met.union(docs.join(broadcast_if_small(short), F.contains(F.col("text"), F.col("passage"))).select("item_id", "id"))


def bm25(found: DataFrame, stats: DataFrame, terms: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """(query_id, id, score) of (query_id, term): idf = ln(1 + (N - df + .5) / (df + .5))."""
    wanted = terms.select("query_id", "term").distinct()
    hits = found.join(broadcast_if_small(wanted.select("term").distinct()), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    k1, b = params.bm25_k1, params.bm25_b
    length = 1 - b + b * F.col("doc_len") / F.col("avg_len")
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * length)
    return (
        hits.join(df, "term")
        .join(stats)
        .withColumn("part", part)
        .join(wanted, "term")
        .groupBy("query_id", "id")
        .agg(F.sum("part").alias("score"))
    )


def query_terms(queries: DataFrame, column: str = "query") -> DataFrame:
    return queries.select("query_id", F.explode(tokens(F.col(column))).alias("term")).distinct()


def ranked(scored: DataFrame, score: str, rank: str, n: int, keys: list[str] | None = None) -> DataFrame:
    order = Window.partitionBy(*(keys or [])).orderBy(F.desc(score), "id")
    return scored.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= n)


def rrf(weight: Column | float, k: int = DEFAULTS.rrf_k) -> Column:
    """1 / (k + vector rank) + weight / (k + lexical rank); a missing branch adds nothing."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    vec = F.coalesce(F.lit(1.0) / (k + F.col("vec_rank")), F.lit(0.0))
    return vec + F.coalesce(w / (k + F.col("fts_rank")), F.lit(0.0))


def fuse(
    vector: DataFrame, lexical: DataFrame, weight: float, limit: int, prior: Column | None = None,
    chunks: DataFrame | None = None, keys: list[str] | None = None,
) -> DataFrame:
    """(keys, id, score, vec_rank, fts_rank, prior): full outer join by id, rank fusion times prior, best ``limit``."""
    on = [*(keys or []), "id"]
    both = vector.select(*on, "vec_rank").join(lexical.select(*on, "fts_rank"), on, "full")
    if chunks is not None:
        both = both.join(chunks, "id")
    both = both.withColumn("prior", prior if prior is not None else F.lit(1.0))
    both = both.withColumn("raw", rrf(weight) * F.col("prior"))
    order = Window.partitionBy(*(keys or [])).orderBy(F.desc("raw"), "id")
    top = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return top.withColumn("score", text.floor_to("raw", 4)).drop("raw")


def centrality_multiplier(degree: Column, params: Params = DEFAULTS) -> Column:
    c = F.coalesce(degree, F.lit(0)).cast("double")
    lift = 1 + params.centrality_weight * c / (c + params.centrality_k)
    return F.when(c > 0, lift).otherwise(F.lit(1.0))


def centrality_tiebreak(hits: DataFrame, keys: list[str] | None = None, params: Params = DEFAULTS) -> DataFrame:
    """Reorder hits (rank, score, degree) inside bands of equal scores; a band is relative to its leader.

    Lists are bounded by the fan-out, so a band's leader comes from folding the ordered list.
    """
    by = keys or []
    rows = hits.withColumn("multiplier", centrality_multiplier(F.col("degree"), params))
    ordered = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", F.struct(*rows.columns).alias("row")))).alias("rows"))
    start = F.struct(
        F.lit(float("inf")).alias("leader"), F.lit(0).alias("band"), F.array().cast("array<int>").alias("bands")
    )

    def step(acc: Column, item: Column) -> Column:
        same = F.abs(acc["leader"] - item["row"]["score"]) < params.centrality_tie_eps
        band = F.when(same, acc["band"]).otherwise(acc["band"] + 1)
        return F.struct(
            F.when(same, acc["leader"]).otherwise(item["row"]["score"]).alias("leader"),
            band.alias("band"),
            F.concat(acc["bands"], F.array(band)).alias("bands"),
        )

    bands = ordered.withColumn("bands", F.aggregate("rows", start, step, lambda acc: acc["bands"]))
    flat = bands.select(F.explode(F.arrays_zip("rows", "bands")).alias("z")).select("z.rows.row.*", F.col("z.bands").alias("band"))
    order = Window.partitionBy(*by).orderBy("band", F.desc("multiplier"), "rank")
    return flat.withColumn("rank", F.row_number().over(order)).drop("band")


def apply_rerank(hits: DataFrame, ranking: DataFrame | None, limit: int) -> DataFrame:
    """Order (rank) by the first valid use of each index (from 0) in (place, index, score); the rest follow as they were."""
    if ranking is None:
        return hits.filter(F.col("rank") <= limit)
    first = Window.partitionBy("index").orderBy("place")
    valid = ranking.withColumn("n", F.row_number().over(first)).filter("n = 1").select("index", "place", "score")
    joined = hits.join(
        valid.select((F.col("index") + 1).alias("rank"), "place", text.floor_to("score", 4).alias("rerank_score")), "rank", "left"
    )
    order = Window.orderBy(F.col("place").asc_nulls_last(), "rank")
    return joined.withColumn("new_rank", F.row_number().over(order)).filter(F.col("new_rank") <= limit).drop("rank", "place").withColumnRenamed("new_rank", "rank")


def rerank_scores(hits: DataFrame, query: str, model: Callable[[str, pd.Series], pd.Series], limit: int = 2000) -> DataFrame:
    """(index, place, score) from an injected cross-encoder over hit texts; a failing model gives no ranking."""

    @F.pandas_udf("double")
    def score(body: pd.Series) -> pd.Series:
        try:
            return model(query, body.str.slice(0, limit))
        except Exception:  # noqa: BLE001  a reranker never fails a search
            return pd.Series([None] * len(body), dtype="float64")

    scored = hits.select((F.col("rank") - 1).alias("index"), score("text").alias("score")).filter("score IS NOT NULL")
    return scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "index")))


def embed(chunks: DataFrame, model: Callable[[pd.Series], pd.Series] | None, text_col: str = "embed_text", dims: int = 64, params: Params = DEFAULTS) -> DataFrame:
    """Add ``embedding``: an injected model over Arrow batches, or hashed words."""
    from strandline.functions.vector import hash_embedding

    body = F.substring(F.col(text_col), 1, params.max_embed_chars)
    if model is None:
        return chunks.withColumn("embedding", hash_embedding(body, dims).cast("array<float>"))
    run = F.pandas_udf("array<float>")(lambda s: model(s))  # type: ignore[call-overload]
    return chunks.withColumn("embedding", run(body))


def search(
    chunks: DataFrame, stored: DataFrame, stats: DataFrame, query: str, query_vector: list[float], k: int = 8,
    path_prefix: str | None = None, language: str | None = None, notes: bool = False, degrees: DataFrame | None = None,
    params: Params = DEFAULTS,
) -> DataFrame:
    """The hits of one query: path, lines, language, score, vec_rank, fts_rank, prior, snippet, rank."""
    spark = chunks.sparkSession
    limit = clamp_k(k)
    width = fanout(limit)
    kind = query_kind(spark.createDataFrame([(query,)], "query string")).first()["kind"]
    weight = lexical_weight(kind, params)
    rows = prefilter(chunks, path_prefix, language)
    vector = vector_top(rows, F.array(*map(F.lit, query_vector)), width)
    if weight > 0:
        terms = query_terms(spark.createDataFrame([(0, query)], "query_id int, query string"))
        scored = bm25(stored, stats, terms, params).join(rows.select("id"), "id", "left_semi")
        lexical = ranked(scored.orderBy(F.desc("score"), "id").limit(width), "score", "fts_rank", width)
    else:
        lexical = spark.createDataFrame([], "id string, fts_rank int")
    prior = predicates.path_prior(F.col("path"), F.lit(query), params.test_penalty, notes)
    fused_limit = min(width, max(3 * limit, 24)) if degrees is not None else limit
    info = rows.select("id", "path", "line_start", "line_end", "language", "text")
    hits = fuse(vector, lexical, weight, fused_limit, prior, info)
    if degrees is not None:
        hits = centrality_tiebreak(hits.join(degrees, "id", "left"), params=params)
    lines = F.concat_ws("-", F.col("line_start").cast("string"), F.col("line_end").cast("string"))
    return hits.filter(F.col("rank") <= limit).select(
        "rank", "path", lines.alias("lines"), "language", "score", "vec_rank", "fts_rank",
        F.when(F.col("prior") != 1, F.col("prior")).alias("prior"), text.snippet("text").alias("snippet"),
    )


def compact(hits: DataFrame) -> DataFrame:
    """Hits without their snippets."""
    return hits.drop("snippet")


def search_batch(
    chunks: DataFrame, stored: DataFrame, stats: DataFrame, queries: DataFrame, vectors: DataFrame, k: int = 8, notes: bool = False,
    params: Params = DEFAULTS,
) -> DataFrame:
    """``search`` of many queries (query_id, query) with their vectors (query_id, query_vector), in one plan."""
    limit = clamp_k(k)
    width = fanout(limit)
    weights = [F.lit(x) for kind in ("symbol", "mixed", "plain") for x in (kind, float(lexical_weight(kind, params)))]
    asked = cut(query_kind(queries).withColumn("weight", F.create_map(*weights)[F.col("kind")]))
    vector = vector_top_batch(chunks, vectors, width).select("query_id", "id", "vec_rank")
    scored = bm25(stored, stats, cut(query_terms(asked.filter("weight > 0"))), params).join(chunks.select("id"), "id", "left_semi")
    lexical = ranked(scored, "score", "fts_rank", width, ["query_id"]).select("query_id", "id", "fts_rank")
    info = chunks.select("id", "path", "line_start", "line_end", "language", "text")
    both = vector.join(lexical, ["query_id", "id"], "full").join(asked, "query_id").join(info, "id")
    both = both.withColumn("prior", predicates.path_prior(F.col("path"), F.col("query"), params.test_penalty, notes))
    both = both.withColumn("score", rrf(F.col("weight")) * F.col("prior"))
    top = ranked(both, "score", "rank", limit, ["query_id"])
    lines = F.concat_ws("-", F.col("line_start").cast("string"), F.col("line_end").cast("string"))
    return top.select(
        "query_id", "query", "rank", "id", "path", lines.alias("lines"), "language", text.floor_to("score", 4).alias("score"),
        "vec_rank", "fts_rank", F.when(F.col("prior") != 1, F.col("prior")).alias("prior"), text.snippet("text").alias("snippet"),
    )


def margin_confidence(hits: DataFrame, keys: list[str] | None = None, params: Params = DEFAULTS) -> DataFrame:
    """(keys, margin, confidence) from the two best hits (rank, score, vec_rank)."""
    order = Window.partitionBy(*(keys or [])).orderBy("rank")
    top = hits.withColumn("second", F.lead("score").over(order)).filter(F.col("rank") == 1)
    margin = (F.col("score") - F.coalesce("second", F.lit(0.0))) / F.col("score")
    level = (
        F.when(F.col("score") <= 0, "low")
        .when(F.col("margin") >= params.margin_high, "high")
        .when(F.col("margin") < params.margin_low, "low")
        .when(F.col("vec_rank") == 1, "high")
        .otherwise("medium")
    )
    rows = top.withColumn("margin", F.when(F.col("score") > 0, margin).otherwise(0.0))
    return rows.select(*(keys or []), text.floor_to("margin", 4).alias("margin"), level.alias("confidence"))


def find_symbol(chunks: DataFrame, name: str, kind: str = "definition", k: int = 20, edges: DataFrame | None = None) -> DataFrame:
    """Chunks that declare a name, or that refer to it; references prefer real call edges."""
    n = clamp_k(k, 20, 100)
    if kind == "definition":
        rows = chunks.filter(F.array_contains(symbols.declared_symbols("text"), name))
        return rows.orderBy("path", "line_start").limit(n)
    if edges is not None:
        calls = edges.filter((F.col("kind") == "calls") & ((F.col("to_symbol") == name) | (F.col("ref_name") == name)))
        if calls.limit(1).count():
            return calls.select(F.col("from_path").alias("path"), F.col("from_lines").alias("lines")).distinct().orderBy("path", "lines").limit(n)
    word = rf"(?<![A-Za-z0-9_$]){name.replace('$', chr(92) + '$')}(?![A-Za-z0-9_$])"
    rows = chunks.filter(F.col("text").rlike(word) & ~F.array_contains(symbols.declared_symbols("text"), name))
    return rows.orderBy("path", "line_start").limit(n)


def similar(chunks: DataFrame, path: str, line: int, k: int = 8) -> DataFrame:
    """Chunks nearest to the stored vector of the one that covers a line, itself excluded."""
    from strandline.sources.tables import chunk_at

    n = clamp_k(k, 8, 25)
    seed = chunk_at(chunks, path, line).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    top = vector_top_batch(chunks, seed, n + 4).filter(F.col("id") != F.col("query_id"))
    order = Window.orderBy(F.desc("similarity"), "id")
    return top.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("rank", "id", "similarity")
