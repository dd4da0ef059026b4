"""Building and refreshing an index: chunks, vectors, postings, edges, meta — set-wise, incremental equal to rebuild."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline import schemas
from strandline.functions import symbols, text
from strandline.operators import chunking, extract, resolve, search
from strandline.params import DEFAULTS, Params
from strandline.sources import tables
from strandline.sources.files import language_of

Model = Callable[[pd.Series], pd.Series]


@dataclass
class Index:
    """Tables of an index and how many rows each step of the last build touched."""

    chunks: DataFrame
    edges: DataFrame
    postings: DataFrame
    stats: DataFrame
    meta: dict[str, str]
    counters: dict[str, int]
    found: DataFrame | None = None
    facts: DataFrame | None = None


def _features(chunks: DataFrame, params: Params) -> DataFrame:
    rows = chunks.withColumn("prefix", text.synthetic_prefix("path", "scope", "text"))
    return (
        rows.withColumn("embed_text", text.embed_text("prefix", "text"))
        .withColumn("content_hash", text.content_hash("embed_text"))
        .withColumn("fts_text", text.fts_text("path", "scope", "text", params.bm25_boost))
    )


def chunk_and_embed(files: DataFrame, cache: DataFrame | None, model: Model | None, params: Params) -> tuple[DataFrame, int, int]:
    """(chunks with vectors, reused, embedded): only texts whose hash is not cached reach the model."""
    rows = _features(chunking.chunk_files(files, params), params).join(files.select("path", "mtime_ms"), "path")
    rows = tables.cut(rows)
    if cache is None:
        done = search.embed(rows, model, params=params)
        reused = 0
    else:
        hit, miss = tables.split_by_cache(rows, cache)
        done = hit.unionByName(search.embed(miss, model, params=params))
        reused = hit.count()
    total = rows.count()
    return tables.cut(done.select(*schemas.CHUNKS.fieldNames())), reused, total - reused


def extract_all(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw calls and imports, type facts) of files; what a file gives depends on the file alone."""
    found = extract.extract_edges(files).withColumn("call_id", F.xxhash64("from_path", "line", "ref_name", "kind", "receiver", "from_symbol"))
    return tables.cut(found), tables.cut(extract.extract_types(files))


def definitions(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """(name, path, lines): the chunks that declare a name, by keyword, body or span; Go methods by their receiver."""
    lines = F.concat_ws("-", F.col("line_start").cast("string"), F.col("line_end").cast("string")).alias("lines")
    names = F.array_union(symbols.declared_symbols("text"), F.transform("symbols", lambda s: s["name"]))
    declared = chunks.select(F.explode(names).alias("name"), "path", lines)
    methods = facts.filter("fact = 'method' AND language = 'go'").select("name", "path").distinct()
    held = chunks.select("path", "text", lines).join(methods, "path").filter(F.contains("text", F.concat("name", F.lit("("))))
    return declared.unionByName(held.select("name", "path", "lines")).distinct()


def resolve_edges(found: DataFrame, facts: DataFrame, chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """All edges: the resolution tiers in order over raw calls and imports, those of each language over its own files."""
    from strandline.operators.graph import transitive_bases

    defs = tables.cut(definitions(chunks, facts))
    imports = resolve.resolve_imports(found.filter("kind = 'imports'"))
    named = imports.filter("to_path IS NOT NULL").select("from_path", F.coalesce("alias", "ref_name").alias("name"), F.col("to_path").alias("stem"))
    calls = tables.cut(resolve.resolve_calls(found.filter("kind = 'calls'").dropDuplicates(["call_id"]), defs, named, listed=False))

    def of(language: str, fact: str) -> DataFrame:
        wanted = {"go": ["go"], "cpp": ["c", "cpp", "hlsl", "glsl"], "ts": ["typescript", "tsx", "javascript"]}[language]
        return facts.filter((F.col("fact") == fact) & F.col("language").isin(*wanted))

    def methods_of(language: str) -> DataFrame:
        rows = of(language, "method").select(F.col("owner").alias("type"), "name", "path").distinct()
        return rows.join(defs, ["name", "path"], "left")

    go = methods_of("go")
    calls = resolve.upgrade(calls, resolve.typed_methods(resolve.of_language(calls, "go"), go), "resolved")
    interfaces = of("go", "interface").select(F.col("owner").alias("interface"), F.col("name").alias("method"))
    calls = tables.cut(resolve.upgrade(calls, resolve.interface_dispatch(resolve.of_language(calls, "go"), interfaces, go), "dispatch"))

    flags = of("cpp", "virtual").union(of("cpp", "override")).groupBy(F.col("owner").alias("type"), "name").agg(
        F.max(F.col("fact") == "virtual").alias("is_virtual"), F.max(F.col("fact") == "override").alias("is_override"))
    cpp = methods_of("cpp").join(flags, ["type", "name"], "left").na.fill(False, ["is_virtual", "is_override"])
    ancestors = transitive_bases(of("cpp", "base").select(F.col("owner").alias("name"), F.col("name").alias("base")))
    fields = of("cpp", "field").select(F.col("owner").alias("class"), F.col("name").alias("field"), F.col("detail").alias("type"), "wrapped")
    returns = of("cpp", "returns").select("name", F.col("detail").alias("type"))
    typed = resolve.factory_types(resolve.field_receivers(resolve.of_language(calls, "cpp"), fields, ancestors), returns)
    typed = tables.cut(typed)
    calls = resolve.upgrade(calls, resolve.virtual_dispatch(typed.filter("receiver_factory IS NULL"), ancestors, cpp), "dispatch")
    calls = tables.cut(resolve.upgrade(calls, resolve.typed_methods(typed, cpp, distinct_paths=True), "resolved"))

    classes = of("ts", "class").select(F.col("name").alias("type"), "path")
    callables = of("ts", "callable").select("name", "path").distinct().join(defs, ["name", "path"])
    bases = of("ts", "base").select(F.col("owner").alias("name"), F.col("name").alias("base"))
    concrete = classes.join(of("ts", "interface").select(F.col("owner").alias("type")).distinct(), "type", "left_anti")
    calls = resolve.upgrade(calls, resolve.class_dispatch(resolve.of_language(calls, "ts"), bases, concrete, callables), "dispatch")
    calls = tables.cut(resolve.upgrade(calls, resolve.class_files(resolve.of_language(calls, "ts"), concrete, callables), "resolved"))

    calls = resolve.with_candidates(calls.join(resolve.covering_chunk(calls, chunks), "call_id", "left"), defs)
    links = resolve.resolve_wikilinks(extract.wikilinks(notes), notes.select("path"))
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    columns = ["kind", "conf", "from_path", "line", "from_symbol", "to_path", "to_lines", "to_symbol", "ref_name", "candidates", "content_hash", "is_method"]
    all_edges = calls.select(*columns)
    all_edges = all_edges.unionByName(imports.select("kind", "conf", "from_path", "line", "to_path", "ref_name").withColumns({"from_symbol": none, "to_lines": none, "to_symbol": none, "candidates": empty, "content_hash": none, "is_method": F.lit(False)}))
    all_edges = all_edges.unionByName(links.select("kind", "conf", "from_path", "line", "to_path", F.col("target").alias("ref_name"), "candidates").withColumns({"from_symbol": none, "to_lines": none, "to_symbol": none, "content_hash": none, "is_method": F.lit(False)}))
    return tables.cut(all_edges)


def promote_ambiguous(edges: DataFrame, chunks: DataFrame, params: Params) -> DataFrame:
    """Embedding disambiguation over ambiguous calls; edges get ``score``."""
    rows = edges.withColumn("call_id", F.xxhash64("from_path", "line", "ref_name", "kind", "from_symbol"))
    if params.disambiguate:
        defs = extract.inventory(chunks).select("name", "path").join(chunks.select("path", "embedding", "content_hash", "symbols"), "path")
        defs = defs.filter(F.exists("symbols", lambda s: s["name"] == F.col("name"))).drop("symbols")
        imports = edges.filter("kind = 'imports' AND to_path IS NOT NULL").select("from_path", F.col("to_path").alias("stem"))
        won = resolve.disambiguate(rows.filter("kind = 'calls' AND conf = 'ambiguous'"), defs, chunks.select("content_hash", "embedding"), imports, params)
    else:
        won = rows.select("call_id", "to_path", F.lit(None).cast("double").alias("score")).filter("false")
    joined = rows.join(won.withColumnRenamed("to_path", "won"), "call_id", "left")
    hit = F.col("won").isNotNull()
    return joined.select(
        "kind", F.when(hit, "inferred").otherwise(F.col("conf")).alias("conf"), "from_path", F.col("line").cast("string").alias("from_lines"), "from_symbol",
        F.coalesce("won", "to_path").alias("to_path"), "to_lines", F.when(hit, F.col("ref_name")).otherwise(F.col("to_symbol")).alias("to_symbol"), "ref_name",
        F.when(hit, F.array().cast("array<string>")).otherwise(F.col("candidates")).alias("candidates"), "content_hash", "score",
    )


def build(files: DataFrame, previous: Index | None = None, model: Model | None = None, identity: str = "hash", params: Params = DEFAULTS, only: DataFrame | None = None) -> Index:
    """An index of (path, mtime_ms, content).

    With a previous index of the same embedding identity and schema, only new and changed files are
    chunked, embedded, tokenised and scanned for calls and types; vanished ones are evicted first.  With
    ``only`` (path), other files are taken as they were, whatever the listing says of them.  Edges are
    resolved set-wise over the raw calls of all files, so a refresh gives the edges of a rebuild.
    """
    if "language" not in files.columns:
        files = files.withColumn("language", language_of(F.col("path")))
    drifted = previous is not None and bool(schemas.missing(previous.chunks.columns, schemas.CHUNKS))
    if previous is None or drifted or previous.meta.get("embedKey") != identity:
        chunks, reused, embedded = chunk_and_embed(files, None, model, params)
        found, facts = extract_all(files)
        stored = tables.cut(tables.postings(chunks))
        scanned = files.count()
        counters = {"scanned": scanned, "skipped": 0, "evicted": 0, "extracted": scanned}
    else:
        known = tables.manifest(previous.chunks)
        state = tables.diff_manifest(files, known)
        if only is not None:
            state = state.join(only.select("path").distinct(), "path", "left_semi")
        state = tables.cut(state)
        changed, deleted = state.filter("state = 'changed'"), state.filter("state = 'deleted'")
        gone = tables.cut(changed.union(deleted))
        fresh_files = files.join(changed, "path", "left_semi")
        old = previous.chunks.join(gone.select("path").distinct(), "path", "left_semi").select("id")
        kept = tables.evict(previous.chunks, gone)
        fresh, reused, embedded = chunk_and_embed(fresh_files, previous.chunks, model, params)
        chunks = tables.cut(kept.unionByName(fresh))
        new_found, new_facts = extract_all(fresh_files)
        found, facts = tables.cut(tables.upsert_edges(previous.found, new_found, gone)), tables.cut(tables.evict(previous.facts, gone).unionByName(new_facts))
        stored = tables.cut(tables.refresh_postings(previous.postings, fresh, old))
        counters = {"scanned": files.count(), "skipped": state.filter("state = 'unchanged'").count(), "evicted": deleted.count(), "extracted": changed.count()}
    counters |= {"chunks": chunks.count(), "reused": reused, "embedded": embedded}
    notes = files.filter("language = 'markdown'")
    if only is not None and previous is not None:
        paths = chunks.select("path").distinct()
        notes = notes.join(paths, "path", "left_semi")
    edges = promote_ambiguous(resolve_edges(found, facts, chunks, notes), chunks, params)
    meta = {"embedKey": identity, "version": "2"}
    return Index(chunks, tables.cut(edges), stored, tables.corpus_stats(chunks), meta, counters, found, facts)


def refresh(files: DataFrame, previous: Index, paths: DataFrame, **options) -> Index:
    """A targeted refresh: of the named paths (path), those that exist are looked at and the others evicted."""
    return build(files, previous, only=paths, **options)


def status(index: Index, now_ms: int) -> DataFrame:
    """(files, chunks, edges, age_minutes): one row."""
    return index.chunks.agg(
        F.count_distinct("path").alias("files"), F.count("*").alias("chunks"),
        F.floor((F.lit(now_ms) - F.max("mtime_ms")) / 60_000).alias("age_minutes"),
    ).join(index.edges.agg(F.count("*").alias("edges")))


def detect_mode(paths: DataFrame) -> DataFrame:
    """(notes_mode, prose_model): half or more Markdown is a notes collection; Markdown and no code wants a prose model."""
    markdown = F.col("path").rlike(r"(?i)\.(md|markdown)$")
    counts = paths.agg(F.count_if(markdown).alias("md"), F.count("*").alias("n"))
    return counts.select((2 * F.col("md") >= F.col("n")).alias("notes_mode"), ((F.col("md") > 0) & (F.col("md") == F.col("n"))).alias("prose_model"))
