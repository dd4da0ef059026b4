"""Labelled evaluation: retrieval, edges, disambiguation, orphans, member calls, cross-checks, gates, sweeps."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.text import floor_to, overlaps, parse_lines, strip_ext


def golden_ranks(golden: DataFrame, results: DataFrame) -> DataFrame:
    """(query, tier, rank, section_rank, labelled): first wanted page, and first one whose lines overlap.

    Golden: (query, paths array, lines array<int> or null, tier); results: (query, rank, path, lines).
    """
    joined = golden.join(results.withColumnsRenamed({"path": "r_path", "lines": "r_lines"}), "query", "left")
    hit = F.array_contains("paths", F.col("r_path"))
    a, b = parse_lines("r_lines")
    section = hit & overlaps(F.get("lines", F.lit(0)), F.get("lines", F.lit(1)), a, b)
    return joined.groupBy("query", "tier").agg(
        F.min(F.when(hit, F.col("rank"))).alias("rank"), F.min(F.when(section, F.col("rank"))).alias("section_rank"),
        F.max(F.col("lines").isNotNull()).alias("labelled"),
    )


def retrieval_metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per tier and overall (tier ``all``): recall@k, MRR and section hits (null without line labels)."""
    measures: list[Column] = [F.count("*").alias("n")]
    for k in ks:
        measures.append(floor_to(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 4).alias(f"recall_{k}"))
    measures.append(floor_to(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))), 4).alias("mrr"))
    for k in ks[:2]:
        found = F.when(F.col("labelled"), F.when(F.col("section_rank") <= k, 1.0).otherwise(0.0))
        measures.append(floor_to(F.avg(found), 4).alias(f"sec_hit_{k}"))
    rolled = ranks.rollup("tier").agg(F.grouping("tier").alias("g"), *measures)
    return rolled.withColumn("tier", F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col("tier"))).drop("g")


def edge_tally(golden: DataFrame, edges: DataFrame) -> DataFrame:
    """(from, symbol, kind, to, verdict): correct, wrong or missing; ``to`` null wants an external or pathless edge."""
    made = edges.select(F.col("from_path").alias("from"), F.col("ref_name").alias("symbol"), "kind", "to_path", "conf", "candidates")
    rows = golden.join(made, ["from", "symbol", "kind"], "left")
    outside = F.col("to").isNull() & ((F.col("conf") == "external") | F.col("to_path").isNull())
    hit = outside | (F.col("to_path") == F.col("to")) | ((F.col("conf") == "dispatch") & F.array_contains("candidates", F.col("to")))
    seen = F.col("conf").isNotNull()
    grouped = rows.groupBy("from", "symbol", "kind", "to").agg(F.max(F.coalesce(seen & hit, F.lit(False))).alias("hit"), F.max(seen).alias("seen"))
    verdict = F.when(F.col("hit"), "correct").when(F.col("seen"), "wrong").otherwise("missing")
    return grouped.select("from", "symbol", "kind", "to", verdict.alias("verdict"))


def edge_metrics(tally: DataFrame) -> DataFrame:
    """By file extension and overall: correct, wrong, missing and recall."""
    ext = F.lower(F.regexp_extract("from", r"\.([A-Za-z0-9]+)$", 1))
    rows = tally.withColumn("ext", ext).rollup("ext").agg(
        F.grouping("ext").alias("g"), *(F.count_if(F.col("verdict") == v).alias(v) for v in ("correct", "wrong", "missing")),
        floor_to(F.avg((F.col("verdict") == "correct").cast("double")), 4).alias("recall"))
    return rows.withColumn("ext", F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col("ext"))).drop("g")


def conf_split(edges: DataFrame) -> DataFrame:
    """One row with the number of edges of each confidence."""
    return edges.agg(*(F.count_if(F.col("conf") == c).alias(c) for c in ("resolved", "inferred", "dispatch", "ambiguous", "external")))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, floor_to(part / whole, 4)).otherwise(F.lit(1.0))


def disambiguation_metrics(golden: DataFrame, promoted: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, abstain; shares of nothing are 1.

    Golden: (from_path, symbol, expect or null for abstain); promoted: (from_path, symbol, to_path).
    """
    rows = golden.join(promoted, ["from_path", "symbol"], "left")
    e, t = F.col("expect"), F.col("to_path")
    counted = rows.agg(
        F.count_if(e.isNotNull() & (t == e)).alias("tp"), F.count_if(t.isNotNull() & (e.isNull() | (t != e))).alias("fp"),
        F.count_if(e.isNotNull() & t.isNull()).alias("fn"), F.count_if(e.isNull() & t.isNull()).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counted.select("*", _share(tp, tp + fp).alias("precision"), _share(tp, tp + fn).alias("recall"), _share(tn, tn + fp).alias("abstain"))


def best_operating_point(points: DataFrame) -> DataFrame:
    """(threshold, margin, precision, recall): full precision first, then recall, precision, and small values."""
    return points.orderBy((F.col("precision") == 1).cast("int").desc(), F.desc("recall"), F.desc("precision"), "threshold", "margin").limit(1)


def orphan_metrics(golden: DataFrame, found: DataFrame) -> DataFrame:
    """One row: correct, false_dead, false_entrypoint, missing, accuracy of (path, symbol, expect) against (path, name, class)."""
    rows = golden.join(found.select("path", F.col("name").alias("symbol"), "class"), ["path", "symbol"], "left")
    e, c = F.col("expect"), F.coalesce("class", F.lit("reached"))
    counts = rows.agg(
        F.count("*").alias("n"), F.count_if(e == c).alias("correct"),
        F.count_if((c == "likely_dead") & (e != c)).alias("false_dead"),
        F.count_if((c == "possible_entrypoint") & (e != c)).alias("false_entrypoint"),
        F.count_if((c == "reached") & (e != c)).alias("missing"))
    return counts.withColumn("accuracy", _share(F.col("correct"), F.col("n"))).drop("n")


def member_call_stats(calls: DataFrame, repo_types: DataFrame) -> DataFrame:
    """By extension and overall: totals and reasons of member calls.

    Calls: (from_path, kind, is_method, conf, receiver, receiver_type, enclosing_class, candidates, has_method).
    """
    known = repo_types.select(F.col("type").alias("receiver_type")).distinct().withColumn("in_repo", F.lit(True))
    rows = calls.filter("kind = 'calls' AND is_method").join(known, "receiver_type", "left")
    has = F.col("receiver").isNotNull()
    untyped = F.col("receiver_type").isNull()
    reason = F.when(F.col("conf") == "ambiguous",
        F.when(has & untyped & F.col("enclosing_class").isNull(), "no-enclosing-class")
        .when(has & untyped, "receiver-untyped")
        .when(~untyped & F.col("in_repo").isNull(), "receiver-external")
        .when(~untyped & ~F.coalesce("has_method", F.lit(False)), "method-external")
        .when(F.size("candidates") > 1, "multi-candidate").otherwise("other"))
    ext = F.lower(F.regexp_extract("from_path", r"\.([A-Za-z0-9]+)$", 1))
    names = ("no-enclosing-class", "receiver-untyped", "receiver-external", "method-external", "multi-candidate", "other")
    agg = [F.count("*").alias("total"), F.count_if(F.col("conf").isin("resolved", "dispatch")).alias("resolved"),
           F.count_if(F.col("conf") == "external").alias("external"), F.count_if(F.col("conf") == "inferred").alias("inferred"),
           *(F.count_if(F.col("reason") == r).alias(r.replace("-", "_")) for r in names)]
    rolled = rows.withColumn("reason", reason).withColumn("ext", ext).rollup("ext").agg(F.grouping("ext").alias("g"), *agg)
    return rolled.withColumn("ext", F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col("ext"))).drop("g").withColumn("rate", _share(F.col("resolved"), F.col("total")))


def oracle_check(edges: DataFrame, references: DataFrame, definitions: DataFrame, samples: int = 5) -> dict[str, DataFrame]:
    """Resolved calls against an index: buckets, metrics and up to some samples a bucket.

    Edges: (edge_id, from_path, line, ref_name, conf, to_path, to_lines, candidates); references: (path,
    line, symbol, method); definitions: (symbol, path, line).  Aligned on method and base name, lines
    at most one apart, and paths one of which ends with the other.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    left = edges.withColumn("b", base("from_path"))
    right = references.select(F.col("path").alias("r_path"), F.col("line").alias("r_line"), "symbol", F.col("method").alias("ref_name"), base("path").alias("b"))
    fits = F.col("from_path").endswith(F.col("r_path")) | F.col("r_path").endswith(F.col("from_path"))
    near = left.join(right, ["ref_name", "b"]).filter((F.abs(F.col("line") - F.col("r_line")) <= 1) & fits)
    order = F.struct(F.abs(F.col("line") - F.col("r_line")), "r_path", "r_line", "symbol")
    first = near.groupBy("edge_id").agg(F.min_by("symbol", order).alias("symbol"))
    rows = edges.join(first, "edge_id", "left").join(definitions.select("symbol", F.col("path").alias("d_path"), F.col("line").alias("d_line")), "symbol", "left")
    a, b = parse_lines("to_lines")
    same = F.col("to_path").endswith(F.col("d_path")) | F.col("d_path").endswith(F.col("to_path"))
    right_place = same & (F.col("d_line") >= a) & (F.col("d_line") <= b)
    listed = (F.col("conf") == "dispatch") & F.exists("candidates", lambda c: c.endswith(F.col("d_path")) | F.col("d_path").endswith(c))
    bucket = F.when(F.col("symbol").isNull(), "unaligned").when(F.col("d_path").isNull(), "external").when(F.coalesce(right_place | listed, F.lit(False)), "correct").otherwise("wrong")
    graded = rows.withColumn("bucket", bucket)
    inside = references.join(definitions.select("symbol").distinct(), "symbol", "left_semi").agg(F.count("*").alias("refs"))
    counts = graded.agg(*(F.count_if(F.col("bucket") == x).alias(x) for x in ("correct", "wrong", "external", "unaligned"))).join(inside)
    metrics = counts.select("*", _share(F.col("correct"), F.col("correct") + F.col("wrong")).alias("precision"), _share(F.col("correct"), F.col("refs")).alias("recall"))
    shown = graded.withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy("edge_id"))).filter(F.col("n") <= samples)
    return {"edges": graded, "metrics": metrics, "samples": shown.drop("n")}


def compare_baseline(current: DataFrame, baseline: DataFrame, tolerance: float = 0.02, tiers: tuple[str, ...] = ("all", "gate")) -> DataFrame:
    """(tier, metric, was, now, regressed): metrics of both tables; missing ones are skipped."""
    metrics = [c for c in current.columns if c in baseline.columns and c not in ("tier", "n")]

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = ", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
        return df.filter(F.col("tier").isin(*tiers)).selectExpr("tier", f"stack({len(metrics)}, {pairs}) as (metric, {name})")

    both = long(current, "now").join(long(baseline, "was"), ["tier", "metric"]).filter("now IS NOT NULL AND was IS NOT NULL")
    return both.select("tier", "metric", "was", "now", (F.col("was") - F.col("now") > tolerance + 1e-9).alias("regressed"))


def parse_grid(spec: str) -> list[dict[str, float]]:
    """``key=v1,v2;key2=...`` as all combinations, the last key varying fastest."""
    axes = [(k.strip(), [float(v) for v in vs.split(",") if v.strip()]) for k, _, vs in (p.partition("=") for p in spec.split(";") if p.strip())]
    if any(not k or not vs for k, vs in axes):
        raise ValueError(f"grid: {spec!r}")
    return [dict(zip((k for k, _ in axes), combo, strict=True)) for combo in product(*(vs for _, vs in axes))]


def grid_table(spark: SparkSession, combos: list[dict[str, float]], defaults: dict[str, float]) -> DataFrame:
    rows = [(i, *(c.get(k, v) for k, v in defaults.items())) for i, c in enumerate(combos)]
    return spark.createDataFrame(rows, "combo int, " + ", ".join(f"{k} double" for k in defaults))


def sweep(branches: DataFrame, grid: DataFrame, wanted: DataFrame, limit: int = 10, rrf_k: int = 60) -> DataFrame:
    """(combo, recall_1, recall_5, mrr): all combinations in one job, branch ranks made once.

    Branches: (query, kind, id, path, vec_rank, fts_rank); grid: (combo, plain, symbol, mixed); wanted: (query, path).
    """
    weight = F.when(F.col("kind") == "symbol", F.col("symbol")).when(F.col("kind") == "mixed", F.col("mixed")).otherwise(F.col("plain"))
    rows = branches.join(F.broadcast(grid)).withColumn("weight", weight)  # a grid is a handful of rows
    score = F.coalesce(F.lit(1.0) / (rrf_k + F.col("vec_rank")), F.lit(0.0)) + F.coalesce(F.col("weight") / (rrf_k + F.col("fts_rank")), F.lit(0.0))
    order = Window.partitionBy("combo", "query").orderBy(F.desc("score"), "id")
    top = rows.withColumn("score", score).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    hits = top.join(wanted, ["query", "path"]).groupBy("combo", "query").agg(F.min("rank").alias("rank"))
    asked = wanted.select("query").distinct().join(F.broadcast(grid.select("combo")))
    full = asked.join(hits, ["combo", "query"], "left")
    at = lambda k: floor_to(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 4)
    return full.groupBy("combo").agg(at(1).alias("recall_1"), at(5).alias("recall_5"), floor_to(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))), 4).alias("mrr")).orderBy(F.desc("mrr"), F.desc("recall_1"), F.desc("recall_5"), "combo")


def token_savings(files: DataFrame, hits: DataFrame) -> DataFrame:
    """(query, grep_tokens, search_tokens, ratio): reading every file that holds a query's longest word against reading its hits."""
    from strandline.functions.text import estimate_tokens, grep_term

    terms = hits.select("query").distinct().withColumn("term", F.lower(grep_term("query")))
    grep = files.join(terms, F.contains(F.lower("content"), F.col("term"))).groupBy("query").agg(F.sum(estimate_tokens("content")).alias("grep_tokens"))
    used = hits.groupBy("query").agg(F.sum(estimate_tokens("snippet")).alias("search_tokens"))
    return used.join(grep, "query", "left").withColumn("grep_tokens", F.coalesce("grep_tokens", F.lit(0))).withColumn("ratio", F.when(F.col("search_tokens") > 0, floor_to(F.col("grep_tokens") / F.col("search_tokens"), 2)))


def stem_matches(path: Column, stem: Column) -> Column:
    return strip_ext(path) == stem
