"""Links between notes and code, related notes, and drift of what notes refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.params import DEFAULTS, Params
from strandline.sources.tables import first_by

#: Identifiers too plain to be mentions, and where mentioned code files live.
STOP_NAMES = ("this", "true", "false", "null", "function", "return", "const", "async", "await", "import", "export", "class", "interface", "type", "value", "string", "number", "object")
_PATH = r"(?:packages|apps|src|lib|tools|scripts)/[A-Za-z0-9_\-./]+\.(?:ts|tsx|js|jsx|mjs|cjs|py|rs|go|c|cc|cpp|h|hpp|cs|java|kt|rb|swift)"


def mentions(notes: DataFrame) -> DataFrame:
    """(note, name, count): identifiers of four letters or more in (path, text)."""
    names = F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]{3,}"), F.lit(0))
    each = notes.select(F.col("path").alias("note"), F.explode(names).alias("name"))
    return each.filter(~F.col("name").isin(*STOP_NAMES)).groupBy("note", "name").agg(F.count("*").alias("count"))


def mentioned_paths(notes: DataFrame) -> DataFrame:
    paths = F.regexp_extract_all("text", F.lit(_PATH), F.lit(0))
    return notes.select(F.col("path").alias("note"), F.explode(F.array_distinct(paths)).alias("mention"))


def code_links(notes: DataFrame, inventory: DataFrame, files: DataFrame, cap: int = DEFAULTS.cross_link_cap) -> DataFrame:
    """(note, kind, symbol, path, lines, rank, snippet): the best ``cap`` code sites of each note.

    Symbols join the inventory by name, rank count + length / 100; paths join files by base name and
    then by suffix, rank 0.5.
    """
    lines = F.concat_ws("-", F.col("line_start").cast("string"), F.col("line_end").cast("string"))
    sites = inventory.groupBy("name", "path").agg(F.min(F.struct(lines.alias("lines"), _head("text").alias("snippet"))).alias("site"))
    # All sites of a name have one rank in a note: the best of the note are among the first of each name.
    sites = sites.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("path"))).filter(F.col("n") <= cap)
    symbols = mentions(notes).join(sites, "name").select(
        "note", F.lit("symbol").alias("kind"), F.col("name").alias("symbol"), "path", "site.lines",
        (F.col("count") + F.length("name") / 100).alias("rank"), "site.snippet",
    )
    asked = mentioned_paths(notes).withColumn("base", text.basename("mention"))
    known = files.select("path", text.basename("path").alias("base"), _head("text").alias("snippet"))
    fits = (F.col("path") == F.col("mention")) | F.col("path").endswith(F.concat(F.lit("/"), F.col("mention")))
    paths = asked.join(known, "base").filter(fits).select(
        "note", F.lit("file").alias("kind"), F.lit(None).cast("string").alias("symbol"), "path",
        F.lit(None).cast("string").alias("lines"), F.lit(0.5).alias("rank"), "snippet",
    ).distinct()
    order = Window.partitionBy("note").orderBy(F.desc("rank"), "path", "symbol")
    return symbols.unionByName(paths).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= cap).drop("n")


def _head(column: str) -> Column:
    return F.array_join(F.slice(text.lines(column), 1, 5), "\n")


def reverse_links(links: DataFrame, path: str, symbols: DataFrame, cap: int = DEFAULTS.related_notes_cap) -> DataFrame:
    """(note, via): notes that refer to a file's symbols (symbol), then to the file; one row a note."""
    mine = links.filter(F.col("path") == path)
    hits = mine.filter("kind = 'symbol'").join(symbols.select("symbol").distinct(), "symbol", "left_semi").unionByName(mine.filter("kind = 'file'"))
    ranked = first_by(hits, ["note"], F.when(F.col("kind") == "symbol", 0).otherwise(1), F.desc("rank"), "symbol")
    order = F.when(F.col("kind") == "symbol", 0).otherwise(1)
    return ranked.orderBy(order, "note").limit(cap).select("note", F.coalesce("symbol", "path").alias("via"))


def code_structure(shown: DataFrame, links: DataFrame) -> DataFrame:
    """Call links with both ends among the shown nodes."""
    a = links.filter("kind = 'calls'").join(shown.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    return a.join(shown.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst").distinct()


def connections(semantic: DataFrame, lexical: DataFrame, proximity: DataFrame, limit: int = 12, params: Params = DEFAULTS) -> DataFrame:
    """(path, score, why...): notes by rank fusion of (path, similarity) and (path, bm25) times link proximity."""
    sem = semantic.groupBy("path").agg(F.max("similarity").alias("similarity"))
    sem = sem.withColumn("sem_rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "path")))
    lex = lexical.groupBy("path").agg(F.max("bm25").alias("bm25"))
    lex = lex.withColumn("lex_rank", F.row_number().over(Window.orderBy(F.desc("bm25"), "path")))
    rows = sem.join(lex, "path", "full").join(proximity, "path", "left")
    rank = lambda c: F.coalesce(F.lit(1.0) / (params.rrf_k + F.col(c)), F.lit(0.0))
    weight = params.conn_graph_weight if params.conn_fusion else 0.0
    raw = (rank("sem_rank") + rank("lex_rank")) * (1 + weight * F.coalesce("proximity", F.lit(0.0)))
    cocited = F.coalesce(F.col("cocited"), F.lit(0))
    why = F.array_compact(F.array(
        F.when(F.col("sem_rank").isNotNull(), "semantic"), F.when(F.col("lex_rank").isNotNull(), "lexical"),
        F.when(F.col("hop").isNotNull(), F.concat(F.lit("link:"), F.col("hop").cast("string"), F.lit("hop"))),
        F.when(cocited > 0, F.concat(F.lit("co-cited×"), cocited.cast("string"))),
    ))
    return rows.withColumn("raw", raw).orderBy(F.desc("raw"), "path").limit(min(max(limit, 1), 50)).select("path", text.floor_to("raw", 4).alias("score"), why.alias("why"))


def neighbourhood(start: str, related: DataFrame, links: DataFrame, k: int = 12, most: int = 40) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around a note: related ones weigh .4 + .6 * score / best, linked ones by degree."""
    spark = related.sparkSession
    k, most = min(max(k, 1), 30), min(max(most, 4), 80)
    top = related.orderBy(F.desc("score"), "path").limit(k)
    best = F.max("score").over(Window.partitionBy())
    near = top.select(F.col("path").alias("node"), text.floor_to(0.4 + 0.6 * F.col("score") / best, 3).alias("weight"))
    touching = links.filter((F.col("src") == start) | (F.col("dst") == start))
    other = F.when(F.col("src") == start, F.col("dst")).otherwise(F.col("src"))
    linked = touching.groupBy(other.alias("node")).agg(F.count("*").alias("degree")).filter(F.col("node") != start)
    by_degree = linked.select("node", text.floor_to(F.least(F.lit(1.0), 0.2 + 0.1 * F.col("degree")), 3).alias("weight"))
    rest = by_degree.join(near.select("node"), "node", "left_anti")
    centre = spark.createDataFrame([(start, 2.0)], "node string, weight double")
    nodes = centre.union(near).union(rest).orderBy(F.desc("weight"), "node").limit(most)
    nodes = nodes.withColumn("weight", F.least("weight", F.lit(1.0)))
    ids = nodes.select("node")
    inside = links.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", F.lit("link").alias("kind")).distinct()
    semantic = near.select(F.lit(start).alias("src"), F.col("node").alias("dst"), F.lit("semantic").alias("kind"))
    pair = [F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")]
    semantic = semantic.withColumns({"x": F.least("src", "dst"), "y": F.greatest("src", "dst")}).join(inside.select(*pair).distinct(), ["x", "y"], "left_anti").select("src", "dst", "kind")
    return nodes, inside.union(semantic)


# Drift


def snapshot(refs: DataFrame) -> DataFrame:
    """Baseline rows of (note, kind, symbol, path, lines, text)."""
    code = F.col("kind") == "symbol"
    return refs.select(
        "note", "kind", "symbol", "path", "lines", text.body_hash("text").alias("body_hash"),
        F.when(code, text.extract_signature("text")).alias("sig"), F.when(code, text.signature_hash("text")).alias("sig_hash"),
        F.substring("text", 1, 400).alias("snippet"),
    )


def drift(baseline: DataFrame, current: DataFrame, muted: DataFrame | None = None) -> DataFrame:
    """(note, kind, symbol, path, grade, severity) of baseline rows that changed.

    A symbol row is compared with the current row of its note, symbol and kind, in the same path if
    there; a file row with the row of its path.  Missing: removed; another signature: signature;
    another body: body.  A mute covers a symbol of a note, or with ``*`` the whole note.
    """
    rows = baseline
    if muted is not None:
        star = muted.filter("symbol = '*'").select("note").distinct()
        rows = rows.join(star, "note", "left_anti")
        named = muted.filter("symbol <> '*'").select("note", "symbol").distinct()
        rows = rows.join(named, ["note", "symbol"], "left_anti").select(*baseline.columns)
    key = F.when(F.col("kind") == "file", F.col("path")).otherwise(F.col("symbol"))
    old = rows.withColumn("key", key)
    new = current.select("note", "kind", key.alias("key"), *(F.col(c).alias(f"c_{c}") for c in ("path", "body_hash", "sig_hash")))
    same_path = F.when(F.col("c_path") == F.col("path"), 0).otherwise(1)
    matched = first_by(old.join(new, ["note", "kind", "key"], "left"), ["note", "kind", "key", "path"], same_path, "c_path")
    grade = (
        F.when(F.col("c_path").isNull(), "removed")
        .when(~F.col("sig_hash").eqNullSafe(F.col("c_sig_hash")), "signature")
        .when(F.col("body_hash") != F.col("c_body_hash"), "body")
    )
    severity = F.when(F.col("grade") == "body", "medium").otherwise("high")
    return matched.withColumn("grade", grade).filter("grade IS NOT NULL").select("note", "kind", "symbol", "path", "grade", severity.alias("severity"))


def acknowledge(baseline: DataFrame, current: DataFrame, note: str, symbol: str | None = None) -> DataFrame:
    """The baseline with a note's rows (or one symbol's) taken from the current state."""
    mine = (F.col("note") == note) & (F.lit(symbol is None) | F.col("symbol").eqNullSafe(F.lit(symbol)))
    return baseline.filter(~mine).unionByName(current.filter(mine), allowMissingColumns=True)


def sync(baseline: DataFrame, current: DataFrame, muted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new baseline, drift that stays flagged): signature drift is acknowledged, body drift and removals are not."""
    found = drift(baseline, current, muted)
    signed = found.filter("grade = 'signature'").select("note", "kind", "symbol", "path")
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("note", "kind", "symbol", "path")]
    kept = baseline.alias("x").join(signed.alias("y"), on, "left_anti")
    fresh = current.alias("x").join(signed.alias("y"), on[:3], "left_semi")
    return kept.unionByName(fresh, allowMissingColumns=True), found.filter("grade <> 'signature'")


def drift_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("note", "severity").agg(F.count("*").alias("n"))


def report_for(found: DataFrame, note: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(drift rows, one row with how many notes and links are stale), of one note where named."""
    rows = found if note is None else found.filter(F.col("note") == note)
    return rows, rows.agg(F.count_distinct("note").alias("stale_notes"), F.count("*").alias("stale_links"))


def refs_table(rows: DataFrame) -> DataFrame:
    """(note, table): a Markdown table of each note's references."""
    line = F.concat(F.lit("| "), F.coalesce("symbol", F.lit("")), F.lit(" | "), F.col("path"), F.lit(" | "), F.coalesce("lines", F.lit("")), F.lit(" |"))
    head = "| symbol | path | lines |\n| --- | --- | --- |\n"
    return rows.select("note", line.alias("line")).groupBy("note").agg(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list("line")), "\n")).alias("table"))
