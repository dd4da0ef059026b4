"""Edge resolution: tiers for calls, imports and links, receiver-type upgrades, dispatch, disambiguation.

Input calls: (call_id, from_path, ref_name, language columns...); every tier is set-wise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import floor_to, note_key, resolve_relative, strip_ext
from strandline.functions.vector import cosine
from strandline.params import DEFAULTS, Params
from strandline.sources.tables import SMALL_ROWS, broadcast_if_small, cut, stored


def resolve_calls(calls: DataFrame, definitions: DataFrame, imports: DataFrame, listed: bool = True) -> DataFrame:
    """Add conf, to_path, to_lines, to_symbol and candidates to (call_id, from_path, ref_name, local_target).

    Definitions: (name, path, lines).  Imports: (from_path, name, stem).  In order: a local target is
    resolved; no candidate is external; a named import that vouches for exactly its file is resolved; a
    single candidate is resolved in the same file, else ambiguous; several are ambiguous.  A call meets the
    number of its name's sites and the ones that may be its target, not all of them; without ``listed`` the
    candidates are left to ``with_candidates``.
    """
    site = F.struct("path", "lines")
    files = definitions.groupBy("name", "path").agg(F.min(F.struct("lines")).alias("first"), F.count_distinct(F.struct("lines")).alias("sites"))
    files = files.select("name", "path", F.col("first.lines").alias("lines"), "sites")
    named = files.groupBy(F.col("name").alias("ref_name")).agg(F.sum("sites").alias("n"), F.min(site).alias("only"))
    stems = imports.groupBy("from_path", F.col("name").alias("ref_name")).agg(F.min("stem").alias("stem"))
    exact = files.groupBy(F.col("name").alias("ref_name"), strip_ext(F.col("path")).alias("stem")).agg(F.min(site).alias("vouched"))
    vouched = stems.join(exact, ["ref_name", "stem"]).drop("stem")
    own = files.select(F.col("name").alias("ref_name"), F.col("path").alias("from_path"), site.alias("own"))
    rows = calls.join(broadcast_if_small(named), "ref_name", "left")
    rows = rows.join(broadcast_if_small(vouched), ["from_path", "ref_name"], "left").join(broadcast_if_small(own), ["from_path", "ref_name"], "left")
    n, only, local = F.coalesce("n", F.lit(0)), F.col("only"), F.col("local_target").isNotNull()
    conf = (
        F.when(local, "resolved")
        .when(n == 0, "external")
        .when(F.col("vouched").isNotNull(), "resolved")
        .when((n == 1) & (only["path"] == F.col("from_path")), "resolved")
        .otherwise("ambiguous")
    )
    target = (
        F.when(local, F.coalesce("own", F.struct(F.col("from_path").alias("path"), F.lit(None).cast("string").alias("lines"))))
        .when(F.col("vouched").isNotNull(), F.col("vouched"))
        .when((n == 1) & (only["path"] == F.col("from_path")), only)
    )
    rows = rows.withColumn("conf", conf).withColumn("target", target).select(
        *calls.columns, "conf", F.col("target.path").alias("to_path"), F.col("target.lines").alias("to_lines"),
        F.when(F.col("conf") == "resolved", F.coalesce("local_target", "ref_name")).alias("to_symbol"),
        F.array().cast("array<string>").alias("candidates"),
    )
    return with_candidates(rows, definitions) if listed else rows


def with_candidates(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """The calls, those that are ambiguous with the paths of all definitions of their name as candidates."""
    files = definitions.select("name", "path").distinct()
    paths = files.groupBy("name").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    paths = F.broadcast(paths) if files.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else paths
    rows = calls.join(paths, (F.col("conf") == "ambiguous") & (F.col("ref_name") == F.col("name")), "left")
    listed = F.when(F.col("conf") == "ambiguous", F.coalesce("paths", F.array().cast("array<string>"))).otherwise(F.col("candidates"))
    return rows.select(*(listed.alias(c) if c == "candidates" else c for c in calls.columns))


def resolve_imports(imports: DataFrame) -> DataFrame:
    """(from_path, spec) to conf and to_path: a relative import becomes the stem it names, others are external."""
    relative = F.col("spec").rlike(r"^\.{1,2}/")
    stem = resolve_relative(F.col("from_path"), F.col("spec"))
    return imports.withColumn("conf", F.when(relative, "resolved").otherwise("external")).withColumn("to_path", F.when(relative, stem))


#: Bytes of written-out candidates that one task gives.
LISTED_BYTES = 256_000_000


def resolve_wikilinks(links: DataFrame, notes: DataFrame, joined: str | None = None) -> DataFrame:
    """(from_path, target) to conf, to_path and candidates by note key: none external, one resolved, several ambiguous.

    With ``joined`` the candidates are one text, put together once a key.  Where the lists of all rows are
    large, links of a key stand in the same tasks, so that a table of the result stores a list once a task.
    """
    asked = stored(links).withColumn("key", note_key("target"))
    counts = cut(asked.groupBy("key").agg(F.count("*").alias("rows")))
    files = notes.select(note_key("path").alias("key"), "path").join(broadcast_if_small(counts.select("key")), "key", "left_semi")
    index = files.groupBy("key").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    none = F.array().cast("array<string>") if joined is None else F.lit("")
    listed = F.when(F.size("paths") > 1, F.col("paths") if joined is None else F.array_join("paths", joined)).otherwise(none)
    size = F.aggregate("paths", F.lit(0).cast("long"), lambda total, x: total + F.octet_length(x) + 1)
    index = cut(index.select("key", F.size("paths").alias("n"), size.alias("size"), F.get("paths", F.lit(0)).alias("only"), listed.alias("listed")))
    written = counts.join(index.filter("n > 1").select("key", "size"), "key").agg(F.sum(F.col("rows") * F.col("size"))).first()[0] or 0
    if written > LISTED_BYTES:
        asked = asked.repartitionByRange(written // LISTED_BYTES + asked.sparkSession.sparkContext.defaultParallelism, "key", "from_path")
    few = (index.agg(F.sum("n")).first()[0] or 0) <= SMALL_ROWS
    rows = asked.join(F.broadcast(index) if few else index, "key", "left")
    n = F.coalesce("n", F.lit(0))
    conf = F.when(n == 0, "external").when(n == 1, "resolved").otherwise("ambiguous")
    return rows.select(*links.columns, conf.alias("conf"), F.when(n == 1, F.col("only")).alias("to_path"), F.coalesce("listed", none).alias("candidates"))


def upgrade(calls: DataFrame, found: DataFrame, conf: str) -> DataFrame:
    """Set conf and target of calls that are still ambiguous and appear in ``found`` (call_id, to_path, to_lines, candidates)."""
    new = found.select("call_id", *(F.col(c).alias(f"n_{c}") for c in ("to_path", "to_lines", "candidates")))
    rows = calls.join(new, "call_id", "left").withColumn("take", (F.col("conf") == "ambiguous") & F.col("n_candidates").isNotNull())
    pick = lambda c: F.when(F.col("take"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    plain = [c for c in calls.columns if c not in ("conf", "to_path", "to_lines", "candidates", "to_symbol")]
    symbol = F.when(F.col("take") & F.lit(conf == "resolved"), F.col("ref_name")).otherwise(F.col("to_symbol")).alias("to_symbol")
    return rows.select(*plain, F.when(F.col("take"), conf).otherwise(F.col("conf")).alias("conf"), pick("to_path"), pick("to_lines"), pick("candidates"), symbol)


def typed_methods(calls: DataFrame, methods: DataFrame, distinct_paths: bool = False) -> DataFrame:
    """Calls with a receiver type whose (type, name) has exactly one definition (or one defining path)."""
    sites = methods.groupBy(F.col("type").alias("receiver_type"), F.col("name").alias("ref_name")).agg(*_bounds())
    rows = calls.filter("receiver_type IS NOT NULL").select("call_id", "receiver_type", "ref_name")
    rows = rows.join(broadcast_if_small(sites), ["receiver_type", "ref_name"])
    return _single(rows, F.col("low") == F.col("high") if distinct_paths else F.col("n") == 1)


def _bounds() -> list[Column]:
    """Of the sites of a method: their number, the first and last path, and the first lines."""
    return [F.count("*").alias("n"), F.min("path").alias("low"), F.max("path").alias("high"), F.min("lines").alias("lines")]


def _single(rows: DataFrame, one: Column) -> DataFrame:
    """Of calls with the number and bounds of their sites, a row for each family of them, those that have ``one`` site in all.

    A call of which no row has ``one`` has not in all; where few are left, the others are not grouped.
    """
    left = rows.filter(one).select(F.col("call_id").alias("maybe"))
    if left.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        rows = rows.join(F.broadcast(left), F.col("call_id").eqNullSafe(F.col("maybe")), "left_semi")
    whole = rows.groupBy("call_id").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("lines").alias("lines"))
    return whole.filter(one).select("call_id", F.col("low").alias("to_path"), F.col("lines").alias("to_lines"), F.array().cast("array<string>").alias("candidates"))


#: File endings whose calls a language's tiers look at.
TIER_FILES = {"go": r"\.go$", "cpp": r"(?i)\.(c|cc|cpp|cxx|h|hh|hpp|hxx|hlsl|hlsli|metal)$", "ts": r"(?i)\.[cm]?[jt]sx?$"}


def of_language(calls: DataFrame, language: str) -> DataFrame:
    """Member calls that are still ambiguous, in files of a language."""
    return calls.filter((F.col("conf") == "ambiguous") & F.col("is_method") & F.col("from_path").rlike(TIER_FILES[language]))


def factory_types(calls: DataFrame, returns: DataFrame) -> DataFrame:
    """Receiver types from factories (name, type) with one return type only, where there is no other type."""
    unique = returns.groupBy(F.col("name").alias("receiver_factory")).agg(F.count_distinct("type").alias("n"), F.min("type").alias("made")).filter("n = 1").drop("n")
    rows = calls.join(unique, "receiver_factory", "left")
    return rows.withColumn("receiver_type", F.coalesce("receiver_type", "made")).drop("made").select(*calls.columns)


def _no_site() -> list[Column]:
    none = F.lit(None).cast("string")
    return [none.alias("to_path"), none.alias("to_lines")]


def class_files(calls: DataFrame, classes: DataFrame, callables: DataFrame) -> DataFrame:
    """Calls (receiver_type, ref_name) whose class and method are declared together in exactly one file.

    Classes: (type, path); callables: (name, path, lines).  The files of both are intersected, as a class
    and its methods stand in one file however it is cut.
    """
    typed = calls.filter("receiver_type IS NOT NULL").select("call_id", F.col("receiver_type").alias("type"), F.col("ref_name").alias("name"))
    files = callables.groupBy("name", "path").agg(F.min("lines").alias("lines"))
    sites = classes.select("type", "path").distinct().join(files, "path").groupBy("type", "name").agg(*_bounds())
    return _single(typed.join(broadcast_if_small(sites), ["type", "name"]), F.col("low") == F.col("high"))


def class_dispatch(calls: DataFrame, bases: DataFrame, classes: DataFrame, callables: DataFrame) -> DataFrame:
    """Calls on a type that other classes implement or extend: the files of those that define the method, and its own.

    Bases: (name, base).  Without an implementing file the call is left to ``class_files``.
    """
    typed = calls.filter("receiver_type IS NOT NULL").select("call_id", "receiver_type", F.col("ref_name").alias("name"))
    heirs = bases.select(F.col("base").alias("receiver_type"), F.col("name").alias("type"), F.lit(True).alias("heir")).distinct()
    own = typed.select("receiver_type").distinct().select("receiver_type", F.col("receiver_type").alias("type"), F.lit(False).alias("heir"))
    family = heirs.unionByName(own)
    sites = classes.select("type", "path").distinct().join(callables.select("name", "path").distinct(), "path")
    met = typed.join(family, "receiver_type").join(sites, ["type", "name"])
    found = met.groupBy("call_id").agg(F.bool_or("heir").alias("open"), F.sort_array(F.collect_set("path")).alias("candidates")).filter("open")
    return found.select("call_id", *_no_site(), "candidates")


def implementers(interfaces: DataFrame, methods: DataFrame) -> DataFrame:
    """(interface, type): types whose methods cover an interface's; an interface without methods fits every type.

    Relational division: count the interface's methods that a type has.  Interfaces: (interface, method or null).
    """
    need = interfaces.groupBy("interface").agg(F.count("method").alias("need"))
    types = methods.select("type", F.col("name").alias("method")).distinct()
    have = interfaces.filter("method IS NOT NULL").distinct().join(types, "method").groupBy("interface", "type").agg(F.count("*").alias("have"))
    full = have.join(need, "interface").filter("have = need").select("interface", "type")
    empty = need.filter("need = 0").select("interface").join(types.select("type").distinct())
    return full.union(empty)


def interface_dispatch(calls: DataFrame, interfaces: DataFrame, methods: DataFrame) -> DataFrame:
    """Calls on an interface-typed receiver fan out to the files of all implementing methods."""
    fits = implementers(interfaces, methods).join(methods, "type").select(F.col("interface").alias("receiver_type"), F.col("name").alias("ref_name"), "path")
    rows = calls.filter("receiver_type IS NOT NULL").select("call_id", "receiver_type", "ref_name").join(fits.distinct(), ["receiver_type", "ref_name"])
    return rows.groupBy("call_id").agg(F.sort_array(F.collect_set("path")).alias("candidates")).select("call_id", F.lit(None).cast("string").alias("to_path"), F.lit(None).cast("string").alias("to_lines"), "candidates")


def virtual_dispatch(calls: DataFrame, ancestors: DataFrame, methods: DataFrame) -> DataFrame:
    """Calls on a base class whose method is virtual, or overridden below it, fan out to the class and its heirs.

    Ancestors: (name, base).  Methods: (type, name, path, is_virtual, is_override).
    """
    family = ancestors.select(F.col("base").alias("receiver_type"), F.col("name").alias("type")).union(
        methods.select(F.col("type").alias("receiver_type"), "type").distinct())
    sites = family.join(methods, "type").withColumn("base", F.col("type") == F.col("receiver_type"))
    grouped = sites.groupBy("receiver_type", F.col("name").alias("ref_name")).agg(
        F.bool_or((F.col("base") & F.col("is_virtual")) | (~F.col("base") & F.col("is_override"))).alias("open"),
        F.sort_array(F.collect_set("path")).alias("candidates"))
    rows = calls.filter("receiver_type IS NOT NULL").select("call_id", "receiver_type", "ref_name").join(grouped.filter("open"), ["receiver_type", "ref_name"])
    return rows.select("call_id", F.lit(None).cast("string").alias("to_path"), F.lit(None).cast("string").alias("to_lines"), "candidates")


def field_receivers(calls: DataFrame, fields: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Receiver types from fields: the class's own field, else that of the nearest base.

    Fields: (class, field, type) and, if there is such a column, ``wrapped``: a wrapped type is reached by
    ``->`` only (``member_op`` of the call).
    """
    fields = fields if "wrapped" in fields.columns else fields.withColumn("wrapped", F.lit(False))
    lineage = ancestors.select(F.col("name").alias("enclosing_class"), F.col("base").alias("class"), "depth").union(
        fields.select(F.col("class").alias("enclosing_class"), "class", F.lit(0).alias("depth")).distinct())
    seen = lineage.join(fields, "class").groupBy("enclosing_class", F.col("field").alias("receiver")).agg(
        F.min_by(F.struct("type", "wrapped"), F.struct("depth", "class")).alias("found"))
    rows = calls.join(seen, ["enclosing_class", "receiver"], "left")
    reached = ~F.col("found.wrapped")
    if "member_op" in calls.columns:
        reached = reached | (F.col("member_op") == "->")
    return rows.withColumn("receiver_type", F.coalesce("receiver_type", F.when(reached, F.col("found.type")))).select(*calls.columns)


def covering_chunk(calls: DataFrame, chunks: DataFrame) -> DataFrame:
    """(call_id, content_hash): the chunk of the call's file that covers its line, else the one starting nearest."""
    pairs = calls.select("call_id", F.col("from_path").alias("path"), "line").join(chunks.select("path", "line_start", "line_end", "content_hash"), "path")
    covers = (F.col("line") >= F.col("line_start")) & (F.col("line") <= F.col("line_end"))
    order = F.struct((~covers).cast("int"), F.abs(F.col("line_start") - F.col("line")), "line_start", "content_hash")
    return pairs.groupBy("call_id").agg(F.min_by("content_hash", order).alias("content_hash"))


#: Method names too common to tell files apart.
COMMON_METHODS = (
    "get", "set", "has", "delete", "add", "clear", "find", "findIndex", "findLast", "filter", "map", "flatMap", "forEach",
    "reduce", "reduceRight", "some", "every", "includes", "indexOf", "lastIndexOf", "push", "pop", "shift", "unshift", "slice",
    "splice", "concat", "join", "split", "sort", "reverse", "fill", "keys", "values", "entries", "next", "then", "catch",
    "finally", "on", "off", "emit", "once", "addListener", "removeListener", "addEventListener", "removeEventListener",
    "dispatchEvent", "toString", "valueOf", "hasOwnProperty", "call", "apply", "bind", "mock", "spy", "fn", "mockReturnValue",
    "mockResolvedValue", "mockImplementation",
)


def disambiguate(calls: DataFrame, definitions: DataFrame, sites: DataFrame, imports: DataFrame | None = None, params: Params = DEFAULTS) -> DataFrame:
    """(call_id, to_path, score): ambiguous calls whose best candidate is near enough and leads by a margin.

    Calls: (call_id, from_path, ref_name, is_method, content_hash, candidates); definitions: (name, path,
    embedding, content_hash); sites: (content_hash, embedding) of call chunks.  With imports (from_path,
    stem), candidates are the call's own file and imported ones.
    """
    open_calls = calls.filter(~(F.coalesce("is_method", F.lit(False)) & F.col("ref_name").isin(*COMMON_METHODS)))
    each = open_calls.select("call_id", "from_path", "ref_name", "content_hash", F.explode("candidates").alias("path"))
    if imports is not None:
        allowed = imports.select("from_path", F.col("stem").alias("s")).distinct()
        stem = strip_ext(F.col("path"))
        other = each.filter("path <> from_path").withColumn("s", stem).join(allowed, ["from_path", "s"], "left_semi").drop("s")
        each = each.filter("path = from_path").unionByName(other)
    here = sites.select("content_hash", F.col("embedding").alias("here")).dropDuplicates(["content_hash"])
    there = definitions.select(F.col("name").alias("ref_name"), "path", F.col("embedding").alias("there"), F.col("content_hash").alias("own"))
    pairs = each.join(here, "content_hash").join(there, ["ref_name", "path"]).filter("own IS NULL OR own <> content_hash")
    best = pairs.withColumn("sim", cosine(F.col("here"), F.col("there"))).groupBy("call_id", "path").agg(F.max("sim").alias("sim"))
    return promote(best, params)


def promote(best: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """From (call_id, path, sim): the winner where it reaches the threshold and leads by the margin."""
    order = Window.partitionBy("call_id").orderBy(F.desc("sim"), "path")
    ranked = best.withColumn("n", F.row_number().over(order)).withColumn("second", F.lead("sim").over(order)).filter("n = 1")
    lead: Column = F.col("second").isNull() | (F.col("sim") - F.col("second") >= params.disambiguate_margin)
    won = ranked.filter((F.col("sim") >= params.disambiguate_threshold) & lead)
    return won.select("call_id", F.col("path").alias("to_path"), floor_to("sim", 4).alias("score"))
