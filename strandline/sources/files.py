"""File, git, JSON, SCIP and span sources."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import predicates
from strandline.functions.text import line_count, slice_lines

#: Indexable extensions and their language; those without a grammar stand for themselves.
LANGUAGES = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "rs": "rust", "go": "go", "sh": "bash", "c": "c", "h": "cpp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp",
    "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "m": "objc", "mm": "objc", "metal": "cpp", "hlsl": "hlsl", "hlsli": "hlsl",
    "fx": "hlsl", "fxh": "hlsl", "glsl": "glsl", "vert": "glsl", "frag": "glsl", "comp": "glsl", "geom": "glsl", "tesc": "glsl",
    "tese": "glsl", "wgsl": "wgsl", "slang": "hlsl", "json": "json", "toml": "toml", "yml": "yaml", "yaml": "yaml", "css": "css",
    "html": "html", "md": "markdown", "mdx": "markdown",
}


def language_of(path: Column) -> Column:
    """Language by extension, from a literal map; unknown ones are the extension itself."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    pairs = [F.lit(x) for item in LANGUAGES.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[ext], ext)


def walk(
    spark: SparkSession, root: str, patterns: list[str] | None = None, max_bytes: int = 262_144
) -> DataFrame:
    """(path, mtime_ms, content, language) of the wanted files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.split("://", 1)[-1].rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^" + base.replace(".", r"\.") + "/", "")
    rows = files.filter(F.col("length") <= max_bytes).select(
        relative.alias("path"),
        F.floor(F.unix_millis("modificationTime")).alias("mtime_ms"),
        F.col("content").cast("string").alias("content"),
    )
    return rows.filter(predicates.scanned(F.col("path"), list(LANGUAGES), patterns)).withColumn(
        "language", language_of(F.col("path"))
    )


def stat_paths(listing: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files among the wanted paths, wanted paths that are missing); skipped folders count as neither."""
    skip = "|".join(d.replace(".", r"\.") for d in predicates.SKIP_DIRS)
    asked = wanted.select("path").distinct().filter(~F.col("path").rlike(rf"(^|/)({skip})/"))
    return listing.join(asked, "path", "left_semi"), asked.join(listing.select("path"), "path", "left_anti")


def inside(path: Column) -> Column:
    """A path that does not leave the collection."""
    return ~F.array_contains(F.split(path, "/"), "..") & ~path.startswith("/")


def lines_of_code(files: DataFrame, max_bytes: int = 2 * 1024 * 1024) -> DataFrame:
    """(file, loc) of (path, content): files beyond the size and paths outside the collection are left out."""
    fit = files.filter(inside(F.col("path")) & (F.octet_length("content") <= max_bytes))
    return fit.select(F.col("path").alias("file"), line_count("content").alias("loc"))


def read_span(files: DataFrame, path: str, first: int, last: int, context: int = 0) -> DataFrame:
    """(path, line_start, line_end, text): a clamped span with up to 50 lines around it."""
    if ".." in path.split("/") or path.startswith("/"):
        raise ValueError("a path inside the collection is needed")
    around = min(max(context, 0), 50)
    n = F.size(F.split("content", "\n", -1))
    a, b = F.greatest(F.lit(first - around), F.lit(1)), F.least(F.lit(last + around), n)
    return files.filter(F.col("path") == path).select(
        "path", a.alias("line_start"), b.alias("line_end"), slice_lines("content", a, b).alias("text")
    )


def parse_git_log(log: DataFrame, column: str = "log") -> DataFrame:
    """(hash, files) from text of ``git log --name-only --pretty=format:%x01%H``."""
    commits = log.select(F.explode(F.split(column, "\x01")).alias("commit")).filter(F.trim("commit") != "")
    lines = F.filter(F.transform(F.split("commit", "\n"), lambda x: F.btrim(x, F.lit(" \r\t"))), lambda x: x != "")
    return commits.select(lines.alias("lines")).select(
        F.get("lines", F.lit(0)).alias("hash"), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))).alias("files")
    )


def git_log(spark: SparkSession, repo: str, window: int = 1000) -> DataFrame:
    """Commits of a local repository: the newest ``window`` of them."""
    text = subprocess.run(
        ["git", "-C", repo, "log", f"-n{int(window)}", "--name-only", "--pretty=format:%x01%H"],
        capture_output=True, text=True, check=True,
    ).stdout
    return parse_git_log(spark.createDataFrame([(text,)], "log string"))


def read_json_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Golden sets and baselines; records that do not parse give nulls."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


def decode_scip(data: bytes) -> list[dict]:
    """Rows (path, range, symbol, roles) of an index message.

    Fixed values: documents are field 2 of the index; of a document, path is 1 and occurrences are 2;
    of an occurrence, range is 1, symbol 2, roles 3.
    """
    rows = []
    for number, document in _fields(data):
        if number != 2 or not isinstance(document, bytes):
            continue
        path, found = "", []
        for n, value in _fields(document):
            if n == 1:
                path = value.decode()
            elif n == 2:
                row: dict = {"range": [], "symbol": "", "roles": 0}
                for m, v in _fields(value):
                    if m == 1 and isinstance(v, bytes):
                        at = 0
                        while at < len(v):
                            x, at = _varint(v, at)
                            row["range"].append(x)
                    elif m == 1:
                        row["range"].append(v)
                    elif m == 2:
                        row["symbol"] = v.decode()
                    elif m == 3:
                        row["roles"] = v
                found.append(row)
        rows += [{"path": path, **r} for r in found]
    return rows


def read_scip(spark: SparkSession, path: str) -> DataFrame:
    """(path, range, symbol, roles); decoded where the file is, one task a file."""
    import pandas as pd

    def decode(batches):
        for batch in batches:
            rows = [r for content in batch["content"] for r in decode_scip(bytes(content))]
            yield pd.DataFrame(rows, columns=["path", "range", "symbol", "roles"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(decode, "path string, range array<int>, symbol string, roles int")


def scip_facts(occurrences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first definition of each symbol, references to methods) with lines from 1.  Role bit 1 marks definitions."""
    rows = occurrences.filter(~F.col("symbol").startswith("local ")).select(
        "path", "symbol", (F.get("range", F.lit(0)) + 1).alias("line"), (F.col("roles").bitwiseAND(1) == 1).alias("defines")
    )
    from strandline.sources.tables import first_by

    definitions = first_by(rows.filter("defines"), ["symbol"], "path", "line").select("symbol", "path", "line")
    method = F.regexp_extract("symbol", r"#([A-Za-z_$][A-Za-z0-9_$]*)\(", 1)
    calls = rows.filter(~F.col("defines")).withColumn("method", method).filter("method <> ''")
    return definitions, calls.select("path", "line", "symbol", "method")
