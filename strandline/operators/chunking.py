"""Chunkers: line windows with overlap, Markdown sections, Python and brace-language units.

A file's chunks depend on what came before in it, so a file is chunked by one call; files are spread
over tasks by Arrow batches.  Offsets and lengths count code points.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from strandline.params import DEFAULTS, Params

Chunk = dict


def _chunk(path: str, language: str, text: str, start: int, line: int, scope: list[str], symbols: list[tuple[str, int, int]]) -> Chunk:
    body = text.strip()
    digest = hashlib.sha1(body.encode()).hexdigest()[:8]
    end = start + len(text)
    return {
        "id": f"{path}::{start}-{end}::{digest}", "path": path, "language": language, "chunk_start": start, "chunk_end": end,
        "line_start": line, "line_end": line + text.rstrip("\n").count("\n"), "text": body, "scope": scope,
        "symbols": [{"name": n, "line_start": a, "line_end": b} for n, a, b in symbols],
    }


def windows(path: str, language: str, content: str, params: Params = DEFAULTS, start: int = 0, line: int = 1, scope: list[str] | None = None) -> list[Chunk]:
    """Runs of whole lines of about ``max_chars``; the end of a run, up to ``overlap_chars``, opens the next.

    What is carried is a proper suffix of the run.  Runs shorter than ``min_chars`` are left out; the
    last carry is a chunk of its own if it is long enough.
    """
    out: list[Chunk] = []
    held: list[str] = []
    size, at, at_line, fresh = 0, start, line, 0

    def flush() -> None:
        nonlocal held, size, at, at_line, fresh
        text = "".join(held)
        if len(text.strip()) >= params.min_chars:
            out.append(_chunk(path, language, text, at, at_line, scope or [], []))
        keep, kept = 0, 0
        while keep < len(held) - 1 and kept + len(held[-1 - keep]) <= params.overlap_chars:
            kept += len(held[-1 - keep])
            keep += 1
        gone = held[: len(held) - keep]
        at, at_line = at + sum(map(len, gone)), at_line + len(gone)
        held, size, fresh = held[len(held) - keep :], kept, 0

    for row in content.splitlines(keepends=True) if "\r" not in content else re.findall(r"[^\n]*\n|[^\n]+", content):
        if held and size + len(row) > params.max_chars:
            flush()
        held.append(row)
        size, fresh = size + len(row), fresh + 1
    if held:
        flush()
        if held and len("".join(held).strip()) >= params.min_chars:
            out.append(_chunk(path, language, "".join(held), at, at_line, scope or [], []))
    return out


def front_matter(content: str) -> tuple[dict, int]:
    """(title, tags and aliases, length of the block)."""
    m = re.match(r"---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)", content, re.S)
    if not m:
        return {}, 0
    out: dict = {}
    key = None
    for row in m.group(1).splitlines():
        item, pair = re.match(r"\s*-\s+(.*)$", row), re.match(r"([A-Za-z_][\w-]*):\s*(.*)$", row)
        if pair:
            key, value = pair.group(1), pair.group(2).strip()
            inline = re.match(r"\[(.*)\]$", value)
            clean = lambda v: v.strip().strip("\"'")
            out[key] = [clean(v) for v in inline.group(1).split(",") if v.strip()] if inline else clean(value) if value else []
        elif item and key is not None:
            out.setdefault(key, [])
            if isinstance(out[key], list):
                out[key].append(item.group(1).strip().strip("\"'"))
    return out, m.end()


def headings(content: str) -> list[tuple[int, int, int, str]]:
    """(offset, line, level, title) outside fenced code."""
    out, fenced, at = [], False, 0
    for n, row in enumerate(content.split("\n"), 1):
        if re.match(r"\s*(```|~~~)", row):
            fenced = not fenced
        elif not fenced and (m := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", row)):
            out.append((at, n, len(m.group(1)), m.group(2)))
        at += len(row) + 1
    return out


def markdown(path: str, content: str, params: Params = DEFAULTS) -> list[Chunk]:
    """A chunk for each section that has text of its own; long ones are cut into windows; scope is the heading trail."""
    meta, skip = front_matter(content)
    marks = [h for h in headings(content) if h[0] >= skip]
    edges = [(skip, content[:skip].count("\n") + 1, 0, "")] + marks if not marks or content[skip : marks[0][0]].strip() else marks
    title = meta.get("title") if isinstance(meta.get("title"), str) else None
    out: list[Chunk] = []
    trail: list[tuple[int, str]] = []
    for k, (at, line, level, name) in enumerate(edges):
        end = edges[k + 1][0] if k + 1 < len(edges) else len(content)
        text = content[at:end]
        if level:
            while trail and trail[-1][0] >= level:
                trail.pop()
            trail.append((level, name))
        body = text.split("\n", 1)[1] if level and "\n" in text else "" if level else text
        if not body.strip():
            continue
        scope = ([title] if title else []) + [t for _, t in trail]
        if len(text) <= params.max_chars:
            out.append(_chunk(path, "markdown", text, at, line, scope, []))
        else:
            out += windows(path, "markdown", text, params, at, line, scope)
    return out


_UNIT = re.compile(
    r"^[ \t]*(?:export\s+|pub(?:lic)?\s+|private\s+|protected\s+|static\s+|async\s+|default\s+|abstract\s+)*"
    r"(?:func\s*\([^()\n]*\)\s*([A-Za-z_]\w*)[^\n;{]*"
    r"|(?:function|class|interface|struct|enum|trait|impl|fn|func|namespace|type)\b[^\n;{]*?([A-Za-z_$][\w$]*)[^\n;{]*"
    r"|[A-Za-z_][\w:<>,*& \t]*?[ \t*&]([A-Za-z_]\w*)[ \t]*\([^;{}]*\)[^;{}\n]*)\{",
    re.M,
)


def _close(content: str, at: int) -> int:
    """The offset after the brace that closes the one at ``at``; strings and comments are skipped."""
    depth, k = 0, at
    while k < len(content):
        c = content[k]
        if c in "\"'`":
            end = k + 1
            while end < len(content) and content[end] != c and (c == "`" or content[end] != "\n"):
                end += 2 if content[end] == "\\" else 1
            k = end
        elif content.startswith("//", k):
            k = content.find("\n", k)
            if k < 0:
                return len(content)
        elif content.startswith("/*", k):
            k = content.find("*/", k) + 1
            if k < 1:
                return len(content)
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return k + 1
        k += 1
    return len(content)


def units(language: str, content: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of top-level units in order."""
    if language == "python":
        try:
            tree = ast.parse(content)
        except (SyntaxError, ValueError):
            return []
        rows = [0]
        for row in content.split("\n"):
            rows.append(rows[-1] + len(row) + 1)
        found = []
        for node in tree.body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                found.append((rows[first - 1], min(rows[node.end_lineno or node.lineno], len(content)), node.name))
        return found
    found, at = [], 0
    while m := _UNIT.search(content, at):
        end = _close(content, m.end() - 1)
        found.append((m.start(), end, m.group(1) or m.group(2) or m.group(3)))
        at = max(end, m.end())
    return found


def code(path: str, language: str, content: str, params: Params = DEFAULTS) -> list[Chunk]:
    """Neighbouring units merged up to ``max_chars``; longer ones cut into windows; windows where no unit is found."""
    found = units(language, content)
    if not found:
        return windows(path, language, content, params)
    groups: list[list[tuple[int, int, str]]] = []
    for u in found:
        if groups and u[1] - groups[-1][0][0] <= params.max_chars:
            groups[-1].append(u)
        else:
            groups.append([u])
    out: list[Chunk] = []
    for g in groups:
        start, end = g[0][0], max(u[1] for u in g)
        line = content[:start].count("\n") + 1
        text = content[start:end]
        spans = [(n, content[:a].count("\n") + 1, content[:b].rstrip("\n").count("\n") + 1) for a, b, n in g]
        if len(text) > params.max_chars:
            for c in windows(path, language, text, params, start, line, [g[-1][2]]):
                c["symbols"] = [{"name": n, "line_start": a, "line_end": b} for n, a, b in spans if a <= c["line_end"] and c["line_start"] <= b]
                out.append(c)
        elif len(text.strip()) >= min(params.min_chars, 1):
            out.append(_chunk(path, language, text, start, line, [g[-1][2]], spans))
    return out


_BRACED = {"javascript", "typescript", "tsx", "rust", "go", "c", "cpp", "java", "csharp", "php", "hlsl", "glsl"}


def chunk_file(path: str, language: str, content: str, params: Params = DEFAULTS) -> list[Chunk]:
    if language == "markdown":
        return markdown(path, content, params)
    if language == "python" or language in _BRACED:
        return code(path, language, content, params)
    return windows(path, language, content, params)


SCHEMA = (
    "id string, path string, language string, chunk_start int, chunk_end int, line_start int, line_end int, text string, "
    "scope array<string>, symbols array<struct<name:string,line_start:int,line_end:int>>"
)


def chunk_files(files: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Chunks of (path, language, content); other columns are not read.  Null content has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["id", "path", "language", "chunk_start", "chunk_end", "line_start", "line_end", "text", "scope", "symbols"]
        for batch in batches:
            rows = [c for p, l, t in zip(batch["path"], batch["language"], batch["content"], strict=True) if t is not None for c in chunk_file(p, l, t, params)]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "language", "content").mapInPandas(run, SCHEMA)
