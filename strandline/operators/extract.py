"""Extraction of calls, imports, wikilinks, method sets, class hierarchies and fields from source text.

Python is parsed; of other languages brackets are paired and names before them are read.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.receivers import SMART, Layout, reserved

_CALL = re.compile(r"(?:([A-Za-z_$][\w$]*)\s*(\.|->|::)\s*)?([A-Za-z_$][\w$]*)\s*\(")
_FIELD = re.compile(r"^[ \t]*(?:mutable\s+|const\s+|static\s+)*([A-Za-z_][\w:]*(?:<[^;<>\n]*>)?)\s*[*&]?\s+([A-Za-z_]\w*)\s*(?:=[^;]*)?;", re.M)
_GO_METHOD = re.compile(r"^func\s*\(\s*(?:\w+\s+)?\*?\s*(\w+)[^()\n]*\)\s*(\w+)\s*\(", re.M)
_GO_TYPE = re.compile(r"^type\s+(\w+)\s+(interface|struct)\s*\{", re.M)

CALL_SCHEMA = (
    "kind string, from_path string, line int, from_symbol string, ref_name string, spec string, is_method boolean, "
    "receiver string, receiver_type string, receiver_factory string, member_op string, enclosing_class string, local_target string, "
    "alias string"
)


def _row(kind: str, path: str, line: int, **rest) -> dict:
    base = dict.fromkeys(("from_symbol", "ref_name", "spec", "receiver", "receiver_type", "receiver_factory", "member_op", "enclosing_class", "local_target", "alias"))
    return {"kind": kind, "from_path": path, "line": line, "is_method": False, **base, **rest}


class _Python(ast.NodeVisitor):
    def __init__(self, path: str):
        self.path, self.rows = path, []
        self.function: list[str] = []
        self.cls: list[str] = []

    def _inside(self, stack: list[str], node) -> None:
        stack.append(node.name)
        self.generic_visit(node)
        stack.pop()

    def visit_FunctionDef(self, node) -> None:
        self._inside(self.function, node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node) -> None:
        self._inside(self.cls, node)

    def visit_Call(self, node: ast.Call) -> None:
        where = {"from_symbol": self.function[-1] if self.function else None, "enclosing_class": self.cls[-1] if self.cls else None}
        if isinstance(node.func, ast.Name):
            self.rows.append(_row("calls", self.path, node.lineno, ref_name=node.func.id, **where))
        elif isinstance(node.func, ast.Attribute):
            owner = node.func.value.id if isinstance(node.func.value, ast.Name) else None
            kind = self.cls[-1] if owner == "self" and self.cls else None
            self.rows.append(_row("calls", self.path, node.lineno, ref_name=node.func.attr, receiver=owner, receiver_type=kind, member_op=".", **where) | {"is_method": True})
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.rows.append(_row("imports", self.path, node.lineno, spec=a.name, ref_name=(a.asname or a.name).split(".")[0]))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        up = "./" if node.level == 1 else "../" * (node.level - 1)
        spec = up + (node.module or "").replace(".", "/") if node.level else node.module or ""
        for a in node.names:
            self.rows.append(_row("imports", self.path, node.lineno, spec=spec, ref_name=a.name, alias=a.asname))


def python_edges(path: str, content: str) -> list[dict]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return []
    visitor = _Python(path)
    visitor.visit(tree)
    return visitor.rows


_IMPORTS = (
    re.compile(r"""\bimport\s+(?:type\s+)?(?:([\w$]+)\s*,?\s*)?(?:\{([^}]*)\}|\*\s+as\s+([\w$]+))?\s*(?:from\s*)?["']([^"'\n]+)["']"""),
    re.compile(r"""\b(?:const|let|var)\s+(?:([\w$]+)|\{([^}]*)\})()\s*=\s*require\(\s*["']([^"'\n]+)["']\s*\)"""),
)
_INCLUDE = re.compile(r"""^[ \t]*#\s*include\s+(["<])([^">\n]+)[">]""", re.M)


def _blank_comments(content: str) -> str:
    """Comments as blanks of the same shape, so lines and offsets stay."""
    return re.sub(r"/\*.*?\*/|//[^\n]*", lambda m: re.sub(r"[^\n]", " ", m.group()), content, flags=re.S)


def braced_edges(path: str, language: str, content: str) -> list[dict]:
    """Approximate calls and imports of C-family languages."""
    bare = _blank_comments(content)
    rows: list[dict] = []
    for pattern in _IMPORTS if language in ("javascript", "typescript", "tsx") else ():
        for m in pattern.finditer(bare):
            names = [n for n in (m.group(1), m.group(3)) if n]
            names += [re.split(r"\s+as\s+", n.strip())[0] for n in (m.group(2) or "").split(",") if n.strip()]
            line = bare[: m.start()].count("\n") + 1
            rows += [_row("imports", path, line, spec=m.group(4), ref_name=n) for n in names or [m.group(4)]]
    if language in ("c", "cpp", "hlsl", "glsl"):
        for m in _INCLUDE.finditer(bare):
            spec = ("./" if m.group(1) == '"' else "") + m.group(2)
            rows.append(_row("imports", path, bare[: m.start()].count("\n") + 1, spec=spec, ref_name=m.group(2)))
    layout, skip = Layout(bare, language), reserved(language)
    for m in _CALL.finditer(bare):
        name, owner = m.group(3), m.group(1)
        before = bare[max(0, m.start() - 12) : m.start()]
        if (name in skip and owner is None) or m.start(3) in layout.names or layout.declares(m) or re.search(r"\b(function|func|fn|def|class|new)\s+$", before):
            continue
        around = layout.around(m.start())
        cls = (around.owner if around else None) or layout.class_at(m.start())
        kind = factory = local = None
        if owner in ("this", "self"):
            kind = cls
        elif owner is not None and m.group(2) != "::":
            kind, made = (layout.bindings(around) if around else {}).get(owner, (None, False))
            if made:
                kind, factory = None, kind
            if name in layout.literals.get(owner, ()):
                local = name
        elif m.group(2) == "::":
            kind = owner
        found = _row("calls", path, bare[: m.start()].count("\n") + 1, ref_name=name, from_symbol=around.name if around else None, receiver=owner, receiver_type=kind, receiver_factory=factory, member_op=m.group(2), enclosing_class=cls, local_target=local)
        rows.append(found | {"is_method": owner is not None})
    return rows


def extract_edges(files: DataFrame) -> DataFrame:
    """Calls and imports of (path, language, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in CALL_SCHEMA.split(", ")]
        for batch in batches:
            rows: list[dict] = []
            for p, language, t in zip(batch["path"], batch["language"], batch["content"], strict=True):
                if t is not None and language != "markdown":
                    rows += python_edges(p, t) if language == "python" else braced_edges(p, language, t)
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "language", "content").mapInPandas(run, CALL_SCHEMA)


def wikilinks(notes: DataFrame) -> DataFrame:
    """(kind, from_path, line, target) of ``[[target#heading|alias]]`` and ``![[...]]`` outside fences; plain expressions.

    A text is split at its fences; of every second piece only the line ends stay, so lines keep their numbers.
    """
    pieces = F.split("content", r"(?md)^[ \t\x0B\f\r]*(?:```|~~~)[^\n]*", -1)
    open_text = F.array_join(F.transform(pieces, lambda x, k: F.when(k % 2 == 0, x).otherwise(F.regexp_replace(x, r"[^\n]+", ""))), "")
    rows = notes.select("path", F.posexplode(F.split(open_text, "\n", -1)).alias("n", "row"))
    marks = F.regexp_extract_all("row", F.lit(r"(!?\[\[[^\]\n]+\]\])"), F.lit(1))
    each = rows.select("path", (F.col("n") + 1).alias("line"), F.explode(marks).alias("mark"))
    target = F.btrim(F.regexp_extract("mark", r"\[\[([^\]|#]*)", 1))
    kind = F.when(F.col("mark").startswith("!"), "embeds").otherwise("links")
    return each.select(kind.alias("kind"), F.col("path").alias("from_path"), "line", target.alias("target")).filter("target <> ''")


def _statement_before(text: str, at: int) -> str:
    """What stands before a place since the last brace or semicolon."""
    return text[max(text.rfind(c, 0, at) for c in ";{}") + 1 : at]


def _fields(body: str, language: str) -> Iterator[tuple[str, str, bool]]:
    """(name, type, wrapped) of member declarations."""
    if language in ("typescript", "tsx", "javascript"):
        for name, kind in re.findall(r"(?:^|[;{}(,])\s*(?:(?:public|private|protected|readonly|static)\s+)*([\w$]+)\s*[?!]?\s*:\s*([A-Z][\w$]*)", body):
            yield name, kind, False
        return
    for kind, name in _FIELD.findall(body):
        inner = re.match(r"(?:\w+::)*(\w+)<\s*(?:const\s+)?([\w:]+)", kind)
        smart = bool(inner and inner.group(1) in SMART)
        real = inner.group(2) if inner and smart else kind
        if real not in ("return", "using", "typedef", "delete", "throw"):
            yield name, real.split("::")[-1].split("<")[0], smart


def type_facts(path: str, language: str, content: str) -> list[dict]:
    """Rows (fact, owner, name, detail, wrapped): classes, methods, bases, fields, virtuals, overrides, interface methods, returns.

    The detail of a field is its type; it is wrapped where only ``->`` reaches that.
    """
    bare = _blank_comments(content)
    out: list[dict] = []
    seen: set[tuple] = set()

    def add(fact: str, owner: str | None, name: str | None, detail: str | None = None, wrapped: bool = False) -> None:
        if (fact, owner, name, detail) not in seen:
            seen.add((fact, owner, name, detail))
            out.append({"fact": fact, "path": path, "language": language, "owner": owner, "name": name, "detail": detail, "wrapped": wrapped})

    layout = Layout(bare, language)
    if language == "go":
        for m in _GO_METHOD.finditer(bare):
            add("method", m.group(1), m.group(2))
        for m in _GO_TYPE.finditer(bare):
            body = bare[m.end() : layout.pair.get(m.end() - 1, len(bare))]
            if m.group(2) == "interface":
                for n in re.findall(r"(?:^|[;\n])\s*(\w+)\s*\(", body) or [None]:
                    add("interface", m.group(1), n)
            else:
                for name, kind in re.findall(r"^\s*(\w+)\s+\*?([\w.]+)\s*(?:`[^`]*`)?\s*$", body, re.M):
                    add("field", m.group(1), name, kind.split(".")[-1])
        for f in layout.functions:
            if f.owner is None and f.result:
                add("returns", None, f.name, f.result)
        return out
    for start, end, word, name, clause in layout.classes:
        body = bare[start + 1 : end]
        add("class", name, name)
        # C++ keeps its bases behind a colon, other languages behind words.
        written = clause.split(":", 1)[1] if ":" in clause and language not in ("typescript", "tsx", "javascript") else re.sub(r"^\s*<[^{}]*?>", " ", clause)
        written = re.sub(r"\b(?:extends|implements)\b", ",", written)
        for b in re.findall(r"[A-Za-z_$][\w:$.]*", re.sub(r"<[^<>]*>|\b(?:public|private|protected|virtual|final|abstract)\b", " ", written)):
            add("base", name, re.split(r"::|\.", b)[-1])
        if word == "interface":
            for n in re.findall(r"(?:^|[;\n{])\s*(?:readonly\s+)?([A-Za-z_$][\w$]*)\s*\??\s*(?:<[^<>]*>)?\s*[(:]", body) or [None]:
                add("interface", name, n)
        for m in re.finditer(r"\bvirtual\b", body):
            called = re.match(r"[^;{}()]*?([A-Za-z_]\w*)\s*\(", body[m.end() :])
            if called:
                add("virtual", name, called.group(1))
        for m in re.finditer(r"\boverride\b", body):
            called = re.search(r"([A-Za-z_]\w*)\s*\(", _statement_before(body, m.start()))
            if called:
                add("override", name, called.group(1))
        for n, kind, smart in _fields(body, language):
            add("field", name, n, kind, smart)
    for f in layout.functions:
        if f.owner:
            add("method", f.owner, f.name)
        add("callable", None, f.name)
        if f.result and f.result not in ("void", "auto"):
            add("returns", None, f.name, f.result)
    for f in re.findall(r"^(?:static\s+|inline\s+)*([A-Z]\w*)[ \t]*[*&]?[ \t]+([a-z_]\w*)\s*\(", bare, re.M) if language in ("c", "cpp") else ():
        add("returns", None, f[1], f[0])
    return out


TYPE_SCHEMA = "fact string, path string, language string, owner string, name string, detail string, wrapped boolean"


def extract_types(files: DataFrame) -> DataFrame:
    """(fact, path, language, owner, name, detail, wrapped) of (path, language, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, g, t in zip(batch["path"], batch["language"], batch["content"], strict=True) if t is not None for r in type_facts(p, g, t)]
            yield pd.DataFrame(rows, columns=["fact", "path", "language", "owner", "name", "detail", "wrapped"])

    return files.filter("language NOT IN ('python', 'markdown')").select("path", "language", "content").mapInPandas(run, TYPE_SCHEMA)


def inventory(chunks: DataFrame, notes: bool = False) -> DataFrame:
    """(name, path, line_start, line_end, text): precise symbol spans, else declared names; a note is one symbol."""
    from strandline.functions.symbols import declared_callables
    from strandline.functions.text import basename
    from strandline.sources.tables import first_by

    if notes:
        rows = first_by(chunks, ["path"], "line_start")
        return rows.select(F.regexp_replace(basename("path"), r"\.md$", "").alias("name"), "path", "line_start", "line_end", "text")
    guess = F.transform(declared_callables("text"), lambda n: F.struct(n.alias("name"), F.col("line_start").alias("line_start"), F.col("line_end").alias("line_end")))
    spans = F.when(F.size("symbols") > 0, F.col("symbols")).otherwise(guess)
    rows = chunks.select("path", "text", F.explode(spans).alias("s")).select("s.name", "path", "s.line_start", "s.line_end", "text")
    return first_by(rows, ["path", "name"], "line_start")
