"""Predicates over queries and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.text import WORD, basename, strip


def is_symbol_query(query: Column) -> Column:
    """A single bare identifier."""
    return strip(query).rlike(f"^{WORD}$")


#: Directories that hold tests, the words that mark a test file or a question about tests.
TEST_DIRS = ("test", "tests", "__tests__", "__mocks__", "spec", "specs", "e2e")
TEST_WORDS = ("test", "spec")
ASKING_FOR_TESTS = ("test", "tests", "spec", "specs", "mock", "mocks", "fixture", "fixtures")
#: Beginnings of entry files, directories of programs, names of entries and of what handles events.
ENTRY_FILES = ("main.", "index.", "cli.", "readme.", "home.")
PROGRAM_DIRS = ("bin",)
ENTRY_NAMES = ("main", "default", "handler", "setup", "run", "init")
HANDLERS = ("on", "handle")
#: Kinds of public items.
PUBLIC_KINDS = ("fn", "struct", "enum", "trait", "mod", "const")

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _shape(token: Column, lower: str, upper: str, digit: str, underscore: str) -> Column:
    """The token with every character replaced by the sign of its class."""
    return F.translate(token, _LOWER + _UPPER + _DIGITS + "_", lower * 26 + upper * 26 + digit * 10 + underscore)


def _looks_named(token: Column) -> Column:
    """A hump, an acronym before a word, a snake, a letter beside a digit, or a dotted path."""
    cased, letters, chars = _shape(token, "a", "A", "9", "_"), _shape(token, "a", "a", "9", "_"), _shape(token, "w", "w", "w", "w")
    signs = [(cased, "aA"), (cased, "AAa"), (letters, "a_a"), (letters, "a_9"), (letters, "a9"), (letters, "9a"), (chars, "w.w")]
    out = F.lit(False)
    for shape, sign in signs:
        out = out | F.contains(shape, F.lit(sign))
    return out


def query_identifiers(query: Column) -> Column:
    tokens = F.regexp_extract_all(query, F.lit(r"[A-Za-z_$][A-Za-z0-9_$.]*"), F.lit(0))
    return F.filter(tokens, _looks_named)


def has_identifier(query: Column) -> Column:
    return F.size(query_identifiers(query)) > 0


def _parts(path: Column) -> Column:
    """Directories and file name in lower case."""
    return F.split(F.translate(F.lower(path), "\\", "/"), "/")


def _dirs(path: Column) -> Column:
    parts = _parts(path)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def is_test_path(path: Column) -> Column:
    """In a directory of tests, a file whose last word is that of a test, or a pytest file."""
    name = F.element_at(_parts(path), -1)
    pieces = F.split(name, "[.]")
    ending = F.element_at(pieces, -1)
    stem = F.array_join(F.slice(pieces, F.lit(1), F.size(pieces) - 1), ".")
    last_word = F.element_at(F.split(stem, "[._-]"), -1)
    marked = (F.size(pieces) > 1) & last_word.isin(*TEST_WORDS) & (F.translate(ending, _LOWER + _DIGITS, "") == "") & (ending != "")
    pytest_name = name.startswith("test_") & name.endswith(".py")
    return F.arrays_overlap(_dirs(path), F.array(*map(F.lit, TEST_DIRS))) | marked | pytest_name


def seeks_tests(query: Column) -> Column:
    words = F.split(F.lower(query), "[^a-z0-9_]+")
    return F.arrays_overlap(words, F.array(*map(F.lit, ASKING_FOR_TESTS)))


def is_notes_model(model: str) -> bool:
    """Prose embedding models run in notes mode."""
    return any(mark in model.lower() for mark in ("nomic", "embed-text"))


def path_prior(path: Column, query: Column, test_penalty: float = 0.5, notes: bool = False) -> Column:
    """1, or the penalty for test paths of a query that does not ask for tests."""
    if notes:
        return F.lit(1.0)
    return F.when(is_test_path(path) & ~seeks_tests(query), F.lit(test_penalty)).otherwise(F.lit(1.0))


def _exported(name: Column, text: Column) -> Column:
    """The text exports a name, on its line or by exporting all."""
    words = F.transform(F.split(text, "\n"), lambda line: F.concat(F.lit(" "), F.array_join(F.split(line, "[^A-Za-z0-9_$]+"), " "), F.lit(" ")))
    own = F.concat(F.lit(" "), name, F.lit(" "))

    def after(line: Column, lead: str) -> Column:
        rest = F.get(F.split(line, f" {lead} ", 2), F.lit(1))
        return F.coalesce(F.contains(F.concat(F.lit(" "), rest), own), F.lit(False))

    def exports(line: Column) -> Column:
        out = after(line, "export")
        for kind in PUBLIC_KINDS:
            out = out | after(line, f"pub {kind}")
        return out

    on_line = F.exists(words, exports)
    together = F.regexp_replace(text, r"\s+", " ")
    whole = F.contains(text, F.lit("__all__")) | F.contains(text, F.lit("module.exports")) | F.contains(together, F.lit("export default"))
    return F.coalesce((name != "") & (whole | on_line), F.lit(False))


def entrypoint_reason(path: Column, name: Column, text: Column) -> Column:
    """Why a symbol without inbound edges may still be reached; null if nothing says so.  First rule wins."""

    def opens(part: Column) -> Column:
        out = F.lit(False)
        for beginning in ENTRY_FILES:
            out = out | part.startswith(beginning)
        return out

    entry_file = F.arrays_overlap(_dirs(path), F.array(*map(F.lit, PROGRAM_DIRS))) | F.exists(_parts(path), opens)
    entry_name = name.isin(*ENTRY_NAMES)
    for lead in HANDLERS:
        entry_name = entry_name | (name.startswith(lead) & F.substr(name, F.lit(len(lead) + 1), F.lit(1)).between("A", "Z"))
    go_exported = (F.element_at(F.split(_parts(path)[F.size(_parts(path)) - 1], "[.]"), -1) == "go") & F.substr(name, F.lit(1), F.lit(1)).between("A", "Z")
    return (
        F.when(is_test_path(path), "test path")
        .when(entry_file, "entry file")
        .when(entry_name, "entry/handler name")
        .when(_exported(name, text), "exported")
        .when(go_exported, "go exported")
    )


#: Directories and file endings that scans skip.
SKIP_DIRS = (
    "node_modules", ".git", "dist", "build", ".next", ".turbo", ".cache", "target", "coverage", ".obsidian", ".trash",
    ".worktrees", ".venv", "test-results", "playwright-report", "src-tauri", "vendor", "third_party", "thirdparty", "external",
    "Debug", "debug", "Release", "release", "x64", ".vs", "obj",
)
SKIP_SUFFIXES = (".excalidraw.md", ".lock", ".min.js", ".min.css", ".map")


def glob_regex(pattern: str) -> str:
    """A gitignore pattern as a regular expression over repo-relative paths."""
    anchored = pattern.startswith("/") or "/" in pattern.rstrip("/")
    body, out, k = pattern.strip("/"), "", 0
    while k < len(body):
        if body[k : k + 3] == "**/":
            out, k = out + "(?:.*/)?", k + 3
        elif body[k : k + 2] == "**":
            out, k = out + ".*", k + 2
        elif body[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif body[k] == "?":
            out, k = out + "[^/]", k + 1
        elif body[k] == "[" and "]" in body[k + 2 :]:
            end = body.index("]", k + 2)
            inner = body[k + 1 : end]
            out, k = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end + 1
        else:
            out, k = out + ("\\" + body[k] if body[k] in r"\.^$+{}()|[]" else body[k]), k + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if pattern.endswith("/") else "(?:/|$)")


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last matching pattern ignores a path; ``!`` patterns take it back."""
    out = F.lit(False)
    for p in (p.strip() for p in patterns):
        if p and not p.startswith("#"):
            keep = p.startswith("!")
            out = F.when(path.rlike(glob_regex(p[keep:])), F.lit(not keep)).otherwise(out)
    return out


def scanned(path: Column, extensions: list[str], patterns: list[str] | None = None) -> Column:
    """Files that a scan takes: known extension, no skipped directory or suffix, no editor lock, not ignored."""
    skip_dirs = "|".join(d.replace(".", r"\.") for d in SKIP_DIRS)
    wanted = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(*extensions)
    bad_suffix = F.lit(False)
    for s in SKIP_SUFFIXES:
        bad_suffix = bad_suffix | path.endswith(s)
    lock = basename(path).startswith(".#")
    return wanted & ~path.rlike(rf"(^|/)({skip_dirs})/") & ~bad_suffix & ~lock & ~ignored(path, patterns or [])
