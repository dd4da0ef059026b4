"""Names that source text declares: a scan over words and braces as column expressions, without length bounds.

Text is cut at blanks, and a name is the identifier that opens the piece after a keyword; or at braces,
and the statement in front of an opening brace is looked at for a name with a parameter list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords before a declared name, those before a callable one, and those before a value.
DECLARING = ("function", "func", "def", "class", "fn", "interface", "type", "struct", "impl", "trait", "enum", "const", "let", "var")
CALLABLE = ("function", "func", "def", "fn", "class", "struct", "impl", "trait")
BINDING = ("const", "let", "var")
#: What may stand between a parameter list and its body.
QUALIFIERS = ("noexcept", "const", "override", "final", "mutable", "volatile")
#: Words that stand before a parenthesis and a brace without being defined there.
NOT_NAMES = (
    "if", "for", "while", "switch", "catch", "return", "sizeof", "do", "else", "decltype", "constexpr", "requires",
    "static_assert", "function", "operator", "typedef", "using", "namespace",
)
_IDENTIFIER = r"^[A-Za-z_$][A-Za-z0-9_$]*"
_NAME = r"^[A-Za-z_][A-Za-z0-9_]*$"


def _but_last(parts: Column) -> Column:
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def _but_first(parts: Column) -> Column:
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def _named(found: Column) -> Column:
    return F.filter(found, lambda name: name != "")


def after_keyword(text: Column, keywords: tuple[str, ...]) -> Column:
    """Identifiers that follow one of the keywords and blanks, in order."""
    pieces = F.split(text, r"\s+")

    def name(piece: Column, following: Column) -> Column:
        word = F.regexp_extract(piece, "[A-Za-z0-9_]+$", 0)
        generator = F.regexp_extract(piece, r"([A-Za-z0-9_]+)\*$", 1) == "function"
        return F.when(word.isin(*keywords) | (generator & F.lit(keywords is CALLABLE)), F.regexp_extract(following, _IDENTIFIER, 0)).otherwise("")

    return _named(F.zip_with(_but_last(pieces), _but_first(pieces), name))


def function_values(text: Column) -> Column:
    """Names bound to a function or an arrow."""
    starts = _but_first(F.split(text, rf"(?<![A-Za-z0-9_])(?:{'|'.join(BINDING)})\s+"))

    def name(rest: Column) -> Column:
        statement = F.split(rest, ";", 2)[0]
        sides = F.split(statement, "=", 2)
        left, value = sides[0], F.trim(F.regexp_replace(F.coalesce(F.get(sides, F.lit(1)), F.lit("")), r"\s+", " "))
        found = F.regexp_extract(left, _IDENTIFIER, 0)
        untyped = F.trim(F.regexp_replace(F.substr(left, F.length(found) + 1), r"\s+", " "))
        value = F.when(value.startswith("async "), F.substr(value, F.lit(7))).otherwise(value)
        arrow = F.split(value, "=>", 2)
        head = F.split(arrow[0], ":", 2)
        names = F.regexp_replace(head[0], r"^\(|\)\s*$", "")
        result = F.coalesce(F.get(head, F.lit(1)), F.lit(""))
        is_arrow = (F.size(arrow) == 2) & names.rlike(r"^[A-Za-z0-9_$,\s]*$") & ~result.rlike("[={]")
        is_function = F.regexp_extract(value, "^[A-Za-z0-9_]+", 0) == "function"
        plain_left = (untyped == "") | untyped.startswith(":")
        return F.when((F.size(sides) == 2) & plain_left & (is_arrow | is_function), found).otherwise("")

    return _named(F.transform(starts, name))


def _only_qualifiers(text: Column) -> Column:
    """Blanks and qualifiers, and a return type after an arrow."""
    sides = F.split(text, "->", 2)
    words = F.filter(F.split(sides[0], r"\s+"), lambda w: w != "")
    kind = F.coalesce(F.get(sides, F.lit(1)), F.lit(""))
    return F.forall(words, lambda w: w.isin(*QUALIFIERS)) & kind.rlike(r"^[A-Za-z0-9_:<>,*&\s]*$")


def _defined_name(statement: Column) -> Column:
    """The first name with a parameter list in the statement before a brace; empty if there is none."""
    opens = F.split(statement, r"\(")

    def head(part: Column, k: Column) -> Column:
        words = F.split(F.rtrim(F.regexp_replace(F.regexp_replace(part, r"\s*::\s*", "::"), r"\s+", " ")), "[ *&]")
        names = F.split(F.element_at(words, -1), "::")
        sound = F.forall(names, lambda n: n.rlike(_NAME)) & ((k == 0) | (F.size(words) > 1))
        return F.struct(F.when(sound, F.element_at(names, -1)).otherwise("").alias("name"), k.alias("k"))

    first = F.get(F.filter(F.transform(_but_last(opens), head), lambda h: h["name"] != ""), F.lit(0))
    inside = F.array_join(F.slice(opens, first["k"] + 2, F.size(opens)), "(")
    closes = F.split(inside, r"\)")
    initial = F.exists(_but_first(closes), lambda p: p.contains(":") & _only_qualifiers(F.split(p, ":", 2)[0]))
    body = (F.size(closes) > 1) & (_only_qualifiers(F.element_at(closes, -1)) | initial)
    return F.when(first.isNotNull() & body, first["name"]).otherwise("")


def defined(text: Column) -> Column:
    """Names of C-family functions and methods with a body, in order."""
    statements = F.transform(_but_last(F.split(text, r"\{")), lambda s: F.element_at(F.split(s, "[;}]"), -1))
    return F.filter(F.transform(statements, _defined_name), lambda n: (n != "") & ~n.isin(*NOT_NAMES))


def declared_symbols(text: Column | str) -> Column:
    """Names declared by keyword, then names of C-family definitions."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.concat(after_keyword(t, DECLARING), defined(t)))


def declared_callables(text: Column | str) -> Column:
    """Names of functions and classes, names bound to functions, then names of C-family definitions."""
    t = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.concat(after_keyword(t, CALLABLE), function_values(t), defined(t)))


def declared_symbol(text: Column | str) -> Column:
    """The first name a snippet declares by keyword; null if none."""
    t = F.col(text) if isinstance(text, str) else text
    return F.get(after_keyword(t, DECLARING), F.lit(0))
