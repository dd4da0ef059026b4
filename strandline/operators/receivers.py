"""Where functions and classes of brace languages stand in a text, and what type a call's receiver has.

A text comes with its comments blanked.  Parentheses and braces are paired once; a function is a name with
a parameter list that is followed by a body.  Types of receivers come from parameters, declarations,
constructors and factories of the function around a call; names that are bound to an object literal of the
file have its members.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

#: Words before a parenthesis that name no function, in every language and in some.
KEYWORDS = {"if", "for", "while", "switch", "return", "catch", "sizeof", "new", "delete", "throw", "class", "else", "do"}
OWN_KEYWORDS = {
    "go": {"go", "defer", "func"}, "rust": {"fn", "match"},
    **dict.fromkeys(("javascript", "typescript", "tsx"), {"function", "await", "async", "typeof", "super", "import"}),
}


def reserved(language: str) -> set[str]:
    return KEYWORDS | OWN_KEYWORDS.get(language, set())


#: Wrappers whose ``->`` reaches the wrapped type.
SMART = ("unique_ptr", "shared_ptr", "weak_ptr", "optional")
_NAMED_LIST = re.compile(r"([A-Za-z_$~][\w$]*)\s*\(")
_CLASS = re.compile(r"\b(class|struct|interface|trait)\s+([A-Za-z_]\w*)([^{};\n]*(?:\n[^{};\n]*)?)\{")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_SCRIPT = ("javascript", "typescript", "tsx")
#: What stands before a function's name where a word must.
_MARKED = {"go": r"\bfunc$|\bfunc\s*\([^()]*\)$", "rust": r"\bfn$"}
_C_FAMILY = ("c", "cpp", "hlsl", "glsl", "metal")


def pairs(text: str) -> dict[int, int]:
    """The place of the closing sign of each opening brace or parenthesis; strings are skipped."""
    out: dict[int, int] = {}
    held: list[int] = []
    k, closing = 0, {")": "(", "}": "{"}
    while k < len(text):
        c = text[k]
        if c in "\"'`":
            end = k + 1
            while end < len(text) and text[end] != c and (c == "`" or text[end] != "\n"):
                end += 2 if text[end] == "\\" else 1
            k = end
        elif c in "({":
            held.append(k)
        elif c in closing:
            # A sign that closes nothing of its kind is left out.
            at = next((n for n in range(len(held) - 1, max(len(held) - 9, -1), -1) if text[held[n]] == closing[c]), None)
            if at is not None:
                out[held[at]] = k
                del held[at:]
        k += 1
    return out


@dataclass
class Function:
    name: str
    at: int  # of the name
    start: int
    end: int
    params: str
    owner: str | None = None
    result: str | None = None


@dataclass
class Layout:
    """Functions, classes and object literals of a text."""

    text: str
    language: str
    functions: list[Function] = field(default_factory=list)
    classes: list[tuple[int, int, str, str, str]] = field(default_factory=list)  # start, end, kind, name, clause
    literals: dict[str, set[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.pair = pairs(self.text)
        for m in _CLASS.finditer(self.text):
            self.classes.append((m.end() - 1, self.pair.get(m.end() - 1, len(self.text)), m.group(1), m.group(2), m.group(3)))
        for m in re.finditer(r"^type\s+(\w+)\s+interface\s*\{", self.text, re.M) if self.language == "go" else ():
            self.classes.append((m.end() - 1, self.pair.get(m.end() - 1, len(self.text)), "interface", m.group(1), ""))
        for m in _NAMED_LIST.finditer(self.text):
            self._function(m)
        if self.language in _SCRIPT:
            self._script()
        self.functions.sort(key=lambda f: f.start)
        self.starts = [f.start for f in self.functions]
        self.names = {f.at for f in self.functions}

    def _function(self, m: re.Match[str]) -> None:
        name, opened = m.group(1), m.end() - 1
        if name in reserved(self.language) or opened not in self.pair:
            return
        closed = self.pair[opened]
        brace = self.text.find("{", closed)
        if brace < 0 or brace not in self.pair:
            return
        between = self.text[closed + 1 : brace]
        if ";" in between or "}" in between or "=" in between.replace("=>", "") or between.count(")") != between.count("("):
            return
        if re.search(r"&&|\|\||[?!+]|\b(?:and|or)\b", between) or (self.language != "go" and "(" in between and ":" not in between):
            return
        before = self.text[:  m.start()].rstrip()
        if before.endswith((".", ",", "(", "->")) or re.search(r"\b(?:new|return|await|throw|else)$", before):
            return
        if self.language in _MARKED and not re.search(_MARKED[self.language], before):
            return
        owner = re.search(r"([A-Za-z_]\w*)\s*(?:<[^<>]*>)?\s*::$", before)
        go = re.search(r"\bfunc\s*\(\s*(?:\w+\s+)?\*?\s*(\w+)[^()]*\)$", before) if self.language == "go" else None
        who = (go or owner).group(1) if go or owner else next((c[3] for c in reversed(self.classes) if c[0] < m.start() < c[1]), None)
        line = before[before.rfind("\n") + 1 :]
        result = between if self.language in ("go", *_SCRIPT) else line[: owner.start() - len(before) + len(line)] if owner else line
        params = self.text[opened + 1 : closed]
        if go:
            params += ", " + before[before.rfind("(") + 1 : -1]
        self.functions.append(Function(name, m.start(1), brace, self.pair[brace], params, who, _type_name(result, self.language)))

    def _script(self) -> None:
        for m in re.finditer(r"\b(?:const|let|var)\s+([\w$]+)\s*(?::[^=;{}]*)?=\s*", self.text):
            at = m.end()
            if at < len(self.text) and self.text[at] == "{" and at in self.pair:
                self.literals[m.group(1)] = self._members(at)
                continue
            arrow = re.compile(r"(?:async\s+)?(?:\(|[\w$]+\s*=>)").match(self.text, at)
            if not arrow:
                continue
            opened = arrow.end() - 1
            closed = self.pair.get(opened, opened) if self.text[opened] == "(" else opened
            body = re.compile(r"[^;{}]*?=>\s*\{|\s*\{").match(self.text, closed + 1)
            if body and body.end() - 1 in self.pair:
                self.functions.append(Function(m.group(1), m.start(1), body.end() - 1, self.pair[body.end() - 1], self.text[opened + 1 : closed]))

    def _members(self, opened: int) -> set[str]:
        """Functions among the direct members of an object literal."""
        out, k, end = set(), opened + 1, self.pair[opened]
        start = k
        while k <= end:
            if k == end or self.text[k] == ",":
                part = self.text[start:k].strip()
                m = re.match(r"(?:async\s+)?([A-Za-z_$][\w$]*)\s*(?:\(|:\s*(?:async\s*)?(?:function\b|\(|[\w$]+\s*=>))", part)
                if m:
                    out.add(m.group(1))
                start = k + 1
            k = self.pair.get(k, k) + 1 if self.text[k : k + 1] in "({" and k in self.pair else k + 1
        return out

    def around(self, at: int) -> Function | None:
        """The innermost function whose body holds a place."""
        k = bisect_right(self.starts, at) - 1
        while k >= 0 and self.functions[k].end < at:
            k -= 1
        return self.functions[k] if k >= 0 else None

    def declares(self, m: re.Match[str]) -> bool:
        """Whether a name with a parameter list is a declaration: a member without a body, or a C variable with its arguments."""
        statement = self.text[max(self.text.rfind(c, 0, m.start()) for c in ";{}") + 1 : m.start()]
        if self.around(m.start()) is None and self.class_at(m.start()) and "=" not in statement:
            return True
        word = re.search(r"([A-Za-z_]\w*)\s+$", statement) if self.language in _C_FAMILY else None
        return bool(word) and word.group(1) not in ("return", "else", "throw", "new", "delete", "case", "do", "co_return", "co_await", "co_yield", "and", "or", "not")

    def class_at(self, at: int) -> str | None:
        return next((c[3] for c in reversed(self.classes) if c[0] < at < c[1]), None)

    def bindings(self, f: Function) -> dict[str, tuple[str, bool]]:
        """What names of a function stand for: (type, False) or (factory, True)."""
        kept = self.__dict__.setdefault("_bindings", {})
        if f.start not in kept:
            kept[f.start] = _bindings(self.language, f.params, self.text[f.start : f.end])
        return kept[f.start]


def _type_name(text: str | None, language: str) -> str | None:
    """The plain name of a written type: wrappers, packages and marks removed; null for several or none."""
    if not text:
        return None
    inner = re.search(rf"\b(?:{'|'.join(SMART)}|Promise)\s*<\s*(?:const\s+)?([\w:.]+)", text)
    if inner:
        return re.split(r"::|\.", inner.group(1))[-1]
    bare = re.sub(r"<[^<>]*>|\b(?:const|static|inline|virtual|export|async|public|private|protected|readonly|explicit|constexpr)\b|[*&:]", " ", text.replace("::", "."))
    words = re.findall(r"[A-Za-z_][\w.]*", bare)
    if language == "go" and len(words) > 1:
        words = [w for w in words if w != "error"][:1] if "error" in words else []
    return words[-1].split(".")[-1] if len(words) == 1 else None


def _bindings(language: str, params: str, body: str) -> dict[str, tuple[str, bool]]:
    out: dict[str, tuple[str, bool]] = {}

    def put(name: str, kind: str | None, factory: bool = False) -> None:
        if kind:
            out.setdefault(name, (re.split(r"::|\.", kind)[-1], factory))

    if language == "go":
        waiting: list[str] = []
        for part in params.split(","):
            words = re.findall(r"[\w.]+", part)
            if len(words) == 2:
                for name in [*waiting, words[0]]:
                    put(name, words[1])
                waiting = []
            elif len(words) == 1:
                waiting.append(words[0])
        for name, kind in re.findall(r"\bvar\s+(\w+)\s+\*?([\w.]+)", body):
            put(name, kind)
        for name, kind, end in re.findall(r"\b(\w+)\s*:=\s*&?((?:\w+\.)?\w+)\s*([({])", body):
            if kind != "new":
                put(name, kind, end == "(")
        for name, kind in re.findall(r"\b(\w+)\s*:=\s*new\(([\w.]+)\)", body):
            put(name, kind)
    elif language in _SCRIPT:
        for name, kind in re.findall(r"([\w$]+)\s*\??\s*:\s*([A-Z][\w$]*)", params):
            put(name, kind)
        for name, kind, made, made_by in re.findall(r"\b(?:const|let|var)\s+([\w$]+)\s*(?::\s*([A-Z][\w$]*)[^=;]*)?=\s*(?:new\s+([\w$.]+)|(?:await\s+)?([\w$]+)\s*\()?", body):
            put(name, kind or made)
            if made_by:
                put(name, made_by, True)
    elif language in _C_FAMILY:
        for part in params.split(","):
            m = re.match(r"\s*(.*?[\w>*&\s])\b([A-Za-z_]\w*)\s*(?:=.*)?$", part, re.S)
            if m:
                put(m.group(2), _type_name(m.group(1), language))
        for kind, name, value in re.findall(r"(?:^|[;{}(])\s*((?:const\s+)?[A-Za-z_][\w:]*(?:<[^;<>()]*>)?)\s*[*&]*\s+[*&]*([A-Za-z_]\w*)\s*(?=[;=({])((?:=[^;]*)?)", body):
            if kind.split()[-1] == "auto":
                made = re.match(r"=\s*(?:new\s+([\w:]+)|(?:std::)?make_(?:unique|shared)<\s*([\w:]+)|(?:[\w:]*::)?(\w+)\s*\()", value)
                if made:
                    put(name, made.group(1) or made.group(2) or made.group(3), made.group(3) is not None)
            elif kind not in KEYWORDS and kind not in ("using", "case"):
                put(name, _type_name(kind, language))
    return out
