"""Definitions and call sites of source files, from tokens with state over lines and a stack of scopes for each file.

Strings, comments, templates and here-documents are passed over wherever they end; brackets (or indentation, in Python)
say which scope a name stands in. Symbols are functions at the top, classes, and methods under their class's name;
functions within functions are not. Calls carry the nearest symbol around them. What each language tells:

=====================  ==============================================  ==========================
Languages              Symbols                                         Calls
=====================  ==============================================  ==========================
TypeScript, JavaScript functions, names of function values, classes,   by name, of a member, ``new``
                       interfaces, enums, methods
Python                 functions, classes, methods                     by name, of a member
Go, Rust               functions; methods by their own name; structs   by name
                       and enumerations of Rust
Java, C#               classes, interfaces, enums, methods             none
Shell                  functions                                       none
=====================  ==============================================  ==========================

Files come in Arrow batches, one file after another; one that can't be read gives nothing and fails nobody.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from palimpsest.storage import dealt

MOST_DEFINITIONS, MOST_CALLS = 80, 2000
#: Rows after which a task hands on what it has found.
FOUND_ROWS = 50_000
LANGUAGES = {
    "ts": "js", "tsx": "js", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "py": "py", "go": "go", "rs": "rust", "java": "java", "cs": "cs", "sh": "sh", "bash": "sh",
}

_BLOCK_COMMENT, _LINE_COMMENT = r"/\*[\s\S]*?(?:\*/|\Z)", r"//[^\n]*"
_DOUBLE, _SINGLE = r'"(?:\\[\s\S]|[^"\\\n])*"', r"'(?:\\[\s\S]|[^'\\\n])*'"
_LONG_DOUBLE, _LONG_SINGLE = r'"(?:\\[\s\S]|[^"\\])*"', r"'[^']*'"
_RUNE = r"'(?:\\[^'\n]+|[^'\\\n])'"
#: What is passed over, by language; the first that matches counts.
_PASSED = {
    "js": (_BLOCK_COMMENT, _LINE_COMMENT, _DOUBLE, _SINGLE),
    "go": (_BLOCK_COMMENT, _LINE_COMMENT, r"`[^`]*`", _DOUBLE, _RUNE),
    "rust": (_BLOCK_COMMENT, _LINE_COMMENT, r'b?r(?P<fence>#*)"[\s\S]*?"(?P=fence)', _LONG_DOUBLE, _RUNE, r"'\w+"),
    "java": (_BLOCK_COMMENT, _LINE_COMMENT, r'"""[\s\S]*?"""', _DOUBLE, _SINGLE),
    "cs": (_BLOCK_COMMENT, _LINE_COMMENT, r'\$?@\$?"(?:""|[^"])*"', r'"""[\s\S]*?"""', _DOUBLE, _SINGLE),
    "py": (r"#[^\n]*", r'[rRbBuUfFtT]{0,2}"""(?:\\[\s\S]|[^\\])*?"""', r"[rRbBuUfFtT]{0,2}'''(?:\\[\s\S]|[^\\])*?'''", r"[rRbBuUfFtT]{0,2}" + _DOUBLE, r"[rRbBuUfFtT]{0,2}" + _SINGLE, r"\\\r?\n"),
    "sh": (r"(?<![^\s;(])#[^\n]*", r"<<-?\s*(?P<quote>['\"]?)(?P<word>\w+)(?P=quote)[^\n]*\n(?:[\s\S]*?\n)?\s*(?P=word)(?=\n|\Z)", r"\$\{[^}]*\}", _LONG_SINGLE, _LONG_DOUBLE),
}
_NAME = r"[^\W\d][\w$]*|\$[\w$]*"
_SCAN = {
    language: re.compile(rf"(?P<passed>{'|'.join(passed)})|(?P<name>{r'[A-Za-z_][\w.-]*' if language == 'sh' else _NAME})|(?P<other>\d[\w.]*|=>|->|::|\?\.|\S)")
    for language, passed in _PASSED.items()
}
_REGEX = re.compile(r"/(?![*/\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_TYPE_ARGUMENTS = re.compile(r"<[\w\s,.\[\]|&<>'\"]*>(?=\()")
#: After these a slash of JavaScript begins a pattern.
_BEFORE_PATTERN = {"(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "=>", "return", "typeof", "case", "in", "of", "+", "-", "*", "%", "<", ">", "~", "^"}
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_NO_CALL = {
    "js": {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "super", "import", "with", "do", "else", "case", "void", "delete", "in", "of", "instanceof", "throw", "yield", "new", "async"},
    "py": {"if", "elif", "while", "for", "return", "and", "or", "not", "in", "is", "lambda", "yield", "await", "assert", "del", "with", "as", "from", "import", "raise", "except", "else", "match", "case", "global"},
    "go": {"if", "for", "switch", "return", "func", "select", "go", "defer", "case", "range", "map", "chan", "struct", "interface", "type", "var", "const", "import"},
    "rust": {"if", "while", "for", "match", "return", "fn", "loop", "in", "let", "move", "as", "where", "impl", "pub", "unsafe", "mut", "ref", "dyn"},
}
_CLASSES = {
    "js": {"class", "interface", "enum"}, "java": {"class", "interface", "enum"}, "cs": {"class", "interface", "enum"}, "rust": {"struct"}, "go": set(), "sh": set(),
}
_CALLS = {"js", "py", "go", "rust"}
_MEMBERS = {"js", "py"}


@dataclass
class Token:
    text: str
    line: int
    name: bool
    #: column of the first token of a logical line, else -1
    column: int = -1


def scan(text: str, language: str) -> list[Token]:
    """Names and signs of a text. Parts of a template in braces are tokens, the rest of it is passed over."""
    pattern, out, at, line, depth = _SCAN[language], [], 0, 1, 0
    templates: list[int] = []
    fresh, column = True, 0
    while at < len(text):
        c = text[at]
        if c in " \t\r\n\f\v﻿":
            if c == "\n":
                line, fresh, column = line + 1, fresh or not depth, at + 1
            at += 1
            continue
        if language == "js" and (c == "`" or c == "}" and templates and templates[-1] == depth):
            end, opened = _template(text, at + 1)
            if c == "}":
                templates.pop()
                depth -= 1
                out.append(Token(")", line, False))
            line += text.count("\n", at, end)
            if opened:
                depth += 1
                templates.append(depth)
                out.append(Token("(", line, False))
            at = end
            continue
        if language == "js" and c == "/" and (not out or out[-1].text in _BEFORE_PATTERN) and (found := _REGEX.match(text, at)):
            at = found.end()
            continue
        found = pattern.match(text, at)
        if found["passed"] is not None:
            if not found[0].startswith(("//", "/*", "#", "\\")):
                out.append(Token('""', line, False, at - column if fresh and not depth else -1))
                fresh = False
            line += found[0].count("\n")
            at = found.end()
            if "\n" in found[0]:
                column = text.rfind("\n", 0, at) + 1
            continue
        token = Token(found[0], line, found["name"] is not None, at - column if fresh and not depth else -1)
        fresh = False
        if not token.name:
            depth += (token.text in "([{") - (token.text in ")]}") if len(token.text) == 1 else 0
            depth = max(0, depth)
        out.append(token)
        at = found.end()
        if language == "js" and token.name and at < len(text) and text[at] == "<" and (generic := _TYPE_ARGUMENTS.match(text, at)):
            at = generic.end()
    return out


def _template(text: str, at: int) -> tuple[int, bool]:
    """Where a template goes on after its next part in braces begins, or where it ends."""
    while at < len(text):
        if text[at] == "\\":
            at += 2
        elif text[at] == "`":
            return at + 1, False
        elif text.startswith("${", at):
            return at + 2, True
        else:
            at += 1
    return at, False


@dataclass
class Scope:
    """What a bracket, or an indented block, is the body of."""

    sign: str
    cls: str | None = None
    within: str | None = None
    symbol: int | None = None
    column: int = -1


@dataclass
class Found:
    """Symbols as (name, kind, line, last line), and calls as (name, member, line, enclosing); all of them, or the first of a file."""

    whole: bool = False
    symbols: list[list] = field(default_factory=list)
    calls: list[tuple] = field(default_factory=list)

    def record(self, name: str, kind: str, line: int) -> int | None:
        if not self.whole and len(self.symbols) >= MOST_DEFINITIONS:
            return None
        self.symbols.append([name, kind, line, line])
        return len(self.symbols) - 1

    def call(self, tokens: list[Token], i: int, language: str, within: str | None) -> None:
        token, before = tokens[i], tokens[i - 1].text if i else ""
        member = before in (".", "?.")
        if language not in _CALLS or i + 1 >= len(tokens) or tokens[i + 1].text != "(":
            return
        if before in ("function", "def", "fn", "func", "class", "::") or before == "*" and i > 1 and tokens[i - 2].text == "function":
            return
        if token.text in _NO_CALL[language] and not member or member and language not in _MEMBERS or not self.whole and len(self.calls) >= MOST_CALLS:
            return
        self.calls.append((token.text, member, token.line, within))


def _closing(tokens: list[Token], i: int) -> int:
    """The place of the bracket that closes the one at i, or the end."""
    depth = 0
    for j in range(i, len(tokens)):
        if tokens[j].text in _CLOSE:
            depth += 1
        elif tokens[j].text in (")", "]", "}"):
            depth -= 1
            if not depth:
                return j
    return len(tokens)


def _body(tokens: list[Token], i: int, stop: tuple[str, ...] = (";",)) -> int | None:
    """The brace that opens a body, from i on, before a sign that ends the statement; brackets on the way are passed over."""
    while i < len(tokens):
        text = tokens[i].text
        if text == "{":
            return i
        if text in stop or text in (")", "]", "}"):
            return None
        i = _closing(tokens, i) + 1 if text in ("(", "[") else i + 1
    return None


def _arrow(tokens: list[Token], i: int) -> int | None:
    """Where the body of a function value begins that may start at i: a function, or parameters and an arrow."""
    if i < len(tokens) and tokens[i].text == "async":
        i += 1
    if i >= len(tokens):
        return None
    if tokens[i].text == "function":
        return _body(tokens, i + 1)
    j = _closing(tokens, i) + 1 if tokens[i].text == "(" else i + 1 if tokens[i].name else None
    if j is None:
        return None
    if tokens[i].text == "(" and j < len(tokens) and tokens[j].text == ":":
        # a type stands between parameters and arrow
        while j < len(tokens) and tokens[j].text not in ("=>", ";", "=", "}"):
            j = _closing(tokens, j) + 1 if tokens[j].text in _CLOSE else j + 1
    return j + 1 if j < len(tokens) and tokens[j].text == "=>" else None


def braces(tokens: list[Token], language: str, whole: bool = False) -> Found:
    """Scopes by brackets."""
    found, stack = Found(whole), [Scope("")]
    opens: dict[int, Scope] = {}
    receivers: set[int] = set()  # names of methods that stand after a receiver
    ends: list[tuple[int, int, Scope]] = []  # values without braces: (depth, symbol, what was around)
    for i, token in enumerate(tokens):
        text, top = token.text, stack[-1]
        while ends and ends[-1][0] == len(stack) and (text in (";", ",", ")", "]", "}") or _new_statement(tokens, i)):
            stack[-1] = ends.pop()[2]
            top = stack[-1]
        if text in _CLOSE:
            scope = opens.pop(i, None) or Scope(text, None, top.within)
            scope.sign = text
            stack.append(scope)
            continue
        if text in (")", "]", "}"):
            if len(stack) > 1:
                scope = stack.pop()
                if scope.symbol is not None:
                    found.symbols[scope.symbol][3] = token.line
            continue
        if not token.name or i in receivers:
            continue
        after = tokens[i + 1].text if i + 1 < len(tokens) else ""
        before = tokens[i - 1].text if i else ""
        in_class = top.cls is not None and top.sign == "{"

        def inside(at: int | None, name: str, kind: str, line: int, cls: str | None = None, *, record: bool = True, around: Scope = top) -> None:
            number = found.record(name, kind, line) if record else None
            within = name if number is not None and kind != "class" else around.within
            if at is not None and at < len(tokens) and tokens[at].text == "{":
                opens[at] = Scope("{", cls, within, number)
            elif at is not None and kind != "class":
                ends.append((len(stack), number if number is not None else -1, around))
                stack[-1] = Scope(around.sign, around.cls, within)

        if text in _CLASSES[language] and before != "." and i + 1 < len(tokens) and tokens[i + 1].name and after not in ("extends", "implements"):
            at = _body(tokens, i + 2)
            if at is not None or language in ("rust", "cs"):
                inside(at, tokens[i + 1].text, "class", token.line, tokens[i + 1].text if language != "rust" else None, record=top.within is None)
        elif language == "js" and text == "function" and after and before != "=":
            j = i + 1 + (after == "*")
            if j < len(tokens) and tokens[j].name and before not in ("(", ",", ":", "return", "=>"):
                nested = top.within is not None and not in_class
                inside(_body(tokens, j + 1), tokens[j].text, "function", token.line, record=not nested)
        elif language == "js" and text in ("const", "let", "var") and i + 2 < len(tokens) and tokens[i + 1].name:
            _values(tokens, i + 1, top, inside)
        elif language == "go" and text == "func" and before != "=":
            j = i + 1
            method = after == "("
            j = _closing(tokens, j) + 1 if method else j
            if tokens[j:] and tokens[j].name and tokens[j + 1 :] and tokens[j + 1].text in ("(", "["):
                receivers.add(j)
                inside(_body(tokens, j + 1, ()), tokens[j].text, "method" if method else "function", token.line, record=method or top.within is None)
        elif language == "rust" and text == "fn" and i + 1 < len(tokens) and tokens[i + 1].name:
            at = _body(tokens, i + 2)
            if at is not None:
                inside(at, tokens[i + 1].text, "function", token.line)
        elif language == "sh" and (text == "function" and i + 1 < len(tokens) and tokens[i + 1].name or after == "(" and i + 2 < len(tokens) and tokens[i + 2].text == ")"):
            name = tokens[i + 1] if text == "function" else token
            if before != "function":
                inside(_body(tokens, i + 1), name.text, "function", token.line, record=top.within is None)
        elif in_class and after == "(" and language in ("js", "java", "cs") and before not in (".", "=", "new", "(", "@", "?."):
            _member(tokens, i, language, top, inside)
        else:
            found.call(tokens, i, language, top.within)
    return found


def _new_statement(tokens: list[Token], i: int) -> bool:
    """Whether a value without braces has ended before this token: it begins a line, and what stood before needs nothing more."""
    if not i or tokens[i].line == tokens[i - 1].line:
        return False
    return tokens[i].name and (tokens[i - 1].name or tokens[i - 1].text in (")", "]", "}", '""') or tokens[i - 1].text[0].isdigit())


def _values(tokens: list[Token], i: int, top: Scope, inside) -> None:
    """``name = function`` after const, let or var; a type may stand between."""
    j = i + 1
    if tokens[j].text == ":":
        while j < len(tokens) and tokens[j].text not in ("=", ";"):
            j = _closing(tokens, j) + 1 if tokens[j].text in _CLOSE else j + 1
    if j < len(tokens) and tokens[j].text == "=" and top.within is None:
        body = _arrow(tokens, j + 1)
        if body is not None:
            inside(body, tokens[i].text, "function", tokens[i].line)


def _member(tokens: list[Token], i: int, language: str, top: Scope, inside) -> None:
    """A method at the top of a class's body: parameters and a body, or in Java and C# a declaration after a type."""
    j = _closing(tokens, i + 1) + 1
    at = _body(tokens, j, (";", "=")) if j < len(tokens) else None
    typed = language != "js" and (tokens[i - 1].name or tokens[i - 1].text in (">", "]")) and tokens[i - 1].text not in ("return", "throw")
    if at is not None or typed:
        inside(at, f"{top.cls}.{tokens[i].text}", "method", tokens[i].line)


def indented(tokens: list[Token], whole: bool = False) -> Found:
    """Scopes by indentation: a block holds the logical lines that begin further right than its head."""
    found, stack = Found(whole), [Scope("", column=-1)]
    last = 1
    for i, token in enumerate(tokens):
        if token.column >= 0:
            while len(stack) > 1 and token.column <= stack[-1].column:
                scope = stack.pop()
                if scope.symbol is not None:
                    found.symbols[scope.symbol][3] = last
        last = token.line
        top = stack[-1]
        named = token.text in ("def", "class") and token.name and i + 1 < len(tokens) and tokens[i + 1].name
        if named and (token.column >= 0 or tokens[i - 1].text == "async"):
            name, column = tokens[i + 1].text, token.column if token.column >= 0 else tokens[i - 1].column
            if token.text == "class":
                number = found.record(name, "class", token.line) if top.within is None else None
                stack.append(Scope("", name, top.within, number, column))
            else:
                number = None
                if top.cls is not None:
                    number = found.record(f"{top.cls}.{name}", "method", token.line)
                elif top.within is None:
                    number = found.record(name, "function", token.line)
                stack.append(Scope("", None, found.symbols[number][0] if number is not None else top.within, number, column))
        elif token.name:
            found.call(tokens, i, "py", top.within)
    for scope in stack:
        if scope.symbol is not None:
            found.symbols[scope.symbol][3] = last
    return found


def parsed(path: str, text: str | None, whole: bool = False) -> Found:
    """The symbols and calls of one file; none where its language is not known or it can't be read."""
    language = LANGUAGES.get(path.rpartition(".")[2].lower())
    if language is None or not text:
        return Found()
    try:
        tokens = scan(text, language)
        return indented(tokens, whole) if language == "py" else braces(tokens, language, whole)
    except (ValueError, IndexError, RecursionError):
        return Found()


def _each(files: DataFrame, what: str, columns: dict[str, str], whole: bool) -> DataFrame:
    """A row for each symbol or call of files (id, text)."""
    names = ["id", *columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for i, text in zip(batch["id"], batch["text"], strict=True):
                rows += [(i, *found) for found in getattr(parsed(str(i), text, whole), what)]
                if len(rows) >= FOUND_ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return dealt(files).mapInPandas(run, ", ".join(["id string", *(f"{name} {kind}" for name, kind in columns.items())]))


def definitions(files: DataFrame, *, whole: bool = False) -> DataFrame:
    """(id, name, kind, line, last_line) of what files (id, text) define, the first 80 of each or all."""
    return _each(files, "symbols", {"name": "string", "kind": "string", "line": "int", "last_line": "int"}, whole)


def call_sites(files: DataFrame, *, whole: bool = False) -> DataFrame:
    """(id, name, member, line, enclosing): calls and constructions by name, the first 2000 of a file, within its first 80 symbols, or all."""
    return _each(files, "calls", {"name": "string", "member": "boolean", "line": "int", "enclosing": "string"}, whole)
