"""Declarations and comments of TypeScript and JavaScript texts, by one lexing pass and a scan over lines."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

# One pass over a text: comments, strings, templates and regular expressions, so that what
# is inside them is never taken for code. A regular expression only stands where a value may.
_TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
    r"|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
    r"|(?P<template>`)"
    r"|(?P<regex>(?:(?<=[=(,:;!&|?\[{}>+~\n])|(?<=[=(,:;!&|?\[{}>+~] )|(?<=return )|(?<=case ))/(?![/*\s])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)",
    re.S,
)
_TEMPLATE_STEP = re.compile(r"\\.|`|\$\{", re.S)
_CODE_STEP = re.compile(r"[{}`]|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|//[^\n]*|/\*.*?\*/", re.S)
_NOT_NEWLINE = re.compile(r"[^\n]")
_BRACKET = re.compile(r"[(){}\[\]]")

_NAME = r"[A-Za-z_$\u00c0-\uffff][\w$]*"
_FUNCTION = re.compile(rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{_NAME})\s*[<(]")
_VARIABLE = re.compile(rf"(?P<export>export\s+)?(?:declare\s+)?(?P<form>const|let|var)\s+(?P<name>{_NAME})\s*(?P<rest>[:=])")
_OTHER = re.compile(rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:const\s+)?(?P<kind>interface|enum|type)\s+(?P<name>{_NAME})\s*(?:[{{<=]|extends\b|$)")
_CLASS = re.compile(rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+(?P<name>{_NAME})")
_MODIFIER = re.compile(r"(?:(?:public|private|protected|static|abstract|override|readonly|async|declare)\s+)*")
_METHOD = re.compile(rf"\*?\s*(?P<name>\#?{_NAME}|\[[^\]\n]+\]|\"[^\"\n]*\"|'[^'\n]*')\s*[?!]?\s*(?P<open>[<(])")
_ACCESSOR = re.compile(rf"(?:get|set)\s+(?:\#?{_NAME}|\[)")
_VALUE = re.compile(rf"(?:async\s+)?(?:function\b|<[^=]|\(|{_NAME}\s*=>)")
_NO_METHOD = {"if", "for", "while", "switch", "catch", "return", "function", "constructor", "new", "throw", "typeof", "await", "super", "import", "with", "do", "else", "delete", "void", "yield"}


def _template_end(text: str, at: int) -> int:
    """End of the template that opens before `at`; its slots may hold code and templates again."""
    depth = 0  # open braces of the slot around
    while True:
        m = (_CODE_STEP if depth else _TEMPLATE_STEP).search(text, at)
        if m is None:
            return len(text)
        at, c = m.end(), m.group()
        if depth:
            if c == "`":
                at = _template_end(text, at)
            else:
                depth += {"{": 1, "}": -1}.get(c, 0)
        elif c == "`":
            return at
        elif c == "${":
            depth = 1


def blanked(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with comments and literals blanked (same length, same lines), and the spans of the comments."""
    parts, comments, at = [], [], 0
    search = _TOKEN.search
    while (m := search(text, at)) is not None:
        start, end, kind = m.start(), m.end(), m.lastgroup
        parts.append(text[at:start])
        if kind == "template":
            end = _template_end(text, end)
        elif kind == "comment":
            comments.append((start, end))
        body = text[start:end]
        fill = " " if kind == "comment" else "0"
        filled = fill * (end - start) if "\n" not in body else _NOT_NEWLINE.sub(fill, body)
        parts.append(filled.replace("0\n", "+\n"))  # a literal that goes on is no end of a statement
        at = end
    parts.append(text[at:])
    return "".join(parts), comments


def comment_runs(text: str, code: str, comments: list[tuple[int, int]], line_starts: list[int]) -> list[tuple[int, int, str]]:
    """Runs of comments that stand alone on adjacent lines: (first line, last line, text)."""
    runs: list[tuple[int, int, str]] = []
    for start, end in comments:
        first = bisect_right(line_starts, start) - 1
        last = bisect_right(line_starts, max(start, end - 1)) - 1
        after = code.find("\n", end)
        after = len(code) if after < 0 else after
        if code[line_starts[first] : start].strip() or code[end:after].strip():
            continue
        body = text[start:end]
        if runs and runs[-1][1] >= first - 1:
            runs[-1] = (runs[-1][0], last, runs[-1][2] + "\n" + body)
        else:
            runs.append((first, last, body))
    return runs


class Declaration(NamedTuple):
    """A named declaration at the top of a text, or a method of a class there; lines count from 0, `form` is the keyword of a variable."""

    name: str
    kind: str
    form: str
    first: int
    last: int


def declarations(code: str) -> list[Declaration]:
    """Top-level functions, classes, interfaces, types, enums and variables, and the methods of classes, in order.

    `code` is blanked. A variable whose value is a function has kind `function`; of the others
    only exported ones are declarations. A method is named `Class.method`; constructors and
    accessors are left out. Only the first declaration of a name and kind counts; decorators
    belong to it.
    """
    lines = code.split("\n")
    found: dict[tuple[str, str], list] = {}
    depth, owner, owner_depth, decorator, statement = 0, None, 0, None, True
    current = owner_key = None

    def declare(name: str, kind: str, number: int, form: str = ""):
        key = (name, kind)
        if key not in found:
            found[key] = [form, decorator if decorator is not None else number, number]
        return key

    for number, line in enumerate(lines):
        body = line.strip()
        if not body:
            continue
        begins = statement and depth in (0, owner_depth if owner else 0) and not _GOES_BACK.match(body)
        here, opened, made = depth, None, None
        if begins:
            if body[0] == "@" and (depth == 0 or owner):
                decorator = number if decorator is None else decorator
            elif depth == 0:
                if m := _FUNCTION.match(body):
                    made = declare(m["name"], "function", number)
                elif m := _CLASS.match(body):
                    opened = m["name"]
                    owner_key = declare(opened, "class", number)
                elif m := _OTHER.match(body):
                    made = declare(m["name"], m["kind"], number)
                elif m := _VARIABLE.match(body):
                    if _has_function_value(lines, number, line.index(body) + m.start("rest")):
                        made = declare(m["name"], "function", number, m["form"])
                    elif m["export"]:
                        made = declare(m["name"], "const", number, m["form"])
            elif owner:
                rest = body[_MODIFIER.match(body).end() :]
                if not _ACCESSOR.match(rest) and (m := _METHOD.match(rest)) and m["name"] not in _NO_METHOD:
                    made = declare(f"{owner}.{m['name']}", "method", number)
            current = made
        closes = False
        for b in _BRACKET.findall(body):
            depth += 1 if b in "({[" else -1
            if owner and depth < owner_depth:
                closes = True
        depth = max(depth, 0)
        if opened:
            owner, owner_depth = opened, here + 1
            closes = "{" in body and depth == 0
        if current is not None:
            found[current][2] = max(found[current][2], number)
            if depth <= (owner_depth if current[1] == "method" and owner else 0) and body[-1] in "};)":
                current = None
        if owner_key is not None and owner:
            found[owner_key][2] = max(found[owner_key][2], number)
        if begins and body[0] != "@":
            decorator = None
        if closes and depth == 0:
            owner = owner_key = None
        # A statement ends where the depth is that of the top or of the class, unless the line goes on.
        level = depth == 0 or (owner is not None and depth == owner_depth)
        statement = level and (body[-1] in ";{}" or body[0] == "@" or _GOES_ON.search(body) is None)
        if owner is not None and depth == owner_depth and body[-1] == "{":
            statement = True
    return [Declaration(name, kind, form, first, last) for (name, kind), (form, first, last) in found.items()]


_GOES_BACK = re.compile(r"[.?:|&+)\]=,]|\*[^\s\w]|-|&&|extends\b|implements\b")
_GOES_ON = re.compile(r"(?:[=,:?&|+\-*<>.]|=>|\b(?:extends|implements|async|function|const|export|default))$")


_DECLARES = re.compile(r"(?:export|import|declare|const|let|var|function|class|interface|type|enum|namespace|abstract)\b|@")


def _has_function_value(lines: list[str], number: int, at: int) -> bool:
    """Whether the constant's value (after its type, over some lines) is a function, not a call of one."""
    rest = lines[number][at:]
    depth, line = 0, number
    if rest[0] == ":":  # skip the type, to the = that is not part of =>
        k = 1
        while True:
            if k >= len(rest):
                line += 1
                if line >= len(lines) or (depth <= 0 and _DECLARES.match(lines[line].strip())):
                    return False
                rest, k = lines[line], 0
                continue
            c = rest[k]
            if c in "({[":
                depth += 1
            elif c in ")}]":
                depth -= 1
            elif c == "=" and depth <= 0 and rest[k + 1 : k + 2] != ">":
                break
            elif c == ";" and depth <= 0:
                return False
            k += 1
        rest = rest[k:]
    value = rest[1:].strip()
    while not value:
        line += 1
        if line >= len(lines):
            return False
        value = lines[line].strip()
    m = _VALUE.match(value)
    if m is None:
        return False
    if "function" in m.group() or m.group().endswith("=>"):
        return True
    return _is_arrow(lines, line, value)


def _is_arrow(lines: list[str], line: int, text: str) -> bool:
    """Whether parentheses from `text` on are parameters: => follows (perhaps after a type); anything else is an expression."""
    depth, begun, closed, typed = 0, False, False, False
    while True:
        for j, c in enumerate(text):
            if not begun:  # type parameters
                if c == "(" and depth == 0:
                    begun, depth = True, 1
                elif c == ";" and depth == 0:
                    return False
                else:
                    depth += (c in "{[") - (c in "}]")
            elif not closed:
                depth += (c == "(") - (c == ")")
                closed = depth == 0
            elif not typed:
                if c == ":":
                    typed = True
                elif not c.isspace():
                    return text.startswith("=>", j)
            elif depth == 0 and text.startswith("=>", j):
                return True
            elif c in "({[":
                depth += 1
            elif c in ")}]":
                depth -= 1
                if depth < 0:
                    return False
            elif c == ";" and depth == 0:
                return False
        line += 1
        if line >= len(lines):
            return False
        text = lines[line]


def line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


class Symbol(NamedTuple):
    """A declaration with its documentation; lines count from 1 and take in the `/** */` comments right before it."""

    name: str
    kind: str
    start_line: int
    end_line: int
    doc: str | None
    signature: str
    body: str


_EDGE = re.compile(r"^[ \t]*(?:/\*+|\*+/|\*|//+)?[ \t]?|[ \t]*\*+/[ \t]*$")
_EMPTY_LINE = re.compile(r"[ \t]*\n[ \t]*\n")
SIGNATURE_CHARS = 140


def _description(comment: str) -> str:
    """The text of a comment up to its first tag, without the marks around it."""
    lines = [_EDGE.sub("", _EDGE.sub("", line)).strip() for line in comment.split("\n")]
    tag = next((i for i, line in enumerate(lines) if line.startswith("@")), len(lines))
    return "\n".join(lines[:tag]).strip()


def symbols_of(text: str | None) -> list[Symbol]:
    """The symbols of a text, with line ends of either kind: what an index keeps of a source file. Null and empty texts have none."""
    if not text:
        return []
    text = text.replace("\r\n", "\n")
    code, comments = blanked(text)
    starts = line_starts(text)
    lines, code_lines = text.split("\n"), code.split("\n")
    ends = [end for _, end in comments]
    found = []
    for d in declarations(code):
        at = starts[d.first] + len(code_lines[d.first]) - len(code_lines[d.first].lstrip())
        # The comments between the code before and the declaration.
        leading, k = [], bisect_right(ends, starts[d.first] + len(lines[d.first])) - 1
        begin = at
        while k >= 0 and not code[comments[k][1] : begin].strip():
            if comments[k][1] <= at:
                leading.insert(0, comments[k])
                begin = comments[k][0]
            k -= 1
        # A comment that opens the text, with an empty line after it, is the file's own.
        if leading and not text[: leading[0][0]].strip() and _EMPTY_LINE.match(text, leading[0][1]):
            leading = leading[1:]
        blocks = [c for c in leading if text.startswith("/**", c[0])]
        first = bisect_right(starts, blocks[0][0]) - 1 if blocks else d.first
        body = "\n".join(lines[d.first : d.last + 1]).strip()
        doc = "\n".join(filter(None, (_description(text[a:b]) for a, b in blocks or leading)))
        found.append(Symbol(d.name, d.kind, first + 1, d.last + 1, doc or None, body.split("\n", 1)[0].strip()[:SIGNATURE_CHARS], body))
    return found
