"""Tokens of TypeScript and JavaScript source, and the imports among them.

A hand-written scanner that knows comments, strings, templates with nested
expressions, regular expressions and JSX, so that text which only looks like
an import is not taken for one. It never fails: on bad source it goes on with
the next character.
"""

from __future__ import annotations

import re
from collections.abc import Generator
from typing import Any, NamedTuple


class Token(NamedTuple):
    kind: str  # name, string, template, number, regex, text, mark
    text: str
    line: int


class Import(NamedTuple):
    source: str
    specifiers: list[str]
    type: str
    line: int


_NAME = re.compile(r"[#@]?[\w$‌‍]+", re.UNICODE)
#: What opens a tag, what looks like one and opens type parameters, and what closes a tag; white space may be of any length.
_TAG = re.compile(r"<\s*+[A-Za-z_$>]")
_GENERIC = re.compile(r"<\s*+[\w$]++\s*+(?:,|extends\b|=)")
_CLOSING_TAG = re.compile(r"<\s*+/")
_NUMBER = re.compile(r"(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?)n?")
_MARKS = sorted(">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << >> **".split(), key=len, reverse=True)
_MARK = re.compile("|".join(map(re.escape, _MARKS)))
#: What needs no look at what stands before: white space, plain names, marks that begin no longer one.
_PLAIN = re.compile(r"(?P<space>\s++)|(?P<name>[A-Za-z_$][\w$‌‍]*+)|(?P<mark>[(),;\[\]{}])", re.UNICODE)
#: A string but its first quote, up to its last one, the line's end or the text's.
_INSIDE = {quote: re.compile(rf"(?:[^{quote}\\\n]|\\.)*+", re.DOTALL) for quote in "\"'"}
_BEFORE_EXPRESSION = frozenset("return typeof case in of delete void throw new else do instanceof await yield default extends".split())
_AFTER_VALUE = frozenset([")", "]", "}", "++", "--"])


#: A routine of the scanner: it yields routines to run first, whose results it gets, so that nesting needs no recursion.
Steps = Generator["Steps", Any, Any]


class Scanner:
    def __init__(self, source: str, language: str):
        self.s, self.jsx = source, language != "typescript"
        self.at, self.line, self.out = 0, 1, []

    def _to(self, end: int) -> str:
        text = self.s[self.at : end]
        self.line += text.count("\n")
        self.at = end
        return text

    def _add(self, kind: str, end: int) -> None:
        line = self.line
        self.out.append(Token(kind, self._to(end), line))

    def _expression_may_start(self) -> bool:
        if not self.out:
            return True
        last = self.out[-1]
        if last.kind == "mark":
            return last.text not in _AFTER_VALUE
        return last.kind == "name" and last.text in _BEFORE_EXPRESSION

    def _string_end(self, quote: str) -> int:
        end = _INSIDE[quote].match(self.s, self.at + 1).end()
        if self.s.startswith(quote, end):
            return end + 1
        # a backslash that nothing follows is the last character
        return end if self.s.startswith("\n", end) else len(self.s)

    def _regex_end(self) -> int:
        i, inside = self.at + 1, False
        while i < len(self.s):
            c = self.s[i]
            if c == "\n":
                return -1
            if c == "\\":
                i += 1
            elif c == "[":
                inside = True
            elif c == "]":
                inside = False
            elif c == "/" and not inside:
                i += 1
                while i < len(self.s) and (self.s[i].isalnum() or self.s[i] in "_$"):
                    i += 1
                return i
            i += 1
        return -1

    def _template(self) -> Steps:
        self.out.append(Token("template", "`", self.line))
        self.at += 1
        while self.at < len(self.s):
            c = self.s[self.at]
            if c == "\\":
                self._to(min(self.at + 2, len(self.s)))
            elif c == "`":
                self.at += 1
                return
            elif self.s.startswith("${", self.at):
                self._add("mark", self.at + 2)
                yield self._code("}")
            else:
                self._to(self.at + 1)

    def _jsx_opens(self) -> bool:
        if not (self.jsx and self._expression_may_start()):
            return False
        # a generic arrow function, <T,> or <T extends X>, is none
        return bool(_TAG.match(self.s, self.at)) and not _GENERIC.match(self.s, self.at)

    def _jsx(self) -> Steps:
        """An element: its tag, then children until it closes."""
        depth = 0
        while self.at < len(self.s):
            closing = bool(_CLOSING_TAG.match(self.s, self.at))
            open_ended = yield self._jsx_tag()
            depth += -1 if closing else 1 if open_ended else 0
            if depth <= 0:
                self.out.append(Token("text", ">", self.line))
                return
            while self.at < len(self.s) and self.s[self.at] != "<":
                if self.s[self.at] == "{":
                    self._add("mark", self.at + 1)
                    yield self._code("}")
                else:
                    self._to(self.at + 1)

    def _jsx_tag(self) -> Steps:
        """Goes past a tag; whether it is left open."""
        self.at += 1
        before = ""
        while self.at < len(self.s):
            c = self.s[self.at]
            if c in "\"'":
                end = self.s.find(c, self.at + 1)
                self._to(len(self.s) if end < 0 else end + 1)
            elif c == "{":
                self._add("mark", self.at + 1)
                yield self._code("}")
            elif c == ">":
                self.at += 1
                return before != "/"
            else:
                self._to(self.at + 1)
            if not c.isspace():
                before = c
        return False

    def _code(self, until: str | None) -> Steps:
        depth, s = 0, self.s
        while self.at < len(s):
            if plain := _PLAIN.match(s, self.at):
                kind = plain.lastgroup
                if kind == "space":
                    self._to(plain.end())
                    continue
                text = plain.group()
                self.out.append(Token(kind, text, self.line))
                self.at = plain.end()
                if text == "{":
                    depth += 1
                elif text == "}":
                    if until and not depth:
                        return
                    depth -= 1
                continue
            c = s[self.at]
            if c == "﻿":
                self.at += 1
            elif s.startswith("//", self.at) or (self.at == 0 and s.startswith("#!")):
                end = s.find("\n", self.at)
                self._to(len(s) if end < 0 else end)
            elif s.startswith("/*", self.at):
                end = s.find("*/", self.at + 2)
                self._to(len(s) if end < 0 else end + 2)
            elif c in "\"'":
                self._add("string", self._string_end(c))
            elif c == "`":
                yield self._template()
            elif c == "/" and self._expression_may_start() and (end := self._regex_end()) > 0:
                self._add("regex", end)
            elif c == "<" and self._jsx_opens():
                yield self._jsx()
            elif c.isdigit() and (m := _NUMBER.match(s, self.at)):
                self._add("number", m.end())
            elif m := _NAME.match(s, self.at):
                self._add("name", m.end())
            else:
                m = _MARK.match(s, self.at)
                self._add("mark", m.end() if m else self.at + 1)

    def tokens(self) -> list[Token]:
        stack, value = [self._code(None)], None
        while stack:
            try:
                stack.append(stack[-1].send(value))
                value = None
            except StopIteration as done:
                stack.pop()
                value = done.value
        return self.out


_OPEN, _CLOSE = {"(", "[", "{", "${"}, {")", "]", "}"}
_CONTINUES = frozenset(". ?. ( [ + - * / % ** ? && || ?? = == === != !== < > <= >= << >> >>> & | ^ => ! += -= *= /= %=".split())
_CONTINUES_NAME = frozenset("as satisfies instanceof in".split())


class _Reader:
    """Finds imports in a list of tokens."""

    def __init__(self, tokens: list[Token]):
        self.t, self.found = tokens, []

    def _is(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind in ("mark", "name") and self.t[i].text in texts

    def _kind(self, i: int) -> str:
        return self.t[i].kind if 0 <= i < len(self.t) else ""

    def _value(self, i: int) -> str:
        text = self.t[i].text
        return text[1:-1] if len(text) > 1 and text[0] == text[-1] else text

    def _closing(self, i: int) -> int:
        """The place of the mark that closes the one at ``i``."""
        depth = 0
        for j in range(i, len(self.t)):
            if self.t[j].kind == "mark":
                depth += (self.t[j].text in _OPEN) - (self.t[j].text in _CLOSE)
                if not depth:
                    return j
        return len(self.t)

    def _parts(self, start: int, end: int) -> list[list[int]]:
        """The token places from ``start`` to ``end``, cut at commas that nothing encloses."""
        parts, depth = [[]], 0
        for j in range(start, min(end, len(self.t))):
            if self.t[j].kind == "mark":
                depth += (self.t[j].text in _OPEN) - (self.t[j].text in _CLOSE)
                if self.t[j].text == "," and not depth:
                    parts.append([])
                    continue
            parts[-1].append(j)
        return parts

    def _string_argument(self, opening: int) -> tuple[str | None, int]:
        """The first argument that is a string and nothing else; the place of the closing parenthesis."""
        end = self._closing(opening)
        for part in self._parts(opening + 1, end):
            if len(part) == 1 and self._kind(part[0]) == "string":
                return self._value(part[0]), end
        return None, end

    def _add(self, i: int, source: str, specifiers: list[str], kind: str) -> None:
        self.found.append(Import(source, specifiers, kind, self.t[i].line))

    def read(self) -> list[Import]:
        skip = -1
        for i, token in enumerate(self.t):
            if i <= skip or token.kind != "name" or self._is(i - 1, ".", "?."):
                continue
            if token.text == "import":
                skip = max(skip, self._import(i))
            elif token.text == "export":
                self._export(i)
            elif token.text == "require" and not self._is(i - 1, "new", "function"):
                opening = i + 2 if self._is(i + 1, "?.") else i + 1
                if self._is(opening, "("):
                    source, end = self._string_argument(opening)
                    if source is not None:
                        self._add(i, source, self._bound_names(i, end), "cjs")
        return self.found

    def _import(self, i: int) -> int:
        """Handles ``import`` at ``i``; the place up to which nothing more is to be read."""
        if self._is(i + 1, "("):
            source, _ = self._string_argument(i + 1)
            if source is not None:
                self._add(i, source, [], "esm")
            return i
        if self._kind(i + 1) == "string":
            self._add(i, self._value(i + 1), [], "esm")
            return i + 1
        if self._is(i + 1, ".", ":", "=", ",", ")", "}", ";"):
            return i
        j = i + 1
        if self._is(j, "type", "typeof") and not self._is(j + 1, "from", ",", "=") and (self._kind(j + 1) == "name" or self._is(j + 1, "{", "*")):
            j += 1
        elif self._is(j, "type") and self._is(j + 1, "from") and self._is(j + 2, "from"):
            j += 1
        specifiers: list[str] = []
        while j < len(self.t):
            if self._is(j, "from") and self._kind(j + 1) == "string":
                self._add(i, self._value(j + 1), specifiers, "esm")
                return j + 1
            if self._is(j, "="):  # import x = require("y"): no source of its own
                return self._closing(j + 2) if self._is(j + 1, "require") and self._is(j + 2, "(") else j
            if self._is(j, "{"):
                end = self._closing(j)
                specifiers += [x for part in self._parts(j + 1, end) if (x := self._local_name(part))]
                j = end + 1
            elif self._is(j, "*") and self._is(j + 1, "as") and self._kind(j + 2) == "name":
                specifiers.append(f"* as {self.t[j + 2].text}")
                j += 3
            elif self._is(j, ","):
                j += 1
            elif self._kind(j) == "name":
                specifiers.append(self.t[j].text)
                j += 1
            else:
                break
        return i

    def _without_type(self, part: list[int]) -> list[int]:
        return part[1:] if len(part) > 1 and self._is(part[0], "type") and not self._is(part[1], "as") else part

    def _local_name(self, part: list[int]) -> str | None:
        part = self._without_type(part)
        return self.t[part[-1]].text if part else None

    def _export(self, i: int) -> None:
        j = i + 1
        if self._is(j, "default"):
            ends = not (self._is(j + 2, *_CONTINUES, *_CONTINUES_NAME, ","))
            if self._kind(j + 1) == "string" and ends:
                self._add(i, self._value(j + 1), [], "esm")
            return
        if self._is(j, "type") and self._is(j + 1, "{", "*"):
            j += 1
        specifiers: list[str] = []
        if self._is(j, "{"):
            end = self._closing(j)
            specifiers = [self.t[p[0]].text for part in self._parts(j + 1, end) if (p := self._without_type(part))]
            j = end + 1
        elif self._is(j, "*"):
            if self._is(j + 1, "as"):
                j += 3
            else:
                specifiers = ["*"]
                j += 1
        else:
            return
        if self._is(j, "from") and self._kind(j + 1) == "string":
            self._add(i, self._value(j + 1), specifiers, "esm")

    def _bound_names(self, i: int, end: int) -> list[str]:
        """The names that a declaration binds to the call from ``i`` to ``end``, if the call is its whole value."""
        if not self._is(i - 1, "=") or self._is(end + 1, *_CONTINUES, *_CONTINUES_NAME) or self._kind(end + 1) == "template":
            return []
        depth, j, start = 0, i - 2, None
        while j >= 0:
            token = self.t[j]
            if token.kind == "mark":
                depth += (token.text in _CLOSE) - (token.text in _OPEN)
                if depth < 0 or (not depth and token.text in (";", "=", "=>")):
                    if depth < 0 or start is None or token.text == ";":
                        return []
                if not depth and token.text == "," and start is None:
                    start = j + 1
            elif not depth and token.kind == "name" and token.text in ("const", "let", "var"):
                start = j + 1 if start is None else start
                break
            j -= 1
        else:
            return []
        if self._is(start, "{"):
            names = []
            for part in self._parts(start + 1, self._closing(start)):
                if len(part) == 1 and self._kind(part[0]) == "name":
                    names.append(self.t[part[0]].text)
                elif len(part) > 2 and self._is(part[-2], ":") and self._kind(part[-1]) == "name":
                    names.append(self.t[part[-1]].text)
            return names
        return [self.t[start].text] if self._kind(start) == "name" and self._is(start + 1, "=", ":") else []


def parse_source(source: str | None, language: str = "typescript") -> list[Import]:
    """All imports of a source text in document order, repeated ones included."""
    if language not in ("typescript", "tsx", "javascript", "jsx"):
        raise ValueError(f"Unsupported language: {language}")
    return _Reader(Scanner(source or "", language).tokens()).read()
