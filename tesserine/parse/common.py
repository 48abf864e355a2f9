"""Shared parts of the extractors: a cursor over tokens with bracket matching, comments and text between tokens."""

from __future__ import annotations

import re

from tesserine.functions.lex import tokenize

_OPEN = {"(": ")", "[": "]", "{": "}"}
_LINE_END = re.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")


def function(name="", parameters=(), return_type="", docstring="", line=0, is_async=False, is_private=False, is_property=False, decorators=(), heads=1) -> dict:
    """A function record."""
    return {"name": name, "parameters": list(parameters), "return_type": return_type, "docstring": docstring, "line": line, "is_async": is_async, "is_private": is_private, "is_property": is_property, "decorators": list(decorators), "heads_count": heads}


def param(name="", type_hint="", default="", is_optional=False) -> dict:
    """A parameter record."""
    return {"name": name, "type_hint": type_hint, "default": default, "is_optional": is_optional}


def constant(name="", type_hint="", value="") -> dict:
    """A constant record."""
    return {"name": name, "type_hint": type_hint, "value": value}


def class_(name="", docstring="", bases=(), methods=(), class_vars=(), line=0) -> dict:
    """A class record."""
    return {"name": name, "docstring": docstring, "bases": list(bases), "methods": list(methods), "class_vars": list(class_vars), "line": line}


def route(method="", path="", handler="", line=0, docstring="") -> dict:
    """A route record."""
    return {"method": method, "path": path, "handler": handler, "line": line, "docstring": docstring}


def module(path: str, language: str) -> dict:
    """An empty module record for a path."""
    stem = path.rsplit("/", 1)[-1]
    return {"path": path, "name": stem.rsplit(".", 1)[0] if "." in stem[1:] else stem, "language": language, "docstring": "", "functions": [], "classes": [], "constants": [], "routes": [], "imports": [], "env_vars": {}}


def clean_comment(raw: str) -> str:
    """A comment without its marks, line by line."""
    raw = (raw or "").strip()
    raw = re.sub(r"\*/$", "", re.sub(r"^/\*\*?", "", raw))
    out = [re.sub(r"^(?:///|//!|//|#|\*+)", "", x.strip()).strip() for x in _LINE_END.split(raw)]
    return "\n".join(out).strip()


class Cursor:
    """Tokens of a text with what an extractor asks of them."""

    def __init__(self, src: str, language: str) -> None:
        self.k = tokenize(src, language)
        self.n, end = len(self.k.types), len(src)
        # Extractors look a few tokens ahead; behind the end they find more ends.
        self.k.types += ["EOF"] * 12
        self.k.start += [end] * 12
        self.k.end += [end] * 12
        self.k.nl += [True] * 12
        self.src, self.t, self.nl = src, self.k.types, self.k.nl
        self.match = self._matches() + [self.n - 1] * 12
        self.comment_end = {e: i for i, (_, e) in enumerate(self.k.comments)}
        self._breaks = [m.start() for m in re.finditer("\n", src)]

    def _matches(self) -> list[int]:
        out, stack = [self.n - 1] * self.n, []
        for i, x in enumerate(self.t[: self.n]):
            if x in _OPEN:
                stack.append(i)
            elif x in (")", "]", "}"):
                while stack and _OPEN[self.t[stack[-1]]] != x:
                    stack.pop()
                if stack:
                    out[stack.pop()] = i
        return out

    def text(self, i: int) -> str:
        """Text of a token."""
        return self.src[self.k.start[i] : self.k.end[i]] if i < self.n else ""

    def slice(self, a: int, b: int) -> str:
        """Source from token ``a`` to before token ``b``, white space at the ends removed."""
        return self.src[self.k.start[a] : self.k.end[b - 1]].strip() if a < b else ""

    def line(self, i: int) -> int:
        """1-based line of a token."""
        from bisect import bisect_left

        return bisect_left(self._breaks, self.k.start[i]) + 1

    def doc(self, i: int, pattern: str = "") -> str:
        """Cleaned run of comments that ends right before token ``i``; with ``pattern``, only comments that match it."""
        at, parts = self.k.start[i], []
        while True:
            gap = self.src[:at].rstrip()
            j = self.comment_end.get(len(gap))
            if j is None or self.src[len(gap) : at].count("\n") > 1:
                break
            b, e = self.k.comments[j]
            raw = self.src[b:e]
            line_start = self.src.rfind("\n", 0, b) + 1
            if self.src[line_start:b].strip() or pattern and not re.match(pattern, raw):
                break
            parts.append(clean_comment(raw))
            at = b
        return "\n".join(reversed(parts)).strip()

    def split(self, a: int, b: int, sep: str = ",") -> list[tuple[int, int]]:
        """Token ranges between top-level separators in [a, b); angle brackets count as brackets where they pair up."""
        out, begun, i, angle = [], a, a, 0
        while i < b:
            x = self.t[i]
            if x in _OPEN and self.match[i] < b:
                i = self.match[i]
            elif x == "<":
                angle += 1
            elif x[:1] == ">" and angle and x in (">", ">>", ">>>"):
                angle = max(0, angle - len(x))
            elif x == sep and not angle:
                out.append((begun, i))
                begun = i + 1
            i += 1
        if begun < b:
            out.append((begun, b))
        return out

    def find(self, a: int, b: int, *wanted: str) -> int:
        """First top-level token of ``wanted`` in [a, b), or -1."""
        i = a
        while i < b:
            x = self.t[i]
            if x in wanted:
                return i
            if x in _OPEN and self.match[i] < b:
                i = self.match[i]
            i += 1
        return -1

    def texts(self, a: int, b: int) -> list[str]:
        """Texts of the tokens in [a, b)."""
        return [self.text(i) for i in range(a, b)]

    def skip_angle(self, i: int) -> int:
        """Behind the type parameters that begin at ``i``, or ``i``."""
        if self.t[i] != "<":
            return i
        depth = 0
        while i < self.n:
            x = self.t[i]
            if x == "<":
                depth += 1
            elif x in (">", ">>", ">>>"):
                depth -= len(x)
            elif x in ("{", ";", "EOF"):
                return i
            i += 1
            if depth <= 0:
                return i
        return i


def unquote(raw: str) -> str:
    """A string literal without one layer of quotes, where it begins with the quote."""
    for q in ('"""', "'''", '"', "'", "`"):
        if raw.startswith(q) and raw.endswith(q) and len(raw) >= 2 * len(q):
            return raw[len(q) : -len(q)]
    return raw
