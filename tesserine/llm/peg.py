"""Packrat parsing of parsing-expression grammars.

A grammar is text: one rule a line, ``name <- expression``. Expressions know sequence, ordered choice (/), repetition
(* + ?), predicates (! &), groups, terminals (a regular expression between tildes) and captures (``label:expression``).
Every rule's outcome is remembered per place, so parsing takes time linear in the text. Captures keep source offsets.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

#: A parse from a place: None, or (end, captures), a capture being (label, begin, end, inner captures).
Outcome = tuple[int, tuple] | None
Parser = Callable[[str, int, dict], Outcome]
#: Frames for deeply nested texts.
FRAMES = 500_000
_TOKENS = re.compile(r"\s+|~((?:[^~\\]|\\.)+)~|(\w+):(?=[\w(~])|(\w+)|([()/*+?!&])")


class Grammar:
    """A compiled grammar."""

    def __init__(self, text: str) -> None:
        self.rules: dict[str, Parser] = {}
        self.numbers: dict[str, int] = {}
        for line in text.strip().splitlines():
            name, _, body = line.partition("<-")
            if body:
                self.numbers[name.strip()] = len(self.numbers)
                self.rules[name.strip()] = self._compile(body, line)

    def _compile(self, body: str, line: str) -> Parser:
        tokens, at = [], 0
        while at < len(body):
            m = _TOKENS.match(body, at)
            if not m:
                raise ValueError(f"bad grammar: {line!r} at {body[at:]!r}")
            at = m.end()
            if m.group(1) is not None:
                tokens.append(("re", m.group(1)))
            elif m.group(2):
                tokens.append(("label", m.group(2)))
            elif m.group(3):
                tokens.append(("ref", m.group(3)))
            elif m.group(4):
                tokens.append((m.group(4), ""))
        expression, rest = self._choice(tokens, 0)
        if rest != len(tokens):
            raise ValueError(f"bad grammar: {line!r}")
        return expression

    def _choice(self, t, i):
        first, i = self._sequence(t, i)
        options = [first]
        while i < len(t) and t[i][0] == "/":
            option, i = self._sequence(t, i + 1)
            options.append(option)
        if len(options) == 1:
            return first, i

        def choice(text, at, memo):
            for p in options:
                r = p(text, at, memo)
                if r is not None:
                    return r
            return None

        return choice, i

    def _sequence(self, t, i):
        parts = []
        while i < len(t) and t[i][0] not in ("/", ")"):
            part, i = self._suffixed(t, i)
            parts.append(part)
        if len(parts) == 1:
            return parts[0], i

        def sequence(text, at, memo):
            found = ()
            for p in parts:
                r = p(text, at, memo)
                if r is None:
                    return None
                at = r[0]
                if r[1]:
                    found += r[1]
            return at, found

        return sequence, i

    def _suffixed(self, t, i):
        kind, value = t[i]
        if kind in ("!", "&"):
            inner, i = self._suffixed(t, i + 1)
            wanted = kind == "&"
            return (lambda text, at, memo: (at, ()) if (inner(text, at, memo) is not None) == wanted else None), i
        if kind == "label":
            inner, i = self._suffixed(t, i + 1)

            def capture(text, at, memo):
                r = inner(text, at, memo)
                return None if r is None else (r[0], ((value, at, r[0], r[1]),))

            return capture, i
        if kind == "(":
            p, i = self._choice(t, i + 1)
            i += 1
        elif kind == "re":
            match = re.compile(value).match
            i += 1

            def p(text, at, memo):
                m = match(text, at)
                return None if m is None else (m.end(), ())
        elif kind == "ref":
            i += 1
            rules, name = self.rules, value

            def p(text, at, memo):
                key = (name, at)
                if key in memo:
                    return memo[key]
                r = rules[name](text, at, memo)
                memo[key] = r
                return r
        else:
            raise ValueError(f"bad grammar at {t[i]}")
        if i < len(t) and t[i][0] in ("*", "+", "?"):
            suffix = t[i][0]
            i += 1
            inner = p
            if suffix == "?":
                return (lambda text, at, memo: inner(text, at, memo) or (at, ())), i

            def repeat(text, at, memo):
                found: list = []
                begun = at
                while True:
                    r = inner(text, at, memo)
                    if r is None or r[0] == at:
                        break
                    at = r[0]
                    if r[1]:
                        found.extend(r[1])
                return None if suffix == "+" and at == begun else (at, tuple(found))

            return repeat, i
        return p, i

    def parse(self, rule: str, text: str, at: int = 0) -> Outcome:
        """Outcome of a rule at a place."""
        return self.rules[rule](text, at, {})

    def each(self, rule: str, skip: str, text: str, memo: dict | None = None):
        """Captures of ``rule`` wherever it holds, from top to bottom, stepping over the rest with ``skip``.

        Nested rules take frames of the interpreter, which lie on the heap; the limit is lifted while a text is read.
        """
        at, memo, n = 0, {} if memo is None else memo, len(text)
        rules = self.rules
        frames = sys.getrecursionlimit()
        sys.setrecursionlimit(max(frames, FRAMES))
        try:
            while at < n:
                r = rules[rule](text, at, memo)
                if r is not None and r[0] > at:
                    yield at, r[0], r[1]
                    at = r[0]
                    continue
                r = rules[skip](text, at, memo)
                if r is None or r[0] <= at:
                    return
                at = r[0]
        finally:
            sys.setrecursionlimit(frames)
