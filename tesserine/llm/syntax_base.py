"""Common parts of the syntax checkers: recursive descent over tokens, precedence climbing, panic-mode recovery.

A checker builds no tree. It accepts or rejects: a failed expectation raises ``Unexpected``, which the enclosing statement
list records before it skips to the next token where a statement can begin, so one file yields all its errors.
"""

from __future__ import annotations

from tesserine.functions.lex import Tokens


class Unexpected(Exception):
    """An error at a token."""

    def __init__(self, at: int, message: str) -> None:
        super().__init__(message)
        self.at, self.message = at, message


class Checker:
    """State and helpers shared by all languages."""

    SYNC: frozenset = frozenset()
    #: Nearly all files nest less than this. Deeper ones are read again with ``DEEPEST`` and a longer stack.
    DEEP = 150
    DEEPEST = 1 << 30

    def __init__(self, tokens: Tokens) -> None:
        self.k, self.t, self.nl, self.i = tokens, tokens.types, tokens.nl, 0
        self.errors: list[tuple[int, str]] = list(tokens.errors)
        self.undo: list[tuple[int, str]] = []
        self.deep = 0

    def fail(self, message: str = "unexpected token"):
        raise Unexpected(self.i, message)

    def need(self, x: str) -> None:
        if self.t[self.i] != x:
            raise Unexpected(self.i, f"expected {x}")
        self.i += 1

    def opt(self, x: str) -> bool:
        if self.t[self.i] == x:
            self.i += 1
            return True
        return False

    def text(self, i: int | None = None) -> str:
        i = self.i if i is None else i
        return self.k.src[self.k.start[i] : self.k.end[i]] if i < len(self.k.start) else ""

    def word(self, w: str, ahead: int = 0) -> bool:
        """Whether a contextual keyword stands here."""
        return self.t[self.i + ahead] == "ID" and self.text(self.i + ahead) == w if self.i + ahead < len(self.t) else False

    def close_angle(self) -> None:
        """Take one ">" off a token that may hold more."""
        t = self.t[self.i]
        if t == ">":
            self.i += 1
        elif t[:1] == ">":
            self.undo.append((self.i, t))
            self.t[self.i] = t[1:]
        else:
            self.fail("expected >")

    def attempt(self, f) -> bool:
        """Run ``f``; where it fails, go back."""
        at, marks, deep = self.i, len(self.undo), self.deep
        try:
            f()
            return True
        except Unexpected:
            self.i, self.deep = at, deep
            while len(self.undo) > marks:
                j, t = self.undo.pop()
                self.t[j] = t
            return False

    def nested(self, f):
        self.deep += 1
        if self.deep > self.DEEP:
            raise TooDeep
        r = f()
        self.deep -= 1
        return r

    def statement(self) -> None:
        raise NotImplementedError

    def recover(self, begun: int) -> None:
        """Panic mode: skip to a token after which, or at which, a statement can begin."""
        t, i, depth = self.t, max(self.i, begun + 1), 0
        while t[i - 1 if i >= len(t) else i] != "EOF":
            x = t[i]
            if x in ("{", "(", "["):
                depth += 1
            elif x in ("}", ")", "]"):
                depth -= 1
            elif depth <= 0 and (x == ";" or x in self.SYNC and self.nl[i]):
                i += x == ";"
                break
            i += 1
            if depth < 0:
                break
        self.i = min(i, len(t) - 1)

    def program(self) -> list[tuple[int, str]]:
        """All errors as (offset, message), in order."""
        t = self.t
        while t[self.i] != "EOF":
            begun = self.i
            try:
                self.statement()
                if self.i == begun:
                    self.fail()
            except Unexpected as e:
                self.errors.append((self.k.start[min(e.at, len(self.k.start) - 1)], e.message))
                self.deep = 0
                self.recover(begun)
        return sorted(set(self.errors))


class TooDeep(Exception):
    """Nesting beyond the limit."""
