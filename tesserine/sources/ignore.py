"""Ignore patterns as gitignore writes them, as regular expressions that Python, Java and RE2 read alike."""

from __future__ import annotations

import re

_SPECIAL = set(".^$+{}()|\\")


def pattern_regex(pattern: str) -> tuple[str, bool] | None:
    """(regular expression over whole paths, negated) of a pattern; None for blank lines and comments."""
    p = re.sub(r"(?<!\\) +$", "", pattern.rstrip("\n"))
    if not p or p.startswith("#"):
        return None
    negated = p.startswith("!")
    if negated or p.startswith(("\\!", "\\#")):
        p = p[1:]
    folder = p.endswith("/")
    p = p.rstrip("/") if folder else p
    if not p:
        return None
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        c = p[i]
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out += "(?:.*/)?"
            i += 3
            continue
        if p.startswith("/**", i) and i + 3 == len(p):
            out += "/.*"
            i += 3
            continue
        if c == "*":
            while p.startswith("**", i):
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in p[i + 2 :]:
            j = p.index("]", i + 2)
            inner = p[i + 1 : j]
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
            i = j
        elif c == "\\" and i + 1 < len(p):
            i += 1
            out += re.escape(p[i])
        else:
            out += "\\" + c if c in _SPECIAL else c
        i += 1
    head = "" if anchored else "(?:.*/)?"
    return f"^{head}{out}{'/.*' if folder else '(?:/.*)?'}$", negated


def compiled(patterns) -> list[tuple[str, bool]]:
    """All patterns as (regular expression, negated), in order."""
    return [x for x in map(pattern_regex, patterns) if x]


class Matcher:
    """Whether the last pattern that matches a path ignores it."""

    def __init__(self, patterns) -> None:
        self.rules = [(re.compile(r), n) for r, n in compiled(patterns)]

    def match(self, path: str) -> bool:
        """Whether the path is ignored."""
        for rule, negated in reversed(self.rules):
            if rule.match(path):
                return not negated
        return False


def load_gitignore(root) -> list[str]:
    """Lines of the root's .gitignore; none where it is absent."""
    from pathlib import Path

    f = Path(root) / ".gitignore"
    return f.read_text(encoding="utf-8", errors="replace").splitlines() if f.is_file() else []
