"""Extractors of languages whose blocks close with "end": Ruby and Elixir."""

from __future__ import annotations

import re

from tesserine.parse.common import Cursor, class_, constant, function, module, param, unquote

_OPENERS = frozenset("class module def do case begin unless if while until for".split())


def parse_ruby(path: str, src: str, include_private: bool = False) -> dict:
    """The module record of a Ruby file. Visibility words hold until the next; mixins become bases."""
    c = Cursor(src, "ruby")
    out = module(path, "ruby")
    t = c.t

    def block_end(i: int) -> int:
        """Behind the "end" of the block that opens at ``i``."""
        depth, j = 0, i
        while j < c.n - 1:
            x = t[j]
            if x in _OPENERS:
                tail = x in ("if", "unless", "while", "until") and not c.nl[j] and j > 0 and t[j - 1] not in ("=", "(", ",", "return", "then", "else", "do", "||=")
                loop = x == "do" and any(t[q] in ("while", "until", "for") for q in range(max(0, j - 12), j) if c.line(q) == c.line(j) and c.nl[q])
                endless = x == "def" and _endless(j)
                if not tail and not loop and not endless:
                    depth += 1
            elif x == "end":
                depth -= 1
                if depth <= 0:
                    return j + 1
            j += 1
        return c.n - 1

    def _endless(j: int) -> bool:
        k = j + 2
        if t[k] == "(":
            k = c.match[k] + 1
        return t[k] == "=" and not c.nl[k]

    def method(i: int, start: int, private: bool) -> tuple[dict | None, int]:
        end = block_end(i) if not _endless(i) else next((q for q in range(i + 2, c.n) if c.nl[q]), c.n - 1)
        k = i + 1
        if t[k + 1] == ".":
            return None, end
        name = c.text(k)
        ps = []
        j = k + 1
        if t[j] == "(":
            ranges = c.split(j + 1, c.match[j])
        else:
            stop = j
            while stop < c.n - 1 and not c.nl[stop] and t[stop] not in (";", "="):
                stop += 1
            ranges = c.split(j, stop)
        for x, y in ranges:
            eq, colon = c.find(x, y, "="), c.find(x, y, ":")
            if eq >= 0:
                ps.append(param(c.slice(x, eq), "", c.slice(eq + 1, y), True))
            elif colon >= 0:
                ps.append(param(c.slice(x, colon) + ":", "", c.slice(colon + 1, y), colon + 1 < y))
            else:
                ps.append(param(c.slice(x, y)))
        return function(name, ps, "", c.doc(start, r"#"), c.line(i), False, private), end

    def body(i: int, end: int, owner: dict | None) -> None:
        private = False
        while i < end:
            x, word = t[i], c.text(i)
            if word in ("private", "protected", "public") and x == "ID":
                if t[i + 1] == "def":
                    f, stop = method(i + 1, i, word != "public")
                    if f and (include_private or not f["is_private"]):
                        (owner["methods"] if owner else out["functions"]).append(f)
                    i = stop
                elif c.nl[i + 1] or t[i + 1] == ";":
                    private = word != "public"
                    i += 1
                else:
                    i += 2
                continue
            if x == "def":
                f, stop = method(i, i, private)
                if f and (include_private or not f["is_private"]):
                    (owner["methods"] if owner else out["functions"]).append(f)
                i = max(stop, i + 1)
            elif x in ("class", "module") and t[i + 1] in ("ID", "::"):
                j = i + 1
                while t[j] in ("ID", "::") and not (c.nl[j] and j > i + 1):
                    j += 1
                name = c.slice(i + 1, j)
                bases = []
                if t[j] == "<":
                    k = j + 1
                    while k < end and not c.nl[k] and t[k] != ";":
                        k += 1
                    bases, j = [c.slice(j + 1, k)], k
                stop = block_end(i)
                made = class_(name, c.doc(i, r"#"), bases, [], [], c.line(i))
                body(j, stop - 1, made)
                if owner is None:
                    out["classes"].append(made)
                i = max(stop, i + 1)
            elif word in ("attr_reader", "attr_writer", "attr_accessor") and owner is not None:
                j = i + 1
                while j < end and not c.nl[j]:
                    if t[j] == "SYM" and (include_private or not private):
                        n = c.text(j).lstrip(":")
                        if word != "attr_writer":
                            owner["methods"].append(function(n, [], "", c.doc(i, r"#"), c.line(i), False, private, True))
                        if word != "attr_reader":
                            owner["methods"].append(function(n + "=", [param("value")], "", "", c.line(i), False, private, True))
                    j += 1
                i = j
            elif word in ("include", "extend", "prepend") and owner is not None:
                j = i + 1
                while j < end and not c.nl[j]:
                    j += 1
                owner["bases"] += [f"{word}({c.slice(a, b)})" for a, b in c.split(i + 1, j)]
                i = j
            elif word in ("require", "require_relative") and x == "ID":
                k = i + 1 + (t[i + 1] == "(")
                if t[k] == "STR":
                    out["imports"].append(unquote(c.text(k)))
                i = k + 1
            elif x == "ID" and word[:1].isupper() and t[i + 1] == "=":
                j = i + 2
                while j < end and not (c.nl[j] and j > i + 2):
                    j = c.match[j] + 1 if t[j] in "([{" and c.match[j] < c.n - 1 else j + 1
                (owner["class_vars"] if owner else out["constants"]).append(constant(word, "", c.slice(i + 2, j)))
                i = j
            elif x in _OPENERS and (c.nl[i] or x == "do"):
                i = max(block_end(i), i + 1)
            else:
                i = c.match[i] + 1 if x in "([{" and c.match[i] < c.n - 1 else i + 1

    body(0, c.n - 1, None)
    return out


def parse_elixir(path: str, src: str, include_private: bool = False) -> dict:
    """The module record of an Elixir file. @doc and @spec go to the next definition; heads of one name collapse."""
    c = Cursor(src, "elixir")
    out = module(path, "elixir")
    t = c.t

    def block_end(i: int) -> int:
        depth, j = 0, i
        while j < c.n - 1:
            if t[j] in ("do", "fn") and not (t[j + 1] == ":" and c.k.start[j + 1] == c.k.end[j]):
                depth += 1
            elif t[j] == "end":
                depth -= 1
                if depth <= 0:
                    return j + 1
            j += 1
        return c.n - 1

    def line_end(i: int) -> int:
        j = i + 1
        while j < c.n - 1 and not (c.nl[j] and t[j - 1] not in (",", "|>", "|", "->", "::", "=", "(")):
            if t[j] in ("do", "fn"):
                return j
            j = c.match[j] + 1 if t[j] in "([{" and c.match[j] < c.n - 1 else j + 1
        return j

    def body(i: int, end: int, owner: dict | None) -> None:
        doc, spec, heads = "", None, {}
        into = owner["methods"] if owner else out["functions"]
        while i < end:
            word = c.text(i)
            if t[i] == "@" and t[i + 1] == "ID":
                name = c.text(i + 1)
                stop = line_end(i + 1)
                value = c.slice(i + 2, stop)
                if name in ("doc", "moduledoc", "typedoc"):
                    text = "" if value == "false" else unquote(re.sub(r"^~[sS]", "", value)).strip()
                    if name == "moduledoc":
                        if owner is not None:
                            owner["docstring"] = text
                        else:
                            out["docstring"] = text
                    elif name == "doc":
                        doc = text
                elif name == "spec":
                    p = next((q for q in range(i + 2, stop) if t[q] == "("), -1)
                    if p >= 0:
                        close = c.match[p]
                        spec = ([param("", c.slice(a, b)) for a, b in c.split(p + 1, close)], c.slice(close + 2, stop) if t[close + 1] == "::" else "")
                elif name not in ("impl", "type", "typep", "opaque", "callback", "behaviour", "derive", "enforce_keys", "dialyzer", "deprecated", "since") and value:
                    (owner["class_vars"] if owner else out["constants"]).append(constant("@" + name, "", value))
                i = max(stop, i + 2)
            elif word in ("defmodule", "defprotocol", "defimpl") and t[i] == "ID":
                d = next((q for q in range(i, end) if t[q] == "do"), -1)
                if d < 0:
                    return
                stop = block_end(d)
                if owner is None:
                    made = class_(c.slice(i + 1, d).rstrip(","), "", [], [], [], c.line(i))
                    body(d + 1, stop - 1, made)
                    out["classes"].append(made)
                i = stop
            elif word in ("def", "defp", "defmacro", "defmacrop") and t[i] == "ID":
                private = word.endswith("p")
                name = c.text(i + 1)
                p = i + 2
                ps, after = [], p
                if t[p] == "(":
                    after = c.match[p] + 1
                    for a, b in c.split(p + 1, c.match[p]):
                        d = next((q for q in range(a, b) if t[q] == "\\" and t[q + 1] == "\\"), -1)
                        ps.append(param(c.slice(a, d if d >= 0 else b), "", c.slice(d + 2, b) if d >= 0 else "", d >= 0))
                stop = line_end(i + 1)
                if stop < end and t[stop] == "do" and not (t[stop + 1] == ":" and c.k.start[stop + 1] == c.k.end[stop]):
                    stop = block_end(stop)
                elif stop < end and t[stop] == "do":
                    stop = line_end(stop + 1)
                known = heads.get(name)
                if known is not None:
                    known["heads_count"] += 1
                elif include_private or not private:
                    made = function(name, spec[0] if spec else ps, spec[1] if spec else "", doc, c.line(i), False, private, False, ["macro"] if "macro" in word else [])
                    heads[name] = made
                    into.append(made)
                doc, spec = "", None
                i = max(stop, after, i + 2)
            elif word == "defstruct" and owner is not None:
                stop = line_end(i)
                owner["class_vars"] += [constant(m) for m in re.findall(r"(?::(\w+)|\b(\w+):)", c.slice(i + 1, stop)) for m in m if m]
                i = max(stop, i + 1)
            elif word in ("alias", "import", "require", "use") and t[i] == "ID":
                stop = line_end(i)
                out["imports"].append(c.slice(i + 1, stop).split(",")[0].strip())
                i = max(stop, i + 1)
            elif t[i] in ("do", "fn"):
                i = block_end(i)
            else:
                i = c.match[i] + 1 if t[i] in "([{" and c.match[i] < c.n - 1 else i + 1
        for f in into:
            if f["heads_count"] > 1 and "(+" not in f["name"]:
                f["name"] = f"{f['name']} (+{f['heads_count'] - 1} heads)"

    body(0, c.n - 1, None)
    return out
