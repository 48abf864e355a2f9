"""JavaScript and TypeScript extractor."""

from __future__ import annotations

import re

from tesserine.parse.common import Cursor, class_, constant, function, module, param, route, unquote

_VERBS = frozenset("get post put delete patch options head all use".split())
_HTTP = frozenset("GET POST PUT DELETE PATCH OPTIONS HEAD".split())
_JSDOC = r"/\*\*"
_MEMBER = frozenset("public private protected static async override abstract readonly get set declare accessor".split())


def _params(c: Cursor, a: int, b: int) -> list[dict]:
    out = []
    for x, y in c.split(a, b):
        while x < y and c.text(x) in ("public", "private", "protected", "readonly") and x + 1 < y and c.t[x + 1] == "ID":
            x += 1
        eq = c.find(x, y, "=")
        end = eq if eq >= 0 else y
        colon = c.find(x, end, ":")
        name = c.slice(x, colon if colon >= 0 else end)
        optional = name.endswith("?")
        out.append(param(name.rstrip("?").strip(), c.slice(colon + 1, end) if colon >= 0 else "", c.slice(eq + 1, y) if eq >= 0 else "", optional))
    return [p for p in out if p["name"]]


def _returns(c: Cursor, i: int) -> tuple[str, int]:
    """Return type behind the parameters that close at ``i`` - 1, and where the body begins."""
    if c.t[i] != ":":
        return "", i
    j, depth = i + 1, 0
    while j < c.n and not (depth == 0 and (c.t[j] in ("=>", ";", "EOF") or c.t[j] == "{" and j > i + 1)):
        depth += (c.t[j] == "<") - (c.t[j] in (">", ">>") and depth > 0) * len(c.t[j])
        j = c.match[j] + 1 if c.t[j] in "([{" and c.match[j] < c.n - 1 else j + 1
    return c.slice(i + 1, j), j


def _zod_shape(c: Cursor, a: int, b: int) -> str:
    """Fields of z.object({...}) as a type, empty where a chain changes the shape."""
    names = c.texts(a, b)
    if names[:4] != ["z", ".", "object", "("] or set(names) & {"merge", "extend", "pick", "omit", "partial", "deepPartial"}:
        return ""
    brace = a + 4
    if c.t[brace] != "{":
        return ""
    fields = []
    for x, y in c.split(brace + 1, c.match[brace]):
        colon = c.find(x, y, ":")
        if colon < 0:
            continue
        chain = c.texts(colon + 1, y)
        kind = chain[2] if len(chain) > 2 and chain[0] == "z" else "unknown"
        inner = {"array": "[]"}.get(kind, "")
        if kind == "array" and len(chain) > 6:
            kind = chain[6]
        fields.append(f"{unquote(c.slice(x, colon))}{'?' if 'optional' in chain else ''}: {kind}{inner}")
    return "{ " + ", ".join(fields) + " }"


def parse(path: str, src: str, include_private: bool = False, language: str = "typescript", strict_routes: bool = False) -> dict:
    """The module record of a script file."""
    c = Cursor(src, "typescript" if path.lower().endswith((".ts", ".tsx", ".mts", ".cts")) else "javascript")
    out = module(path, language)
    i = 0
    while i < c.n - 1:
        i = max(i + 1, _top(c, i, out, include_private))
    _anywhere(c, path, out, strict_routes)
    out["routes"] += _next_routes(path, out, c)
    return out


def _function(c: Cursor, i: int, name: str, start: int, is_async: bool, decorators=()) -> tuple[dict, int]:
    """A function whose parameters open at or behind ``i`` (type parameters skipped)."""
    i = c.skip_angle(i)
    close = c.match[i]
    returns, at = _returns(c, close + 1)
    end = c.match[at] + 1 if c.t[at] == "{" else at
    return function(name, _params(c, i + 1, close), returns, c.doc(start, _JSDOC), c.line(start), is_async, name.startswith(("_", "#")), False, decorators), end


def _top(c: Cursor, i: int, out: dict, include_private: bool) -> int:
    t, start, exported = c.t, i, False
    decorators = []
    while t[i] == "@":
        j = i + 1
        while t[j] in ("ID", "."):
            j += 1
        if t[j] == "(":
            j = c.match[j] + 1
        decorators.append(c.slice(i + 1, j))
        i = j
    if t[i] == "import" and t[i + 1] != "(":
        j = i
        while t[j] not in ("STR", ";", "EOF"):
            j += 1
        if t[j] == "STR":
            out["imports"].append(unquote(c.text(j)))
        return j + 1
    if t[i] == "export":
        exported = True
        i += 1
        if t[i] == "default":
            i += 1
            if t[i] not in ("function", "class") and c.text(i) not in ("async", "abstract"):
                return i
        elif t[i] in ("{", "*"):
            j = i
            while t[j] not in ("STR", ";", "EOF") and not (c.nl[j] and j > i and t[j] not in ("}", ",", "ID")):
                j += 1
            if t[j] == "STR":
                out["imports"].append(unquote(c.text(j)))
            return j + 1
    take = exported or include_private
    while c.text(i) in ("declare", "abstract") and t[i + 1] in ("ID", "class", "function", "const", "enum"):
        i += 1
    is_async = c.text(i) == "async" and t[i + 1] == "function"
    i += is_async
    if t[i] == "function":
        j = i + 1 + (t[i + 1] == "*")
        name = c.text(j) if t[j] == "ID" else "default"
        f, end = _function(c, j + (t[j] == "ID"), name, start, is_async, decorators)
        if take:
            out["functions"].append(f)
        return end
    if t[i] == "class":
        k, end = _class(c, i, start, include_private)
        if take:
            out["classes"].append(k)
        return end
    word = c.text(i)
    if word in ("interface", "type") and t[i + 1] == "ID" or t[i] == "enum" or t[i] == "const" and t[i + 1] == "enum":
        i += t[i] == "const"
        name = c.text(i + 1)
        brace = c.find(i, c.n - 1, "{", ";")
        end = c.match[brace] + 1 if brace >= 0 and t[brace] == "{" else brace if brace >= 0 else i + 2
        if word == "type":
            end = i + 2
            while end < c.n - 1 and not (t[end] == ";" or c.nl[end] and t[end] not in ("|", "&", "=", "?", ":") and t[end - 1] not in ("|", "&", "=", "=>", "?", ":")):
                end = c.match[end] + 1 if t[end] in "([{" and c.match[end] < c.n - 1 else end + 1
        if t[i] == "enum":
            value = " | ".join(c.text(x) for x, _ in c.split(brace + 1, c.match[brace]))
        else:
            value = c.slice(start, end)
        if take:
            out["constants"].append(constant(name, "enum" if t[i] == "enum" else word, value))
        return end
    if t[i] in ("const", "var") or word == "let" and t[i + 1] in ("ID", "{", "["):
        end = i + 1
        while end < c.n - 1 and t[end] != ";" and not (c.nl[end] and end > i + 1 and t[end] not in (".", "?.", ")", "]", "}", ",", "=", "=>", "?", ":", "|", "||", "&&", "+", "??") and t[end - 1] not in ("=", ",", "=>", "?", ":", "+", "||", "&&", "??", "|")):
            end = c.match[end] + 1 if t[end] in "([{" and c.match[end] < c.n - 1 else end + 1
        for a, b in c.split(i + 1, end):
            if t[a] != "ID":
                continue
            eq = c.find(a, b, "=")
            colon = c.find(a + 1, eq if eq >= 0 else b, ":")
            v = eq + 1 if eq >= 0 else b
            arrow = c.find(v, b, "=>")
            is_async = v < b and c.text(v) == "async"
            p = c.skip_angle(v + is_async) if v < b else b
            if arrow >= 0 and p < b and t[p] in ("(", "ID"):
                f = function(c.text(a), _params(c, p + 1, c.match[p]) if t[p] == "(" else [param(c.text(p))], _returns(c, c.match[p] + 1)[0] if t[p] == "(" else "", c.doc(start, _JSDOC), c.line(start), is_async, c.text(a).startswith("_"))
                if take:
                    out["functions"].append(f)
            elif take:
                hint = c.slice(colon + 1, eq if eq >= 0 else b) if colon >= 0 else _zod_shape(c, v, b) if v < b else ""
                out["constants"].append(constant(c.text(a), hint, c.slice(v, b)))
        return end
    if t[i] in "([{" and c.match[i] < c.n - 1:
        return c.match[i] + 1
    return i + 1


def _class(c: Cursor, i: int, start: int, include_private: bool) -> tuple[dict, int]:
    t = c.t
    name = c.text(i + 1) if t[i + 1] == "ID" and c.text(i + 1) != "implements" else "default"
    brace = c.find(i, c.n - 1, "{")
    heritage = []
    a = i
    while a < brace:
        if t[a] == "extends" or c.text(a) == "implements":
            b = a + 1
            while b < brace and not (t[b] == "extends" or c.text(b) == "implements"):
                b += 1
            heritage += [c.slice(x, y) for x, y in c.split(a + 1, b)]
            a = b
        else:
            a += 1
    methods, variables = [], []
    j, end = brace + 1, c.match[brace]
    while j < end:
        begun, decorators = j, []
        while t[j] == "@":
            k = j + 1
            while t[k] in ("ID", "."):
                k += 1
            k = c.match[k] + 1 if t[k] == "(" else k
            decorators.append(c.slice(j + 1, k))
            j = k
        mods = set()
        while c.text(j) in _MEMBER and t[j + 1] not in ("(", "=", ":", ";", "?", "!"):
            mods.add(c.text(j))
            j += 1
        j += t[j] == "*"
        hashed = t[j] == "#"
        j += hashed
        member = ("#" if hashed else "") + c.text(j)
        k = j + 1
        while t[k] in ("?", "!"):
            k += 1
        k = c.skip_angle(k)
        if t[k] == "(":
            f, stop = _function(c, k, member, begun, "async" in mods, decorators)
            f["is_private"] = "private" in mods or member.startswith(("_", "#"))
            f["is_property"] = "get" in mods
            if include_private or not member.startswith(("_", "#")) and "private" not in mods:
                methods.append(f)
            j = stop
        else:
            stop = k
            while stop < end and t[stop] != ";" and not (c.nl[stop] and stop > k and t[stop] not in ("=", ":", ".", "|")):
                stop = c.match[stop] + 1 if t[stop] in "([{" and c.match[stop] < end else stop + 1
            eq, colon = c.find(k, stop, "="), c.find(k, stop, ":")
            if member and t[j] == "ID":
                variables.append(constant(member, c.slice(colon + 1, eq if eq > colon else stop) if 0 <= colon and (eq < 0 or colon < eq) else "", c.slice(eq + 1, stop) if eq >= 0 else ""))
            j = max(stop, j + 1)
        while j < end and t[j] == ";":
            j += 1
    return class_(name, c.doc(start, _JSDOC), heritage, methods, variables, c.line(start)), end + 1


def _anywhere(c: Cursor, path: str, out: dict, strict: bool) -> None:
    """Routes and environment variables, wherever they stand."""
    t = c.t
    for i in range(c.n - 4):
        if t[i] == "." and c.text(i + 1) in _VERBS and t[i + 2] == "(":
            close = c.match[i + 2]
            args = c.split(i + 3, close)
            if not args or c.text(i + 1) in ("all", "use"):
                continue
            first = args[0]
            if strict and t[first[0]] != "STR":
                continue
            if t[first[0]] not in ("STR", "TPL") and strict:
                continue
            handler = c.text(args[-1][0]) if len(args) > 1 and args[-1][1] - args[-1][0] == 1 and t[args[-1][0]] == "ID" else ""
            out["routes"].append(route(c.text(i + 1).upper(), unquote(c.slice(*first)), handler, c.line(i), c.doc(i - 1, _JSDOC)))
        if c.text(i) == "process" and t[i + 1] == "." and c.text(i + 2) == "env":
            if t[i + 3] == "." and t[i + 4] == "ID":
                out["env_vars"].setdefault(c.text(i + 4), [path])
            elif t[i + 3] == "[" and t[i + 4] == "STR":
                out["env_vars"].setdefault(unquote(c.text(i + 4)), [path])


def _next_routes(path: str, out: dict, c: Cursor) -> list[dict]:
    """Routes that file-system routing gives to page and route files."""
    parts = path.split("/")
    m = re.fullmatch(r"(page|route)\.(?:tsx|ts|jsx|js)", parts[-1])
    if not m:
        return []
    at = len(parts) - 1 - parts[::-1].index("app") if "app" in parts else -1
    url = "/" + "/".join(parts[at + 1 : -1])
    if m.group(1) == "page":
        return [route("GET", url, "default", 1, "")]
    return [route(f["name"], url, f["name"], f["line"], f["docstring"]) for f in out["functions"] if f["name"] in _HTTP]
