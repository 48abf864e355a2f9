"""Go extractor."""

from __future__ import annotations

from tesserine.parse.common import Cursor, class_, constant, function, module, param, unquote


def _exported(name: str) -> bool:
    return name[:1].isupper()


def _params(c: Cursor, a: int, b: int) -> list[dict]:
    """Parameters; names that share a type get it, a variadic one has dots on name and type."""
    groups = c.split(a, b)
    typed = [(x, y) for x, y in groups if y - x > 1 and c.t[x] == "ID" and c.t[x + 1] != "."]
    out = []
    if not typed:
        return [param("", c.slice(x, y)) for x, y in groups if y > x]
    waiting: list[str] = []
    for x, y in groups:
        if y - x == 1:
            waiting.append(c.text(x))
            continue
        kind, name = c.slice(x + 1, y), c.text(x)
        for w in [*waiting, name]:
            out.append(param(("..." if kind.startswith("...") else "") + w, kind))
        waiting = []
    return out


def _signature(c: Cursor, i: int) -> tuple[list[dict], str, int]:
    """Parameters that open at ``i``, result type, and where the body (or the next declaration) begins."""
    close = c.match[i]
    j = close + 1
    begun = j
    while j < c.n - 1 and c.t[j] != "{" and not c.nl[j]:
        if c.t[j] in ("interface", "struct") and c.t[j + 1] == "{":
            j = c.match[j + 1] + 1
            continue
        j = c.match[j] + 1 if c.t[j] in ("(", "[") and c.match[j] < c.n - 1 else j + 1
    return _params(c, i + 1, close), c.slice(begun, j), j


def parse(path: str, src: str, include_private: bool = False) -> dict:
    """The module record of a Go file."""
    c = Cursor(src, "go")
    out = module(path, "go")
    t, i = c.t, 0
    types: dict[str, dict] = {}
    order: list[str] = []
    attached: dict[str, list[dict]] = {}
    keep = lambda n: include_private or _exported(n)

    def spec(j: int, end: int, what: str, group_doc: str) -> None:
        doc = c.doc(j) or group_doc
        if what == "import":
            out["imports"] += [unquote(c.text(k)) for k in range(j, end) if t[k] == "STR"]
        elif what == "type":
            name = c.text(j)
            k = j + 1
            if t[k] == "[" and t[k + 1] == "ID" and t[k + 2] not in ("]",):
                k = c.match[k] + 1
            k += t[k] == "="
            bases, methods = [], []
            if t[k] == "struct" and t[k + 1] == "{":
                for a, b in _lines(c, k + 2, c.match[k + 1]):
                    if b - a == 1 or t[a] == "*" or t[a + 1] == ".":
                        bases.append(c.slice(a, b).lstrip("*"))
            elif t[k] == "interface" and t[k + 1] == "{":
                for a, b in _lines(c, k + 2, c.match[k + 1]):
                    if t[a] == "ID" and a + 1 < b and t[a + 1] == "(":
                        ps, ret, _ = _signature(c, a + 1)
                        methods.append(function(c.text(a), ps, c.slice(c.match[a + 1] + 1, b), c.doc(a), c.line(a), False, not _exported(c.text(a))))
            types[name] = class_(name, doc, bases, [m for m in methods if keep(m["name"])], [], c.line(j))
            order.append(name)
        else:
            k = j
            names = []
            while t[k] == "ID":
                names.append(c.text(k))
                if t[k + 1] != ",":
                    break
                k += 2
            eq = c.find(j, end, "=")
            hint = c.slice(k + 1, eq if eq >= 0 else end)
            out["constants"] += [constant(n, hint, "") for n in names if keep(n)]

    while i < c.n - 1:
        x = t[i]
        if x == "package":
            out["docstring"] = c.doc(i)
            i += 2
        elif x in ("import", "const", "var", "type"):
            doc = c.doc(i)
            if t[i + 1] == "(":
                end = c.match[i + 1]
                for a, b in _lines(c, i + 2, end):
                    spec(a, b, x, "" if x == "type" else doc)
                i = end + 1
            else:
                end = _line_end(c, i + 1)
                spec(i + 1, end, x, doc)
                i = end
        elif x == "func":
            j, receiver = i + 1, ""
            if t[j] == "(":
                names = [c.text(k) for k in range(j + 1, c.match[j]) if t[k] == "ID"]
                receiver = names[1] if len(names) > 1 else names[0] if names else ""
                j = c.match[j] + 1
            name = c.text(j)
            j += 1
            if t[j] == "[":
                j = c.match[j] + 1
            if t[j] != "(":
                i += 1
                continue
            ps, ret, at = _signature(c, j)
            f = function(name, ps, ret, c.doc(i), c.line(i), False, not _exported(name))
            if keep(name):
                if receiver:
                    attached.setdefault(receiver, []).append(f)
                else:
                    out["functions"].append(f)
            i = c.match[at] + 1 if t[at] == "{" else at
        else:
            i = c.match[i] + 1 if x in "([{" and c.match[i] < c.n - 1 else i + 1
    for name in order:
        types[name]["methods"] += attached.pop(name, [])
        if keep(name):
            out["classes"].append(types[name])
    out["classes"] += [class_(n, "", [], ms, [], ms[0]["line"]) for n, ms in attached.items() if keep(n)]
    for i in range(c.n - 4):
        if c.text(i) == "os" and t[i + 1] == "." and c.text(i + 2) in ("Getenv", "LookupEnv") and t[i + 3] == "(" and t[i + 4] == "STR":
            out["env_vars"].setdefault(unquote(c.text(i + 4)), [path])
    return out


def _line_end(c: Cursor, i: int) -> int:
    j = i
    while j < c.n - 1 and not (c.nl[j] and j > i) and c.t[j] != ";":
        j = c.match[j] + 1 if c.t[j] in "([{" and c.match[j] < c.n - 1 else j + 1
    return j


def _lines(c: Cursor, a: int, b: int) -> list[tuple[int, int]]:
    """Token ranges of the lines in [a, b), brackets joined."""
    out, i = [], a
    while i < b:
        e = min(b, _line_end(c, i))
        if e > i:
            out.append((i, e))
        i = max(e, i + 1) if c.t[e] != ";" else e + 1
    return out
