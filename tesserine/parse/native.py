"""Extractors of Rust and C/C++."""

from __future__ import annotations

import re

from tesserine.parse.common import Cursor, class_, clean_comment, constant, function, module, param, unquote


def parse_rust(path: str, src: str, include_private: bool = False) -> dict:
    """The module record of a Rust file; methods of impl blocks attach to their type by its text.

    Trait methods carry no visibility and so count as private, yet they stay.
    """
    c = Cursor(src, "rust")
    out = module(path, "rust")
    t = c.t
    inner = [clean_comment(src[b:e]) for b, e in c.k.comments if src.startswith("//!", b)]
    out["docstring"] = "\n".join(inner).strip()
    types: dict[str, dict] = {}

    def head(i: int) -> tuple[list[str], bool, int]:
        notes = []
        while t[i] == "#":
            j = i + 1 + (t[i + 1] == "!")
            notes.append(c.slice(j + 1, c.match[j]))
            i = c.match[j] + 1
        public = t[i] == "pub"
        if public:
            i += 1
            if t[i] == "(":
                i = c.match[i] + 1
        while t[i] in ("async", "unsafe", "const", "extern") and (t[i + 1] in ("fn", "async", "unsafe", "extern", "STR", "impl", "trait")) or t[i] == "STR" and t[i + 1] == "fn" or c.text(i) == "default" and t[i + 1] == "fn":
            i += 1
        return notes, public, i

    def doc(i: int) -> str:
        return c.doc(i, r"///(?!/)|/\*\*")

    def fn(k: int, start: int, public: bool, notes) -> tuple[dict, int]:
        name = c.text(k + 1)
        p = c.skip_angle(k + 2)
        generics = c.slice(k + 2, p)
        close = c.match[p]
        j = close + 1
        while j < c.n - 1 and t[j] not in ("{", ";"):
            j = c.match[j] + 1 if t[j] in ("(", "[") and c.match[j] < c.n - 1 else j + 1
        where = next((q for q in range(close, j) if t[q] == "where"), j)
        ret = c.slice(close + 2, where) if t[close + 1] == "->" else ""
        ps = []
        for x, y in c.split(p + 1, close):
            colon = c.find(x, y, ":")
            ps.append(param(c.slice(x, colon if colon >= 0 else y), c.slice(colon + 1, y) if colon >= 0 else ""))
        full = name + generics + (" " + c.slice(where, j) if where < j else "")
        f = function(full, ps, ret, doc(start), c.line(k), "async" in c.texts(start, k), not public, False, [])
        return f, c.match[j] + 1 if t[j] == "{" else j + 1

    def methods(a: int, b: int, everything: bool) -> list[dict]:
        found, i = [], a
        while i < b:
            start = i
            notes, public, k = head(i)
            if t[k] == "fn":
                f, i = fn(k, start, public, notes)
                if public or everything or include_private:
                    found.append(f)
            else:
                i = c.match[i] + 1 if t[i] in "([{" and c.match[i] < c.n - 1 else max(k, i + 1)
        return found

    i = 0
    while i < c.n - 1:
        start = i
        notes, public, k = head(i)
        x, take = t[k], public or include_private
        if x == "fn":
            f, i = fn(k, start, public, notes)
            if take:
                out["functions"].append(f)
        elif x in ("struct", "enum", "trait") or c.text(k) == "union" and t[k + 1] == "ID":
            name = c.text(k + 1)
            g = c.skip_angle(k + 2)
            generics = c.slice(k + 2, g)
            b = g
            while b < c.n - 1 and t[b] not in ("{", ";") and not (t[b] == "(" and x == "struct"):
                b = c.match[b] + 1 if t[b] in ("(", "[") else b + 1
            colon = c.find(g, b, ":")
            made = class_(name + (generics if x == "trait" else ""), doc(start), [s.strip() for s in c.slice(colon + 1, b).split("+")] if x == "trait" and colon >= 0 and t[g] == ":" else [], [], [], c.line(k))
            if t[b] in ("{", "("):
                for p, q in c.split(b + 1, c.match[b]):
                    _, _, p2 = head(p)
                    if x == "struct" and t[b] == "{":
                        e = c.find(p2, q, ":")
                        if e >= 0:
                            made["class_vars"].append(constant(c.slice(p2, e), c.slice(e + 1, q)))
                    elif x == "struct":
                        made["class_vars"].append(constant(str(len(made["class_vars"])), c.slice(p2, q)))
                    elif x == "enum":
                        made["class_vars"].append(constant(c.slice(p2, q)))
                if x == "trait":
                    made["class_vars"] = []
                    made["methods"] = methods(b + 1, c.match[b], True)
            if take:
                types.setdefault(made["name"], made)
                out["classes"].append(made)
            i = c.match[b] + 1 if t[b] in ("{", "(") else b + 1
            i += t[i] == ";"
        elif x == "impl":
            g = c.skip_angle(k + 1)
            b = c.find(g, c.n - 1, "{")
            if b < 0:
                break
            stop = next((q for q in range(g, b) if t[q] == "where"), b)
            at = next((q for q in range(g, stop) if t[q] == "for"), -1)
            target = c.slice(at + 1 if at >= 0 else g, stop)
            found = methods(b + 1, c.match[b], at >= 0)
            made = types.get(target)
            if made is None and found:
                made = types[target] = class_(target, "", [], [], [], c.line(k))
                out["classes"].append(made)
            if made is not None:
                made["methods"] += found
                if at >= 0:
                    made["bases"].append(c.slice(g, at))
            i = c.match[b] + 1
        elif x in ("const", "static", "type"):
            e = c.find(k, c.n - 1, ";")
            e = c.n - 1 if e < 0 else e
            n = k + 1 + (t[k + 1] == "mut")
            eq, colon = c.find(n, e, "="), c.find(n, e, ":")
            if take:
                out["constants"].append(constant(c.text(n), c.slice(colon + 1, eq if eq >= 0 else e) if colon >= 0 and x != "type" else "type" if x == "type" else "", c.slice(eq + 1, e) if eq >= 0 else ""))
            i = e + 1
        elif x == "use":
            e = c.find(k, c.n - 1, ";")
            e = c.n - 1 if e < 0 else e
            out["imports"].append(c.slice(k + 1, e))
            i = e + 1
        else:
            i = c.match[i] + 1 if t[i] in "([{" and c.match[i] < c.n - 1 else max(k, i + 1)
    return out


_CONTROL = frozenset("if for while switch return sizeof catch else do new delete throw".split())


def parse_cpp(path: str, src: str, include_private: bool = False) -> dict:
    """The module record of a C or C++ file. Bodies of namespaces and conditional sections are not descended into."""
    includes = re.findall(r"(?m)^[ \t]*#[ \t]*include[ \t]*([<\"][^>\"\n]+[>\"])", src)
    blanked = re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\[\s\S])*", lambda m: re.sub(r"[^\n]", " ", m.group()), src)
    c = Cursor(blanked, "cpp")
    out = module(path, "cpp")
    out["imports"] = [unquote(x.strip("<>")) for x in includes]
    t = c.t

    def fn(i: int, p: int, template: str, start: int) -> tuple[dict, int] | None:
        name_at = p - 1
        name = c.text(name_at)
        if t[name_at] != "ID" or name in _CONTROL:
            op = next((q for q in range(max(i, p - 4), p) if c.text(q) == "operator"), -1)
            if op < 0:
                return None
            name, name_at = c.slice(op, p), op
        while name_at - 1 >= i and c.text(name_at - 1) in ("::", "~"):
            step = 2 if c.text(name_at - 1) == "::" else 1
            name = c.slice(name_at - step, name_at) + name
            name_at -= step
        ret = " ".join(x for x in c.slice(i, name_at).split() if x not in ("static", "inline", "virtual", "extern", "constexpr", "explicit", "friend"))
        ps = []
        for x, y in c.split(p + 1, c.match[p]):
            eq = c.find(x, y, "=")
            end = eq if eq >= 0 else y
            names = [k for k in range(x, end) if t[k] == "ID"]
            if c.slice(x, end) in ("", "void"):
                continue
            k = names[-1] if len(names) > 1 or names and names[-1] > x else -1
            if k < 0:
                ps.append(param("", c.slice(x, end)))
            else:
                ps.append(param(c.text(k), " ".join(c.slice(x, k).replace("*", " ").replace("&", " ").split()), c.slice(eq + 1, y) if eq >= 0 else ""))
        j = c.match[p] + 1
        while j < c.n - 1 and t[j] not in ("{", ";"):
            j = c.match[j] + 1 if t[j] == "(" else j + 1
        ret = ret.replace("*", "").replace("&", "").strip()
        f = function((template + " " if template else "") + name, ps, ret, c.doc(start), c.line(name_at), False, False)
        return f, c.match[j] + 1 if t[j] == "{" else j + 1

    def record(i: int, start: int, template: str) -> tuple[dict, int] | None:
        kind = c.text(i)
        b = i + 1
        while b < c.n - 1 and t[b] not in ("{", ";", "(", "="):
            b += 1
        if t[b] != "{":
            return None
        k = i + 1
        k += c.text(k) in ("class", "struct")
        name = c.text(k) if t[k] == "ID" else ""
        colon = c.find(k, b, ":")
        bases = [re.sub(r"^(?:virtual\s+|public\s+|protected\s+|private\s+)+", "", c.slice(x, y)) for x, y in c.split(colon + 1, b)] if colon >= 0 and kind != "enum" else []
        made = class_(name + (template.removeprefix("template").strip() if template else ""), c.doc(start), bases, [], [], c.line(i))
        if kind == "enum":
            made["class_vars"] = [constant(c.text(x), "", c.slice(c.find(x, y, "=") + 1, y) if c.find(x, y, "=") >= 0 else "") for x, y in c.split(b + 1, c.match[b])]
        else:
            body(b + 1, c.match[b], made, "public" if kind == "struct" else "private")
        return made, c.match[b] + 1

    def body(i: int, end: int, owner: dict | None, access: str) -> None:
        while i < end:
            start = i
            x = c.text(i)
            if x in ("public", "private", "protected") and t[i + 1] == ":":
                access, i = x, i + 2
                continue
            if x in (";",):
                i += 1
                continue
            visible = include_private or owner is None or access == "public"
            template = ""
            if x == "template" and t[i + 1] == "<":
                j = c.skip_angle(i + 1)
                template, i = c.slice(i, j), j
                x = c.text(i)
            if x in ("namespace", "extern") and owner is None:
                b = c.find(i, end, "{", ";")
                i = c.match[b] + 1 if b >= 0 and t[b] == "{" else (b + 1 if b >= 0 else end)
                continue
            if x in ("using", "typedef"):
                e = c.find(i, end, ";")
                e = end if e < 0 else e
                if x == "typedef" and c.text(i + 1) in ("struct", "enum", "union"):
                    made = record(i + 1, start, "")
                    if made and visible:
                        made[0]["name"] = made[0]["name"] or c.text(e - 1)
                        out["classes"].append(made[0])
                elif owner is None:
                    eq = c.find(i, e, "=")
                    out["constants"].append(constant(c.text(eq - 1) if eq >= 0 else c.text(e - 1), "type", c.slice(eq + 1, e) if eq >= 0 else c.slice(i + 1, e - 1)))
                i = e + 1
                continue
            if x in ("class", "struct", "union", "enum"):
                made = record(i, start, template)
                if made:
                    if visible and owner is None:
                        out["classes"].append(made[0])
                    i = made[1]
                    e = i
                    while e < end and t[e] != ";" and not c.nl[e]:
                        e += 1
                    i = e + (t[e] == ";")
                    continue
            p = c.find(i, end, "(", ";", "=", "{")
            if p < 0:
                return
            if t[p] == "(" and not (c.text(p - 1) in ("*",)):
                made = fn(i, p, template, start)
                if made:
                    f, stop = made
                    static = "static" in c.texts(i, p)
                    if visible and not (owner is None and static and not include_private):
                        f["is_private"] = owner is not None and access != "public" or owner is None and static
                        (owner["methods"] if owner else out["functions"]).append(f)
                    i = max(stop, i + 1)
                    continue
                i = c.match[p] + 1
                continue
            if t[p] == "{":
                i = c.match[p] + 1
                continue
            e = c.find(p, end, ";")
            e = end if e < 0 else e
            name = c.text(p - 1)
            if t[p - 1] == "ID" and p - 1 > i and visible and not (owner is None and x == "static" and not include_private):
                item = constant(name, " ".join(c.slice(i, p - 1).replace("*", " ").replace("&", " ").split()), c.slice(p + 1, e) if t[p] == "=" else "")
                (owner["class_vars"] if owner else out["constants"]).append(item)
            i = e + 1

    body(0, c.n - 1, None, "public")
    return out
