"""Extractors of languages that declare types with braces: Java, C#, Kotlin, Swift, PHP, Scala, Rust and C++.

They share one walk over declarations: modifiers and annotations, then a type, a function, a property or an import.
"""

from __future__ import annotations

import re

from tesserine.parse.common import Cursor, class_, constant, function, module, param, unquote

# Words of each language.
_TYPES = {
    "java": "class interface enum record @interface",
    "csharp": "class interface struct enum record",
    "kotlin": "class interface object",
    "swift": "class struct enum actor protocol extension",
    "php": "class interface trait enum",
    "scala": "class object trait enum",
}
_MODIFIERS = {
    "java": "public protected private static final abstract synchronized native default strictfp transient volatile sealed non-sealed",
    "csharp": "public protected private internal static readonly sealed abstract virtual override async partial extern unsafe new const volatile event required ref",
    "kotlin": "public protected private internal open abstract final sealed data inner companion override lateinit suspend inline operator infix tailrec external const annotation enum value vararg actual expect",
    "swift": "public private fileprivate internal open static class final override mutating nonmutating lazy weak unowned required convenience indirect async throws isolated nonisolated dynamic optional prefix postfix infix",
    "php": "public protected private static final abstract readonly",
    "scala": "private protected override final sealed abstract implicit lazy case inline open transparent opaque infix given",
}


class Walker:
    """Common state of one file."""

    def __init__(self, path: str, src: str, language: str, include_private: bool) -> None:
        self.c, self.out, self.all, self.language = Cursor(src, language), module(path, language), include_private, language
        self.types = frozenset(_TYPES.get(language, "").split())
        self.modifiers = frozenset(_MODIFIERS.get(language, "").split())
        self.by_name: dict[str, dict] = {}

    def head(self, i: int) -> tuple[list[str], set[str], int]:
        """Annotations and modifiers at ``i``, and where they end."""
        c, notes, mods = self.c, [], set()
        while i < c.n - 1:
            x = c.text(i)
            if x == "@" and c.text(i + 1) != "interface" and self.language != "csharp":
                j = i + 2
                while c.t[j] in (".", ":") and c.t[j + 1] == "ID":
                    j += 2
                if c.t[j] == "(" and not c.nl[j]:
                    j = c.match[j] + 1
                notes.append(c.slice(i, j))
                i = j
            elif c.t[i] == "[" and self.language == "csharp":
                notes.append(c.slice(i + 1, c.match[i]))
                i = c.match[i] + 1
            elif c.t[i] == "#" and c.t[i + 1] == "[" and self.language == "php":
                i = c.match[i + 1] + 1
            elif x in self.modifiers and not (x in ("class", "default", "enum", "case", "new", "const", "event", "annotation", "data", "value", "open") and self._is_name(i)):
                mods.add(x)
                i += 1
                if c.t[i] == "(" and x in ("private", "public", "internal", "fileprivate") and c.text(i + 1) == "set":
                    i = c.match[i] + 1
                elif c.t[i] == "[" and x in ("private", "protected"):
                    i = c.match[i] + 1
            else:
                break
        return notes, mods, i

    def _is_name(self, i: int) -> bool:
        """Whether a word that may be a modifier is a name or a keyword of its own here."""
        x, after = self.c.text(i), self.c.text(i + 1)
        if x == "class":
            return after not in ("func", "var", "let", "override", "final")
        if x == "enum":
            return after != "class"
        if x == "case":
            return after not in ("class", "object")
        if x in ("const",):
            return self.language in ("php",) or self.language == "kotlin" and after not in ("val",)
        return self.c.t[i + 1] in ("(", "=", ".", ":", ";", ",", ")", "{")

    def params(self, a: int, b: int) -> list[dict]:
        """Parameters in [a, b) in the language's form."""
        c, out = self.c, []
        for x, y in c.split(a, b):
            notes, _, x = self.head(x)
            while x < y and c.text(x) in ("final", "var", "val", "ref", "out", "in", "params", "this", "vararg", "inout", "crossinline", "noinline", "mut", "const", "noescape") and y - x > 1 and self.language not in ("rust", "cpp"):
                x += 1
            if x >= y:
                continue
            eq = c.find(x, y, "=")
            end = eq if eq >= 0 else y
            default = c.slice(eq + 1, y) if eq >= 0 else ""
            colon = c.find(x, end, ":")
            if self.language in ("kotlin", "swift", "scala", "rust"):
                if colon < 0:
                    out.append(param(c.slice(x, end), "", default))
                else:
                    out.append(param(c.slice(x, colon), c.slice(colon + 1, end), default))
            else:
                names = [k for k in range(x, end) if c.t[k] == "ID" or c.t[k] not in ("ID",) and c.text(k)[:1] == "$"]
                if not names:
                    continue
                k = names[-1]
                kind = c.slice(x, k)
                out.append(param(c.text(k), kind if k > x else ("" if self.language == "php" else c.text(k)), default))
        return out

    def type_end(self, i: int, stops: tuple[str, ...]) -> int:
        """First token of ``stops`` at or behind ``i``, brackets skipped; angle brackets do not hide stops."""
        c = self.c
        while i < c.n - 1 and c.t[i] not in stops:
            i = c.match[i] + 1 if c.t[i] in ("(", "[") and c.match[i] < c.n - 1 else i + 1
        return i


# Java


def parse_java(path: str, src: str, include_private: bool = False) -> dict:
    """The module record of a Java file; nested types come before their outer one, as Outer.Inner."""
    w = Walker(path, src, "java", include_private)
    c, out = w.c, w.out

    def exported(mods: set[str], inside_interface: bool) -> bool:
        return include_private or inside_interface or bool(mods & {"public", "protected"})

    def types(i: int, end: int, outer: str) -> int:
        begun = i
        notes, mods, i = w.head(i)
        kind = "@interface" if c.text(i) == "@" else c.text(i)
        i += 2 if kind == "@interface" else 1
        name = (outer + "." if outer else "") + c.text(i)
        i = c.skip_angle(i + 1)
        fields, bases, methods = [], [], []
        if c.t[i] == "(":
            for p in w.params(i + 1, c.match[i]):
                fields.append(constant(p["name"], p["type_hint"], ""))
            i = c.match[i] + 1
        brace = c.find(i, end, "{")
        if brace < 0:
            return end
        a = i
        for x, y in _clauses(c, a, brace, ("extends", "implements", "permits")):
            bases += [c.slice(p, q) for p, q in c.split(x, y)]
        stop = c.match[brace]
        j = brace + 1
        if kind == "enum":
            e = c.find(j, stop, ";")
            e = stop if e < 0 else e
            for x, y in c.split(j, e):
                _, _, x = w.head(x)
                if x < y and c.t[x] == "ID":
                    fields.append(constant(c.text(x), "", ""))
            j = e + 1
        while j < stop:
            if c.t[j] in (";", "{"):
                j = c.match[j] + 1 if c.t[j] == "{" else j + 1
                continue
            start = j
            notes_m, mods_m, k = w.head(j)
            if c.text(k) in ("class", "interface", "enum") or c.text(k) == "@" and c.text(k + 1) == "interface" or c.text(k) == "record" and c.t[k + 1] == "ID" and c.t[k + 2] in ("(", "<"):
                j = types(start, stop, name)
                continue
            if c.t[k] == "{":
                j = c.match[k] + 1
                continue
            k = c.skip_angle(k)
            p = c.find(k, stop, "(", "=", ";", "{")
            if p < 0:
                break
            if c.t[p] == "(":
                label = c.text(p - 1)
                close = c.match[p]
                e = c.find(close, stop, "{", ";")
                e = stop if e < 0 else e
                shown = exported(mods_m, kind in ("interface", "@interface"))
                if shown:
                    methods.append(function(label, w.params(p + 1, close), c.slice(k, p - 1), c.doc(start, r"/\*\*"), c.line(p - 1), False, not (mods_m & {"public", "protected"}) and kind not in ("interface", "@interface"), False, notes_m))
                j = c.match[e] + 1 if c.t[e] == "{" else e + 1
            else:
                e = c.find(p, stop, ";")
                e = stop if e < 0 else e
                if exported(mods_m, kind == "interface"):
                    for x, y in c.split(k, e):
                        eq = c.find(x, y, "=")
                        label = c.text((eq if eq >= 0 else y) - 1)
                        hint = c.slice(k, p - 1) if x == k else fields[-1]["type_hint"] if fields else ""
                        fields.append(constant(label, hint, c.slice(eq + 1, y) if eq >= 0 else ""))
                j = e + 1
        if exported(mods, False):
            out["classes"].append(class_(name, c.doc(begun, r"/\*\*"), bases, methods, fields, c.line(begun)))
        return stop + 1

    i = 0
    while i < c.n - 1:
        if c.t[i] in ("package", "import"):
            e = c.find(i, c.n - 1, ";")
            e = i + 1 if e < 0 else e
            if c.t[i] == "import":
                out["imports"].append(re.sub(r"^static\s+", "", c.slice(i + 1, e)))
            elif not out["docstring"]:
                out["docstring"] = c.doc(i, r"/\*\*")
            i = e + 1
            continue
        _, _, k = w.head(i)
        if c.text(k) in ("class", "interface", "enum") or c.text(k) == "@" and c.text(k + 1) == "interface" or c.text(k) == "record" and c.t[k + 1] == "ID":
            i = max(i + 1, types(i, c.n - 1, ""))
        else:
            i = c.match[i] + 1 if c.t[i] in "([{" and c.match[i] < c.n - 1 else max(k, i + 1)
    return out


def _clauses(c: Cursor, a: int, b: int, words) -> list[tuple[int, int]]:
    """Ranges behind each of ``words`` in [a, b), each up to the next."""
    at = [k for k in range(a, b) if c.text(k) in words]
    return [(k + 1, at[n + 1] if n + 1 < len(at) else b) for n, k in enumerate(at)]


# C#


def parse_csharp(path: str, src: str, include_private: bool = False) -> dict:
    """The module record of a C# file; parts of a partial class in one file are merged."""
    w = Walker(path, src, "csharp", include_private)
    c, out = w.c, w.out
    shown = lambda mods: include_private or bool(mods & {"public", "protected"})

    def doc(i: int) -> str:
        return re.sub(r"</?\w+[^>]*>", "", c.doc(i, r"///|/\*\*")).strip()

    def members(j: int, stop: int, kind: str, k: dict) -> None:
        while j < stop:
            if c.t[j] == ";":
                j += 1
                continue
            start = j
            notes, mods, i = w.head(j)
            visible = shown(mods) or kind == "interface"
            if c.text(i) in w.types and c.t[i + 1] == "ID":
                e = c.find(i, stop, "{", ";")
                j = (c.match[e] + 1 if e >= 0 and c.t[e] == "{" else e + 1) if e >= 0 else stop
                continue
            p = c.find(c.skip_angle(i), stop, "(", "{", "=", ";", "=>")
            if p < 0:
                return
            label = c.text(p - 1)
            if c.t[p] == "(":
                close = c.match[p]
                e = c.find(close + 1, stop, "{", ";", "=>")
                e = stop if e < 0 else e
                name_at = p - 1
                generic = ""
                if c.t[p - 1] == ">":
                    name_at = p - 1
                    while name_at > i and c.t[name_at] != "<":
                        name_at -= 1
                    generic, name_at = c.slice(name_at, p), name_at - 1
                    label = c.text(name_at)
                where = c.slice(close + 1, e) if c.text(close + 1) == "where" else ""
                if visible and name_at > i:
                    k["methods"].append(function(label + generic + (" " + where if where else ""), w.params(p + 1, close), c.slice(i, name_at), doc(start), c.line(name_at), "async" in mods, not visible, False, notes))
                if c.t[e] == "=>":
                    e = c.find(e, stop, ";")
                    e = stop if e < 0 else e
                j = c.match[e] + 1 if c.t[e] == "{" else e + 1
            elif c.t[p] in ("{", "=>"):
                if visible:
                    k["methods"].append(function(label, [], c.slice(i, p - 1), doc(start), c.line(p - 1), False, not visible, True, [*notes, *(["event"] if "event" in mods else [])]))
                e = c.match[p] + 1 if c.t[p] == "{" else c.find(p, stop, ";") + 1
                if c.t[p] == "{" and c.t[e] == "=":
                    e = c.find(e, stop, ";") + 1
                j = max(e, p + 1)
            else:
                e = c.find(p, stop, ";")
                e = stop if e < 0 else e
                if visible:
                    if "event" in mods:
                        k["methods"].append(function(label, [], c.slice(i, p - 1), doc(start), c.line(p - 1), False, False, True, [*notes, "event"]))
                    else:
                        k["class_vars"].append(constant(label, c.slice(i, p - 1), c.slice(p + 1, e) if c.t[p] == "=" else ""))
                j = e + 1

    def space(i: int, end: int) -> None:
        while i < end:
            start = i
            notes, mods, k = w.head(i)
            x = c.text(k)
            if x == "using":
                e = c.find(k, end, ";")
                e = k + 1 if e < 0 else e
                if c.t[k + 1] != "(":
                    out["imports"].append(re.sub(r"^(?:static\s+|\w+\s*=\s*)", "", c.slice(k + 1, e)))
                i = e + 1
            elif x == "namespace":
                e = c.find(k, end, "{", ";")
                if e >= 0 and c.t[e] == "{":
                    space(e + 1, c.match[e])
                    i = c.match[e] + 1
                else:
                    i = e + 1 if e >= 0 else end
            elif x in w.types and c.t[k + 1] in ("ID", "class", "struct"):
                kind = x
                k += 1 + (c.t[k + 1] in ("class", "struct"))
                name = c.text(k)
                g = c.skip_angle(k + 1)
                generic = c.slice(k + 1, g)
                e = c.find(g, end, "{", ";")
                if e < 0:
                    return
                fields = []
                if c.t[g] == "(":
                    fields = [constant(p["name"], p["type_hint"], p["default"]) for p in w.params(g + 1, c.match[g])]
                    g = c.match[g] + 1
                where = c.find(g, e, "where")
                where = next((q for q in range(g, e) if c.text(q) == "where"), e)
                bases = [c.slice(p, q) for p, q in c.split(g + 1, where)] if c.t[g] == ":" else []
                full = name + generic + (" " + c.slice(where, e) if where < e else "")
                if shown(mods):
                    known = w.by_name.get(full) if "partial" in mods else None
                    made = known or class_(full, doc(start), bases, [], [], c.line(start))
                    made["class_vars"] += fields
                    if c.t[e] == "{":
                        if kind == "enum":
                            made["class_vars"] += [constant(c.text(w.head(p)[2]), "", c.slice(c.find(p, q, "=") + 1, q) if c.find(p, q, "=") >= 0 else "") for p, q in c.split(e + 1, c.match[e])]
                        else:
                            members(e + 1, c.match[e], kind, made)
                    if known is None:
                        out["classes"].append(made)
                        w.by_name[full] = made
                i = c.match[e] + 1 if c.t[e] == "{" else e + 1
            else:
                i = c.match[i] + 1 if c.t[i] in "([{" and c.match[i] < c.n - 1 else max(k, i + 1)

    space(0, c.n - 1)
    return out


# Kotlin


def parse_kotlin(path: str, src: str, include_private: bool = False) -> dict:
    """The module record of a Kotlin file; companions merge into their class, nested types become Outer.Inner."""
    w = Walker(path, src, "kotlin", include_private)
    c, out = w.c, w.out
    hidden = lambda mods: bool(mods & {"private", "internal"})

    def fun(i: int, start: int, notes, mods) -> tuple[dict, int]:
        i = c.skip_angle(i + 1)
        p = c.find(i, c.n - 1, "(")
        p = i if p < 0 else p
        close = c.match[p]
        j, ret = close + 1, ""
        if c.t[j] == ":":
            e = j + 1
            while e < c.n - 1 and c.t[e] not in ("{", "=", "}", ";") and not (c.nl[e] and e > j + 1):
                e = c.match[e] + 1 if c.t[e] in ("(", "[") else e + 1
            ret, j = c.slice(j + 1, e), e
        end = c.match[j] + 1 if c.t[j] == "{" else _expression_end(c, j)
        return function(c.slice(i, p), w.params(p + 1, close), ret, c.doc(start, r"/\*\*"), c.line(p - 1), "suspend" in mods, hidden(mods), False, [x.lstrip("@") for x in notes]), end

    def prop(i: int) -> tuple[dict, int]:
        j = i + 1
        e = j
        while e < c.n - 1 and not (c.nl[e] and e > j) and c.t[e] not in ("}", ";"):
            e = c.match[e] + 1 if c.t[e] in "([{" and c.match[e] < c.n - 1 else e + 1
        eq, colon = c.find(j, e, "="), c.find(j, e, ":")
        name_end = min(x for x in (eq, colon, e) if x >= 0)
        return constant(c.slice(j, name_end), c.slice(colon + 1, eq if eq > colon else e) if 0 <= colon and (eq < 0 or colon < eq) else "", c.slice(eq + 1, e) if eq >= 0 else ""), e

    def body(i: int, end: int, owner: dict | None, prefix: str) -> None:
        while i < end:
            start = i
            notes, mods, k = w.head(i)
            x = c.text(k)
            if x in ("import", "package") and owner is None:
                e = k + 1
                while e < end and not c.nl[e]:
                    e += 1
                if x == "import":
                    out["imports"].append(c.slice(k + 1, e))
                i = e
            elif x == "fun" and c.text(k + 1) != "interface":
                f, i = fun(k, start, notes, mods)
                if include_private or not f["is_private"]:
                    (owner["methods"] if owner else out["functions"]).append(f)
            elif x in ("val", "var"):
                v, i = prop(k)
                if include_private or not hidden(mods):
                    (owner["class_vars"] if owner else out["constants"]).append(v)
            elif x in ("class", "interface", "object") or x == "fun":
                k += x == "fun"
                named = c.t[k + 1] == "ID" and not c.nl[k + 1]
                name = prefix + (c.text(k + 1) if named else "Companion")
                companion = "companion" in mods
                g = c.skip_angle(k + 1 + named)
                made = owner if companion and owner else class_(name, c.doc(start, r"/\*\*"), [], [], [], c.line(start))
                _, _, g = w.head(g)
                g += c.text(g) == "constructor"
                if c.t[g] == "(" and not companion:
                    for p, q in c.split(g + 1, c.match[g]):
                        _, m2, p2 = w.head(p)
                        if c.text(p2) in ("val", "var") and (include_private or not hidden(m2)):
                            colon, eq = c.find(p2, q, ":"), c.find(p2, q, "=")
                            made["class_vars"].append(constant(c.slice(p2 + 1, colon if colon >= 0 else q), c.slice(colon + 1, eq if eq >= 0 else q) if colon >= 0 else "", c.slice(eq + 1, q) if eq >= 0 else ""))
                    g = c.match[g] + 1
                b = g
                while b < end and c.t[b] != "{" and not (c.nl[b] and c.t[b] not in (":", ",") and c.t[b - 1] not in (":", ",")):
                    b = c.match[b] + 1 if c.t[b] in ("(", "[") and c.match[b] < c.n - 1 else b + 1
                if c.t[g] == ":" and not companion:
                    made["bases"] = [c.slice(p, q) for p, q in c.split(g + 1, b)]
                keep = include_private or not hidden(mods)
                if keep and not (companion and owner):
                    out["classes"].append(made)
                if b < end and c.t[b] == "{":
                    j = b + 1
                    if "enum" in mods or c.text(k - 1) == "enum":
                        e = c.find(j, c.match[b], ";")
                        e = c.match[b] if e < 0 else e
                        made["class_vars"] += [constant(c.text(w.head(p)[2])) for p, q in c.split(j, e) if p < q]
                        j = e + 1
                    if keep:
                        body(j, c.match[b], made, prefix if companion else name + ".")
                    i = c.match[b] + 1
                else:
                    i = max(b, k + 1)
            else:
                i = c.match[i] + 1 if c.t[i] in "([{" and c.match[i] < c.n - 1 else max(k, i + 1)

    body(0, c.n - 1, None, "")
    first = next((b for b, e in c.k.comments if src[b:e].startswith("/**")), None)
    if first is not None and not src[:first].strip():
        from tesserine.parse.common import clean_comment

        e = next(e for b, e in c.k.comments if b == first)
        if re.match(r"\s*(?:package|import)\b", src[e:]):
            out["docstring"] = clean_comment(src[first:e])
    return out


def _expression_end(c: Cursor, i: int) -> int:
    """Behind an expression body that begins at ``i``."""
    e = i + 1 if c.t[i] == "=" else i
    while e < c.n - 1 and not (c.nl[e] and e > i + 1 and c.t[e] not in (".", "?.", "?:")) and c.t[e] not in ("}",):
        e = c.match[e] + 1 if c.t[e] in "([{" and c.match[e] < c.n - 1 else e + 1
    return e


# Swift


def parse_swift(path: str, src: str, include_private: bool = False) -> dict:
    """The module record of a Swift file; extensions of a type seen earlier merge into it."""
    w = Walker(path, src, "swift", include_private)
    c, out = w.c, w.out
    hidden = lambda mods: bool(mods & {"private", "fileprivate"})

    def fun(k: int, start: int, notes, mods, name: str | None = None) -> tuple[dict, int]:
        p = c.find(c.skip_angle(k + 2) if name is None else k, c.n - 1, "(")
        p = k + 1 if p < 0 else p
        label = name or c.text(k + 1)
        close = c.match[p]
        j = close + 1
        effects = []
        while c.text(j) in ("async", "throws", "rethrows"):
            effects.append(c.text(j))
            j += 1
        ret = ""
        if c.t[j] == "->":
            e = j + 1
            while e < c.n - 1 and c.t[e] != "{" and not c.nl[e] and c.text(e) != "where":
                e = c.match[e] + 1 if c.t[e] in ("(", "[") else e + 1
            ret, j = c.slice(j + 1, e), e
        if "throws" in effects:
            ret = "throws -> " + ret if ret else "throws"
        while j < c.n - 1 and c.t[j] != "{" and not c.nl[j] and c.t[j] != "}":
            j += 1
        end = c.match[j] + 1 if c.t[j] == "{" else j
        return function(label, w.params(p + 1, close), ret, c.doc(start, r"///|/\*\*"), c.line(k), "async" in effects, hidden(mods), False, [x for x in notes]), end

    def body(i: int, end: int, owner: dict | None) -> None:
        while i < end:
            start = i
            notes, mods, k = w.head(i)
            x = c.text(k)
            if x == "import" and owner is None:
                out["imports"].append(c.text(k + 1))
                i = k + 2
            elif x == "func" or x == "init" and owner is not None or x == "macro":
                f, i = fun(k, start, ["@macro", *notes] if x == "macro" else notes, mods, "init" if x == "init" else None)
                if include_private or not f["is_private"]:
                    (owner["methods"] if owner else out["functions"]).append(f)
            elif x in ("let", "var"):
                e = k + 1
                while e < end and not (c.nl[e] and e > k + 1) and c.t[e] not in ("}", ";"):
                    e = c.match[e] + 1 if c.t[e] in "([{" and c.match[e] < c.n - 1 else e + 1
                eq, colon, brace = c.find(k, e, "="), c.find(k, e, ":"), c.find(k, e, "{")
                stop = min(x2 for x2 in (eq, brace, e) if x2 >= 0)
                hint = c.slice(colon + 1, stop) if 0 <= colon < stop else ""
                if include_private or not hidden(mods):
                    if owner is not None:
                        owner["methods"].append(function(c.text(k + 1), [], hint, c.doc(start, r"///|/\*\*"), c.line(k), False, hidden(mods), True, notes))
                    else:
                        out["constants"].append(constant(c.text(k + 1), hint, c.slice(eq + 1, e) if eq >= 0 else ""))
                i = e
            elif x == "case" and owner is not None:
                e = k + 1
                while e < end and not (c.nl[e] and e > k + 1):
                    e = c.match[e] + 1 if c.t[e] == "(" else e + 1
                owner["class_vars"] += [constant(c.slice(p, q)) for p, q in c.split(k + 1, e)]
                i = e
            elif x in w.types and c.t[k + 1] == "ID":
                name = c.text(k + 1)
                b = c.find(k, end, "{")
                if b < 0:
                    return
                g = c.skip_angle(k + 2)
                colon = c.find(g, b, ":")
                stop = next((q for q in range(g, b) if c.text(q) == "where"), b)
                bases = [c.slice(p, q) for p, q in c.split(colon + 1, stop)] if colon >= 0 else []
                known = w.by_name.get(name) if x == "extension" else None
                made = known or class_(f"extension {name}" if x == "extension" else name, c.doc(start, r"///|/\*\*"), bases, [], [], c.line(start))
                if known is not None:
                    known["bases"] += bases
                if include_private or not hidden(mods):
                    if known is None:
                        out["classes"].append(made)
                        if x != "extension":
                            w.by_name[name] = made
                    body(b + 1, c.match[b], made)
                i = c.match[b] + 1
            else:
                i = c.match[i] + 1 if c.t[i] in "([{" and c.match[i] < c.n - 1 else max(k, i + 1)

    body(0, c.n - 1, None)
    return out


# PHP


def parse_php(path: str, src: str, include_private: bool = False) -> dict:
    """The module record of a PHP file."""
    opened = re.search(r"<\?php|<\?=", src)
    blanked = (" " * opened.end() + src[opened.end() :]) if opened else src
    w = Walker(path, blanked, "php", include_private)
    c, out = w.c, w.out
    shown = lambda mods: include_private or not mods & {"private", "protected"}

    def fun(k: int, start: int, mods) -> tuple[dict, int]:
        k += 1 + (c.t[k + 1] == "&")
        p = k + 1
        close = c.match[p]
        j, ret = close + 1, ""
        if c.t[j] == ":":
            e = c.find(j, c.n - 1, "{", ";")
            e = c.n - 1 if e < 0 else e
            ret, j = c.slice(j + 1, e), e
        end = c.match[j] + 1 if c.t[j] == "{" else j + 1
        return function(c.text(k), w.params(p + 1, close), ret, c.doc(start, r"/\*\*"), c.line(k), False, not shown(mods)), end

    def body(i: int, end: int, owner: dict | None) -> None:
        while i < end:
            start = i
            notes, mods, k = w.head(i)
            x = c.text(k).lower()
            if x == "function" and c.t[k + 1] in ("ID", "&"):
                f, i = fun(k, start, mods)
                if shown(mods):
                    (owner["methods"] if owner else out["functions"]).append(f)
            elif x in w.types and c.t[k + 1] == "ID" and c.t[k - 1] != "::":
                b = c.find(k, end, "{")
                if b < 0:
                    return
                made = class_(c.text(k + 1), c.doc(start, r"/\*\*"), [], [], [], c.line(k))
                if x != "interface":
                    made["bases"] = [c.slice(p, q) for a, z in _clauses(c, k, b, ("extends", "implements")) for p, q in c.split(a, z) if "\\" not in c.slice(p, q)]
                out["classes"].append(made)
                body(b + 1, c.match[b], made)
                i = c.match[b] + 1
            elif x == "const":
                e = c.find(k, end, ";")
                e = end if e < 0 else e
                eq = c.find(k, e, "=")
                if eq >= 0 and shown(mods):
                    (owner["class_vars"] if owner else out["constants"]).append(constant(c.text(eq - 1), c.slice(k + 1, eq - 1), c.slice(eq + 1, e)))
                i = e + 1
            elif x == "case" and owner is not None:
                e = c.find(k, end, ";")
                e = end if e < 0 else e
                owner["class_vars"].append(constant(c.text(k + 1), "", c.slice(k + 3, e)))
                i = e + 1
            elif owner is not None and (mods or x == "var"):
                e = c.find(k, end, ";")
                e = end if e < 0 else e
                eq = c.find(k, e, "=")
                name = c.text((eq if eq >= 0 else e) - 1)
                if name.startswith("$") and shown(mods):
                    owner["class_vars"].append(constant(name, c.slice(k, (eq if eq >= 0 else e) - 1), c.slice(eq + 1, e) if eq >= 0 else ""))
                i = e + 1
            elif x == "namespace" and owner is None:
                e = c.find(k, end, "{", ";")
                if e >= 0 and c.t[e] == "{":
                    body(e + 1, c.match[e], None)
                    i = c.match[e] + 1
                else:
                    i = e + 1 if e >= 0 else end
            elif x in ("use", "require", "require_once", "include", "include_once") and owner is None:
                e = c.find(k, end, ";")
                e = end if e < 0 else e
                out["imports"].append(unquote(c.slice(k + 1, e).strip("() ")))
                i = e + 1
            else:
                i = c.match[i] + 1 if c.t[i] in "([{" and c.match[i] < c.n - 1 else max(k, i + 1)

    if c.n > 1:
        first = next(((b, e) for b, e in c.k.comments if blanked[b:e].startswith("/**")), None)
        if first and not blanked[: first[0]].strip() and re.match(r"\s*\n\s*\n|\s*(?:namespace|declare|use)\b", blanked[first[1] :]):
            from tesserine.parse.common import clean_comment

            out["docstring"] = clean_comment(blanked[first[0] : first[1]])
    body(0, c.n - 1, None)
    return out


# Scala


def parse_scala(path: str, src: str, include_private: bool = False) -> dict:
    """The module record of a Scala file; a class and its companion object are one."""
    w = Walker(path, src, "scala", include_private)
    c, out = w.c, w.out
    hidden = lambda mods: bool(mods & {"private", "protected"})

    def clauses(i: int) -> tuple[list[dict], int]:
        ps: list[dict] = []
        while c.t[i] in ("(", "["):
            if c.t[i] == "(":
                a, mark = i + 1, ""
                if c.text(a) in ("using", "implicit"):
                    mark, a = c.text(a) + " ", a + 1
                ps += [p | {"name": mark + p["name"]} for p in w.params(a, c.match[i])]
            i = c.match[i] + 1
        return ps, i

    def definition(k: int, start: int, mods, prefix: str = "") -> tuple[dict, int]:
        ps, j = clauses(k + 2)
        ret = ""
        if c.t[j] == ":":
            e = j + 1
            while e < c.n - 1 and c.t[e] not in ("=", "{", "}") and not (c.nl[e] and e > j + 1):
                e = c.match[e] + 1 if c.t[e] in ("(", "[") else e + 1
            ret, j = c.slice(j + 1, e), e
        if c.t[j] == "=":
            j += 1
            end = c.match[j] + 1 if c.t[j] == "{" else _expression_end(c, j)
        else:
            end = c.match[j] + 1 if c.t[j] == "{" else j
        return function(prefix + c.text(k + 1), ps, ret, c.doc(start, r"/\*\*"), c.line(k), False, hidden(mods)), max(end, k + 2)

    def value(k: int) -> tuple[dict, int]:
        e = k + 1
        while e < c.n - 1 and not (c.nl[e] and e > k + 1) and c.t[e] != "}":
            e = c.match[e] + 1 if c.t[e] in "([{" and c.match[e] < c.n - 1 else e + 1
        eq, colon = c.find(k, e, "="), c.find(k, e, ":")
        return constant(c.text(k + 1), c.slice(colon + 1, eq if eq > colon else e) if 0 <= colon and (eq < 0 or colon < eq) else "", c.slice(eq + 1, e) if eq >= 0 else ""), e

    def body(i: int, end: int, owner: dict | None) -> None:
        while i < end:
            start = i
            notes, mods, k = w.head(i)
            x = c.text(k)
            visible = include_private or not hidden(mods)
            if x == "import":
                e = k + 1
                while e < end and not c.nl[e]:
                    e = c.match[e] + 1 if c.t[e] == "{" else e + 1
                out["imports"].append(c.slice(k + 1, e))
                i = e
            elif x == "def":
                f, i = definition(k, start, mods)
                if visible:
                    (owner["methods"] if owner else out["functions"]).append(f)
            elif x in ("val", "var"):
                v, i = value(k)
                if visible:
                    (owner["class_vars"] if owner else out["constants"]).append(v)
            elif x == "extension" and c.t[k + 1] in ("(", "["):
                p = k + 1
                while c.t[p] == "[":
                    p = c.match[p] + 1
                who = c.slice(p, c.match[p] + 1)
                j = c.match[p] + 1
                stop = c.match[j] if c.t[j] == "{" else end
                j += c.t[j] == "{"
                _, m2, j = w.head(j)
                while j < stop and c.text(j) == "def":
                    f, j = definition(j, j, m2, f"extension {who} ")
                    if include_private or not hidden(m2):
                        (owner["methods"] if owner else out["functions"]).append(f)
                    _, m2, j2 = w.head(j)
                    if c.text(j2) != "def" or c.t[k] == "{" and j2 >= stop:
                        break
                    j = j2
                i = max(j, k + 1)
            elif x in w.types and c.t[k + 1] == "ID":
                name = c.text(k + 1)
                g = k + 2
                while c.t[g] == "[":
                    g = c.match[g] + 1
                fields, case = [], "case" in mods
                while c.t[g] == "(":
                    if c.t[g] == "(":
                        for p, q in c.split(g + 1, c.match[g]):
                            _, m2, p2 = w.head(p)
                            declared = c.text(p2) in ("val", "var")
                            if case or declared:
                                p2 += declared
                                colon, eq = c.find(p2, q, ":"), c.find(p2, q, "=")
                                if include_private or not hidden(m2):
                                    fields.append(constant(c.slice(p2, colon if colon >= 0 else q), c.slice(colon + 1, eq if eq >= 0 else q) if colon >= 0 else "", c.slice(eq + 1, q) if eq >= 0 else ""))
                    g = c.match[g] + 1
                b = g
                while b < end and c.t[b] not in ("{", "}") and not (c.nl[b] and c.text(b) not in ("extends", "with", "derives")) and not (c.t[b] == ":" and c.nl[b + 1]):
                    b = c.match[b] + 1 if c.t[b] in ("(", "[") and c.match[b] < c.n - 1 else b + 1
                bases = [c.slice(p, q) for a, z in _clauses(c, g, b, ("extends", "with")) for p, q in c.split(a, z)]
                known = w.by_name.get(name)
                made = known or class_(name, c.doc(start, r"/\*\*"), bases, [], [], c.line(start))
                if known is not None:
                    if x != "object":
                        known["bases"], known["line"] = bases or known["bases"], c.line(start)
                    known["docstring"] = known["docstring"] or c.doc(start, r"/\*\*")
                made["class_vars"] += fields
                if visible:
                    if known is None:
                        out["classes"].append(made)
                        w.by_name[name] = made
                    if b < end and c.t[b] == "{":
                        if x == "enum":
                            for a in range(b + 1, c.match[b]):
                                if c.t[a] == "case":
                                    made["class_vars"] += [constant(c.text(p)) for p, q in c.split(a + 1, next((z for z in range(a + 1, c.match[b]) if c.nl[z]), c.match[b])) if c.t[p] == "ID"]
                        body(b + 1, c.match[b], made)
                i = c.match[b] + 1 if b < end and c.t[b] == "{" else max(b, k + 1)
            elif x == "given" or "given" in mods and c.t[k] == "ID":
                k = k if "given" in mods else k + 1
                e = k
                while e < end and not (c.nl[e] and e > k) and c.t[e] not in ("=", "{"):
                    e += 1
                colon = c.find(k, e, ":")
                out["functions"].append(function("given " + (c.slice(k, colon) if colon >= 0 else c.slice(k, e)), [], c.slice(colon + 1, e).removesuffix("with").strip() if colon >= 0 else "", c.doc(start, r"/\*\*"), c.line(k), False, hidden(mods)))
                i = c.match[e] + 1 if c.t[e] == "{" else _expression_end(c, e)
            else:
                i = c.match[i] + 1 if c.t[i] in "([{" and c.match[i] < c.n - 1 else max(k, i + 1)

    body(0, c.n - 1, None)
    return out
