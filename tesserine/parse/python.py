"""Python extractor, by the interpreter's own parser; a line scanner reads files that it rejects."""

from __future__ import annotations

import ast
import re
import warnings

from tesserine.parse.common import class_, constant, function, module, param, route

_VERBS = frozenset("get post put delete patch options head trace".split())


def _private(name: str) -> bool:
    return name.startswith("_") and not name.startswith("__")


def parse(path: str, src: str, include_private: bool = False) -> dict:
    """The module record of a Python file."""
    out = module(path, "python")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(src)
    except (SyntaxError, ValueError, RecursionError):
        return _scan(out, src, include_private)
    seg = lambda n: (ast.get_source_segment(src, n) or ast.unparse(n)) if n is not None else ""
    out["docstring"] = _doc(tree)

    def fn(n) -> dict:
        a = n.args
        ps, pos = [], [*a.posonlyargs, *a.args]
        defaults = [None] * (len(pos) - len(a.defaults)) + list(a.defaults)
        for p, d in zip(pos, defaults):
            ps.append(param(p.arg, seg(p.annotation), seg(d), False))
        if a.vararg:
            ps.append(param("*" + a.vararg.arg, seg(a.vararg.annotation)))
        for p, d in zip(a.kwonlyargs, a.kw_defaults):
            ps.append(param(p.arg, seg(p.annotation), seg(d), False))
        if a.kwarg:
            ps.append(param("**" + a.kwarg.arg, seg(a.kwarg.annotation)))
        decorators = [seg(d) for d in n.decorator_list]
        return function(n.name, ps, seg(n.returns), _doc(n), n.lineno, isinstance(n, ast.AsyncFunctionDef), _private(n.name), any(d == "property" or d.endswith(".setter") for d in decorators), decorators)

    def assigned(n) -> list[dict]:
        if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name):
            return [constant(n.target.id, seg(n.annotation), seg(n.value))]
        if isinstance(n, ast.Assign):
            return [constant(t.id, "", seg(n.value)) for t in n.targets if isinstance(t, ast.Name)]
        return []

    def found(n, doc: str, name: str) -> None:
        for d in n.decorator_list:
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute):
                verb = d.func.attr
                where = next((a.value for a in d.args if isinstance(a, ast.Constant) and isinstance(a.value, str)), None)
                where = where if where is not None else next((k.value.value for k in d.keywords if k.arg == "path" and isinstance(k.value, ast.Constant)), None)
                if where is None:
                    continue
                if verb in _VERBS:
                    out["routes"].append(route(verb.upper(), where, name, n.lineno, doc))
                elif verb == "route":
                    listed = next((k.value for k in d.keywords if k.arg == "methods"), None)
                    methods = [e.value for e in listed.elts if isinstance(e, ast.Constant)] if isinstance(listed, (ast.List, ast.Tuple)) else ["GET"]
                    out["routes"] += [route(str(m).upper(), where, name, n.lineno, doc) for m in methods]

    for n in tree.body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            f = fn(n)
            found(n, f["docstring"], n.name)
            if include_private or not f["is_private"]:
                out["functions"].append(f)
        elif isinstance(n, ast.ClassDef):
            methods = [fn(x) for x in n.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
            variables = [c for x in n.body for c in assigned(x)]
            if include_private or not _private(n.name):
                out["classes"].append(class_(n.name, _doc(n), [seg(b) for b in n.bases], [m for m in methods if include_private or not m["is_private"]], variables, n.lineno))
        elif isinstance(n, (ast.Assign, ast.AnnAssign)):
            out["constants"] += assigned(n)
        elif isinstance(n, ast.Import):
            out["imports"] += [a.name for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out["imports"].append("." * n.level + (n.module or ""))
    for n in ast.walk(tree):
        key = None
        if isinstance(n, ast.Subscript) and ast.unparse(n.value) == "os.environ":
            key = n.slice
        elif isinstance(n, ast.Call) and ast.unparse(n.func) in ("os.environ.get", "os.getenv") and n.args:
            key = n.args[0]
        if isinstance(key, ast.Constant) and isinstance(key.value, str):
            out["env_vars"].setdefault(key.value, [path])
    return out


def _doc(n) -> str:
    first = n.body[0] if n.body else None
    if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
        return first.value.value.strip()
    return ""


def _scan(out: dict, src: str, include_private: bool) -> dict:
    """What single lines tell of a file that does not parse."""
    owner = None
    for i, line in enumerate(src.split("\n"), 1):
        m = re.match(r"(\s*)(async\s+)?def\s+(\w+)\s*\((.*?)\)?\s*(?:->\s*([^:]+))?:?\s*$", line)
        if m:
            ps = [param(p.split("=")[0].split(":")[0].strip(), p.split("=")[0].partition(":")[2].strip(), p.partition("=")[2].strip()) for p in m.group(4).split(",") if p.strip()]
            f = function(m.group(3), ps, (m.group(5) or "").strip(), "", i, bool(m.group(2)), _private(m.group(3)))
            if include_private or not f["is_private"]:
                (owner["methods"] if m.group(1) and owner else out["functions"]).append(f)
            continue
        m = re.match(r"class\s+(\w+)\s*(?:\(([^)]*)\))?", line)
        if m:
            owner = class_(m.group(1), "", [b.strip() for b in (m.group(2) or "").split(",") if b.strip()], [], [], i)
            out["classes"].append(owner)
            continue
        m = re.match(r"(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", line)
        if m:
            out["imports"].append(m.group(1) or m.group(2))
        m = re.match(r"([A-Za-z_]\w*)\s*(?::\s*([^=]+))?=\s*(\S.*)$", line)
        if m:
            out["constants"].append(constant(m.group(1), (m.group(2) or "").strip(), m.group(3).strip()))
    return out
