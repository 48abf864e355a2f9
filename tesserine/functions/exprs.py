"""Scalar functions of the engine as Column builders. Everything stays inside the JVM and its generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserine.config import EXTENSION_TO_LANGUAGE

#: Line ends as Python's splitlines knows them.
LINE_END = "\\R|[\\x1c\\x1d\\x1e]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_or_empty(x: Column | str) -> Column:
    """Null becomes the empty string."""
    return F.coalesce(_c(x), F.lit(""))


def strip(x: Column | str) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.regexp_replace(_c(x), "(?U)^\\s+|\\s+$", "")


def slug(x: Column | str) -> Column:
    """Anchor of a path: lower case, runs of other characters than a-z and 0-9 as one dash, none at the ends. Not injective."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def first_sentence(x: Column | str) -> Column:
    """First line, up to and with its first full stop; blank text gives the empty string."""
    line = F.split(strip(text_or_empty(x)), LINE_END, 2)[0]
    return F.when(F.instr(line, ".") > 0, F.concat(F.substring_index(line, ".", 1), F.lit("."))).otherwise(line)


def path_key(x: Column | str) -> Column:
    """A path without its last suffix; a name that begins with its only dot keeps it."""
    return F.regexp_replace(_c(x), "(?<=[^/])\\.[^./]+$", "")


def path_stem(x: Column | str) -> Column:
    """Last component of a path without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(_c(x), "/"), -1), "(?<=.)\\.[^.]+$", "")


def path_suffix(x: Column | str) -> Column:
    """Lower-case last suffix of a path with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(_c(x), "[^/](\\.[^./]+)$", 1))


def estimate_tokens(x: Column | str) -> Column:
    """Four characters a token, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(_c(x)) / 4)).cast("bigint")


def sha256(x: Column | str) -> Column:
    """Hex digest of the UTF-8 text."""
    return F.sha2(_c(x), 256)


def detect_language(x: Column | str) -> Column:
    """Language of a path by its suffix; null where the suffix is unknown."""
    table = F.create_map(*[F.lit(v) for pair in EXTENSION_TO_LANGUAGE.items() for v in pair])
    return table[path_suffix(x)]


def clean_comment(x: Column | str) -> Column:
    """A comment without its marks: one leading mark a line, the block's opening and closing, and white space."""
    raw = strip(text_or_empty(x))
    raw = F.regexp_replace(F.regexp_replace(raw, "^/\\*\\*?", ""), "\\*/$", "")
    line = lambda s: strip(F.regexp_replace(strip(s), "^(?:///|//!|//|#|\\*+)", ""))
    return strip(F.array_join(F.transform(F.split(raw, LINE_END), line), "\n"))


def params_text(f: Column) -> Column:
    """Parameters of a function: name, "?" when optional, type and default."""
    one = lambda p: F.concat(
        p["name"],
        F.when(p["is_optional"], "?").otherwise(""),
        F.when(p["type_hint"] != "", F.concat(F.lit(": "), p["type_hint"])).otherwise(""),
        F.when(p["default"] != "", F.concat(F.lit(" = "), p["default"])).otherwise(""),
    )
    return F.array_join(F.transform(f["parameters"], one), ", ")


def signature(f: Column) -> Column:
    """Signature of a function."""
    return F.concat(F.when(f["is_async"], "async ").otherwise(""), f["name"], F.lit("("), params_text(f), F.lit(")"), F.when(f["return_type"] != "", F.concat(F.lit(" -> "), f["return_type"])).otherwise(""))


def route_line(r: Column) -> Column:
    """A route as a list item."""
    return F.concat(
        F.lit("- `"), r["method"], F.lit(" "), r["path"], F.lit("`"),
        F.when((r["handler"] != "") & (r["handler"] != "default"), F.concat(F.lit(" → `"), r["handler"], F.lit("`"))).otherwise(""),
        F.when(r["docstring"] != "", F.concat(F.lit(" — "), r["docstring"])).otherwise(""),
    )


def constant_line(c: Column) -> Column:
    """A constant as a list item; values that build a schema stand in for a missing type, cut to 120 characters."""
    value = strip(F.regexp_replace(c["value"], LINE_END, " "))
    short = F.when(F.length(value) > 120, F.concat(F.substring(value, 1, 117), F.lit("..."))).otherwise(value)
    return F.concat(
        F.lit("- `"), c["name"], F.lit("`"),
        F.when(c["type_hint"] != "", F.concat(F.lit(": `"), c["type_hint"], F.lit("`")))
        .when(c["value"].startswith("z.") | c["value"].contains(".partial("), F.concat(F.lit(": `"), short, F.lit("`")))
        .otherwise(""),
    )


def json_list(items: Column) -> Column:
    """An array of strings as JSON, with ", " between the items and characters beyond ASCII escaped."""
    quoted = F.transform(items, lambda s: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(s, "([\"\\\\])", "\\\\$1"), "\n", "\\\\n"), F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def module_parts(with_constants: bool = True) -> Column:
    """The texts of a module that its size estimate counts."""
    none = F.array().cast("array<string>")
    fn = lambda f: F.concat(F.array(f["name"], f["docstring"], f["return_type"]), F.flatten(F.transform(f["parameters"], lambda p: F.array(p["name"], p["type_hint"], p["default"]))))
    cls = lambda c: F.concat(F.array(c["name"], c["docstring"]), c["bases"], F.flatten(F.transform(c["methods"], fn)))
    parts = [F.array("name", "docstring"), F.flatten(F.transform("functions", fn)), F.flatten(F.transform("classes", cls))]
    if with_constants:
        parts.append(F.flatten(F.transform("constants", lambda c: F.array(c["name"], c["type_hint"], c["value"]))))
    return F.concat(*[F.coalesce(p, none) for p in parts])


def module_tokens() -> Column:
    """Estimated tokens of a module."""
    return estimate_tokens(F.array_join(module_parts(), "\n"))


def reference_text() -> Column:
    """What of a module may mention others: docstrings and symbol names, lower case."""
    own = lambda f: F.array(f["name"], f["docstring"])
    cls = lambda c: F.concat(F.array(c["name"], c["docstring"]), F.flatten(F.transform(c["methods"], own)))
    return F.lower(F.array_join(F.concat(F.array("docstring"), F.flatten(F.transform("functions", own)), F.flatten(F.transform("classes", cls)), F.transform("constants", lambda c: c["name"])), " "))


def exports() -> Column:
    """Sorted names of functions, classes and constants."""
    return F.array_sort(F.array_union(F.array_union(F.transform("functions", lambda f: f["name"]), F.transform("classes", lambda c: c["name"])), F.transform("constants", lambda c: c["name"])))
