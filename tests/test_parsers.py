"""Extractors on own fixture files: names, visibility, documentation, and both visibility settings."""

from pathlib import Path

import pytest

from tesserine.config import EXTENSION_TO_LANGUAGE
from tesserine.parse.udtf import REGISTERED, parse_file, parse_modules, register_parser, register_sql

FIXTURES = Path(__file__).parent / "fixtures"


def parsed(name, private=False):
    return parse_file(name, (FIXTURES / name).read_text(), EXTENSION_TO_LANGUAGE["." + name.rsplit(".", 1)[1]], private)


def names(items):
    return [x["name"] for x in items]


def cls(m, name):
    return next(c for c in m["classes"] if c["name"] == name)


def test_java():
    m = parsed("Shop.java")
    assert names(m["classes"]) == ["Shop.Shelf", "Shop", "Color", "Point"]  # nested before outer, Closed is not exported
    shop = cls(m, "Shop")
    assert shop["bases"] == ["Base", "Closeable", "Runnable"] and names(shop["methods"]) == ["Shop", "sell"]
    assert shop["methods"][1]["decorators"] == ["@Override"] and shop["methods"][1]["docstring"] == "Sells."
    assert names(shop["class_vars"]) == ["LIMIT", "OTHER", "items"]
    assert m["imports"] == ["java.util.List", "org.corp.Util.max"]
    assert "internal" in names(cls(parsed("Shop.java", True), "Shop")["methods"])


def test_csharp():
    m = parsed("Shop.cs")
    shop = m["classes"][0]
    assert shop["name"] == "Shop<T> where T : class" and shop["docstring"] == "A shop."
    assert names(shop["methods"]) == ["Name", "Sold", "SellAsync<R> where R : new()", "Twice"]
    assert shop["methods"][0]["is_property"] and "event" in shop["methods"][1]["decorators"] and shop["methods"][2]["is_async"]
    assert "Inner" not in names(m["classes"])


def test_rust():
    m = parsed("shop.rs")
    assert m["docstring"] == "Shop crate." and names(m["functions"]) == ["run<T: Into<String>> where T: Send"]
    assert names(cls(m, "Shop")["methods"]) == ["new", "sell"] and cls(m, "Shop")["methods"][1]["is_private"]
    assert names(cls(m, "Seller<T>")["methods"]) == ["sell", "twice"]
    assert names(m["constants"]) == ["LIMIT", "Alias"]


def test_cpp():
    m = parsed("shop.cpp")
    assert names(m["functions"]) == ["template <typename T> twice", "total"]
    assert names(cls(m, "Shop")["methods"]) == ["Shop", "sell", "operator+="] and m["imports"] == ["vector", "util.h"]


def test_scala():
    m = parsed("Shop.scala")
    shop = cls(m, "Shop")
    assert names(shop["methods"]) == ["sell", "apply"] and names(shop["class_vars"]) == ["name", "limit"]
    assert names(shop["methods"][0]["parameters"])[-1] == "implicit ctx"
    assert names(cls(m, "Tools")["methods"]) == ["extension (s: String) shout"]
    assert names(m["functions"]) == ["given ordering", "topLevel"]


def test_kotlin():
    m = parsed("Shop.kt")
    assert m["docstring"] == "Shop file." and names(m["classes"]) == ["Shop", "Shop.Shelf", "Seller", "Color", "Tools"]
    assert names(cls(m, "Shop")["methods"]) == ["sell", "kept", "make"] and cls(m, "Shop")["methods"][0]["is_async"]
    assert names(m["functions"]) == ["String.shout"] and cls(m, "Seller")["methods"][0]["return_type"] == "Int"


def test_swift():
    m = parsed("Shop.swift")
    shop = cls(m, "Shop")
    assert names(shop["methods"]) == ["name", "init", "sell", "more"] and shop["methods"][2]["return_type"] == "throws -> Bool"
    assert "extension Array" in names(m["classes"]) and cls(m, "Bank")["methods"][0]["is_async"]


def test_php():
    m = parsed("Shop.php")
    shop = cls(m, "Shop")
    assert names(shop["methods"]) == ["sell", "make"] and names(shop["class_vars"]) == ["MAX", "$name"]
    assert cls(m, "Seller")["bases"] == [] and names(m["functions"]) == ["go"] and m["imports"] == ["Corp\\Base", "util.php"]


def test_ruby():
    m = parsed("shop.rb")
    shop = cls(m, "Shop")
    assert names(shop["methods"]) == ["name", "size", "sell", "shown"] and shop["bases"] == ["Base", "include(Comparable)"]
    assert names(m["functions"]) == ["top"] and names(cls(m, "Tools")["methods"]) == ["help"]
    assert "hide" in names(cls(parsed("shop.rb", True), "Shop")["methods"])


def test_elixir():
    m = parsed("shop.ex")
    shop = cls(m, "Shop")
    assert names(shop["methods"]) == ["sell", "count (+1 heads)", "talk"] and shop["docstring"] == "A shop."
    assert [p["type_hint"] for p in shop["methods"][0]["parameters"]] == ["integer()", "binary()"]


def test_typescript():
    m = parsed("server.ts")
    assert names(m["functions"]) == ["make", "arrow"] and m["functions"][0]["parameters"][1]["is_optional"]
    assert names(m["constants"]) == ["User", "LIMIT", "Seller", "Alias", "Color"]
    assert m["constants"][0]["type_hint"] == "{ id: string, tags: string[], age?: number }"
    assert [(r["method"], r["path"], r["handler"]) for r in m["routes"]] == [("GET", "/items", "listItems"), ("POST", "/items/:id", "")]
    assert set(m["env_vars"]) == {"TOKEN", "BASE_URL"}
    page = parse_file("web/app/users/[id]/page.tsx", "export default function Page() { return null }", "typescript")
    assert [(r["method"], r["path"]) for r in page["routes"]] == [("GET", "/users/[id]")]


PYTHON = '''"""Mod. More."""
from ..pkg import x
import os, sys
LIMIT: int = 3
@app.get("/a/{id}")
@app.route("/b", methods=["GET", "POST"])
async def go(a: int = 1, *, b=None, **kw) -> str:
    """Go."""
    return os.environ["TOKEN"] + os.getenv("HOME")
def _private(): pass
class Box(Base):
    """Box."""
    size = 1
    @property
    def name(self): return 1
    def _x(self): pass
    def __init__(self): pass
'''


def test_python():
    m = parse_file("a/b.py", PYTHON, "python")
    assert m["docstring"] == "Mod. More." and m["imports"] == ["..pkg", "os", "sys"] and names(m["functions"]) == ["go"]
    assert [(r["method"], r["path"]) for r in m["routes"]] == [("GET", "/a/{id}"), ("GET", "/b"), ("POST", "/b")]
    assert names(m["classes"][0]["methods"]) == ["name", "__init__"] and m["classes"][0]["methods"][0]["is_property"]
    assert m["env_vars"] == {"TOKEN": ["a/b.py"], "HOME": ["a/b.py"]}
    assert "_private" in names(parse_file("a/b.py", PYTHON, "python", True)["functions"])


def test_python_that_does_not_parse():
    m = parse_file("x.py", "def f(a, b=1):\n  return (\nclass K(B):\n  def m(self): pass\n", "python")
    assert names(m["functions"]) == ["f"] and names(m["classes"]) == ["K"]


@pytest.mark.parametrize("ext", sorted({"java", "cs", "rs", "cpp", "scala", "kt", "swift", "php", "rb", "ex", "ts", "go", "py"}))
def test_broken_and_empty_texts(ext):
    language = EXTENSION_TO_LANGUAGE["." + ext]
    for text in ("", "{", "}}}", "class", "def", "fn (", "\x00", '"' * 7, "@" * 50, "a" * 3000, "/*", "<?php"):
        assert parse_file("x." + ext, text, language) is not None


def test_operator(spark):
    rows = [("r", "a.py", "python", "def f(): pass"), ("r", "b.zig", None, "x"), (None, "c.go", None, None), ("r", "a.py", "python", "def f(): pass")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "repo string, path string, language string, content string, functions int")
    got = sorted((r.path, len(r.functions)) for r in parse_modules(df).collect())
    assert got == [("a.py", 1), ("a.py", 1), ("c.go", 0)]


def custom(path, src, include_private=False):
    from tesserine.parse.common import module

    return module(path, "zig") | {"docstring": src[:3]}


def test_registered_parser_and_sql(spark):
    register_parser("zig", custom)
    try:
        assert parse_file("x.zig", "abcdef", "zig")["docstring"] == "abc"
    finally:
        REGISTERED.pop("zig")
    register_sql(spark)
    assert spark.sql("select tesserine_slug('A b') as s, tesserine_tokens('abcdefgh') as t").first() == ("a-b", 2)
    got = spark.sql("select kind, name from parse_symbols('x.py', 'def f(): pass\nclass K:\n  def m(self): pass')").collect()
    assert [(r.kind, r.name) for r in got] == [("function", "f"), ("class", "K"), ("method", "K.m")]
