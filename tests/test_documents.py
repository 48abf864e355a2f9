"""Documents, budgets, imports and reference counts against plain Python on small corpora."""

import json
import random

from pyspark.sql import functions as F

from tesserine.config import Config
from tesserine.operators import documents as docs
from tesserine.operators import graph, scan, views
from tesserine.schema import MODULE_FIELDS
from tesserine.session import table

SCHEMA = f"file_id bigint, repo string, module_ord bigint, {MODULE_FIELDS}"


def fn(name, doc="", private=False, params=(), ret="", decorators=()):
    return (name, [(*p,) for p in params], ret, doc, 1, False, private, False, list(decorators), 1)


def mod(i, path, doc="", functions=(), classes=(), constants=(), routes=(), imports=(), env=None, repo="r"):
    return (i, repo, i, path, path.split("/")[-1].split(".")[0], "python", doc, list(functions), list(classes), list(constants), list(routes), list(imports), env or {})


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_dependency_resolution(spark):
    rows = [
        mod(0, "src/models/user.py", imports=["os", "models.item", "src/models/user"]),
        mod(1, "src/models/item.py", imports=["..utils", ".user", "./user"]),
        mod(2, "src/utils.py", imports=["utils"]),
        mod(3, "lib/utils.py", imports=["utils", "models/user", "lib/utils.py"]),
        mod(4, "utils", imports=["lib.utils"]),
        mod(5, "other.py", imports=["models.user"], repo="q"),
    ]
    got = {(r.repo, r.src, r.dst) for r in graph.dependency_edges(make(spark, rows)).collect()}
    # "utils" is a module's own path, so it wins over the suffix of the earlier module.
    assert got == {
        ("r", "src/models/user.py", "src/models/item.py"), ("r", "src/models/item.py", "src/utils.py"), ("r", "src/models/item.py", "src/models/user.py"),
        ("r", "src/utils.py", "utils"), ("r", "lib/utils.py", "utils"), ("r", "lib/utils.py", "src/models/user.py"), ("r", "utils", "lib/utils.py"),
    }
    lines = {r.path: r.line for r in graph.dependency_lines(make(spark, rows)).collect()}
    assert lines["other.py"] == "`other.py` imports: (none — leaf node)"
    ts = make(spark, [mod(0, "a/b.ts", imports=["./c", "../d"]), mod(1, "a/c.ts"), mod(2, "d.ts")])
    assert graph.dependency_edges(ts).count() == 0
    assert {r.dst for r in graph.dependency_edges(ts, resolve_relative_ts=True).collect()} == {"a/c.ts", "d.ts"}


def test_reference_counts(spark):
    r = random.Random(3)
    words = ["alpha", "beta", "gam", "gamma", "x"]
    rows = [mod(i, f"d{i % 3}/{r.choice(words)}{i % 2}.py", " ".join(r.choices(words, k=3)).title() + "0", [fn(r.choice(words) + "1", "uses Beta0")], repo=r.choice("ab")) for i in range(30)]
    rows = list({(x[1], x[3]): x for x in rows}.values())
    text = lambda m: " ".join([m[6], *(y for f in m[7] for y in (f[0], f[3]))]).lower()
    stem = lambda m: m[3].split("/")[-1].rsplit(".", 1)[0].lower()
    want = {(m[1], m[3]): sum(1 for o in rows if o[1] == m[1] and o[3] != m[3] and stem(m) in text(o)) for m in rows}
    for sizes in ({"stems": 1, "group": 2}, {"stems": 3, "group": 1000}, {}):
        assert {(x.repo, x.path): x.n for x in graph.reference_counts(make(spark, rows), **sizes).collect()} == want


def test_summary_cut(spark):
    r = random.Random(5)
    rows = [mod(i, f"p/m{i:03d}.py", f"Does thing {i} " + "long " * r.randint(0, 12) + ". More.", [fn("f", f"see m{r.randint(0, 59):03d}")]) for i in range(60)]
    m = make(spark, rows)
    refs = {x.path: x.n for x in graph.reference_counts(views.without_private(views.without_constants(views.truncated(m)))).collect()}
    line = {x.path: x.line for x in docs.summary_lines(m).collect()}
    for budget in (1, 60, 400, 5000):
        text = lambda kept: "# r\n\n## Modules\n\n" + "".join(line[p] + "\n" for p in kept)
        kept = [x[3] for x in rows]
        if max(1, len(text(kept)) // 4) > budget:
            kept.sort(key=lambda p: refs[p])
            while kept and max(1, len(text(kept)) // 4) > budget:
                kept.pop(0)
        assert docs.summary_documents(m, budget).first().text == text(kept)
        again = docs.summary_documents(m.repartition(7), budget).first().text
        assert again == text(kept)


def test_fallbacks(spark):
    rows = [
        mod(0, "app/page.tsx", routes=[("GET", "/x", "default", 1, "")]), mod(1, "a/api.py", routes=[("GET", "/x", "h", 1, "")]), mod(2, "a/utils.py"), mod(3, "b/c.py", functions=[fn("f"), fn("g", "Gee. X")]),
        mod(4, "b/d.py", constants=[("__all__", "", "['p', \"q\"]")]), mod(5, "b/e.py", functions=[fn("f"), fn("g")]), mod(6, "b/f.py"), mod(7, "b/g.py", "  \n "),
    ]
    got = {r.path: r.line.split("): ")[1] if "): " in r.line else "" for r in docs.summary_lines(make(spark, rows)).collect()}
    assert got == {"app/page.tsx": "Page component at /x.", "a/api.py": "Defines HTTP routes.", "a/utils.py": "Utility functions.", "b/c.py": "Gee.", "b/d.py": "Provides p, q.", "b/e.py": "Provides f, g.", "b/f.py": "", "b/g.py": ""}


DETAILS = """## a/x.py
<a id="a-x-py"></a>
```yaml
language: python
exports: ["C", "K", "N", "Z", "f"]
imports: ["b", "os"]
routes: ["GET /r"]
```

Doc.

### Functions

#### `f(a?: int = 1, *b) -> str`
_Decorators: @cached_

Eff.

### Classes

#### `C(B)`

Cee.

##### Methods

###### `m()`

Em.


### Constants

- `K`: `int`
- `Z`: `z.object({ a })`
- `N`

### Routes

- `GET /r` → `f` — Arr.
"""


def test_details(spark):
    row = mod(
        0, "a/x.py", "Doc.", [fn("f", "Eff.", params=[("a", "int", "1", True), ("*b", "", "", False)], ret="str", decorators=["cached"])], [("C", "Cee.", ["B"], [fn("m", "Em.")], [], 1)],
        [("K", "int", "3"), ("Z", "", "z.object({ a })"), ("N", "", "5")], [("GET", "/r", "f", 1, "Arr.")], ["os", "b", "os"],
    )
    got = docs.module_details(make(spark, [row]), Config(root=".", emit_frontmatter=True)).first().text
    assert got == DETAILS


def test_stages(spark):
    m = make(spark, [mod(0, "a.py", "One. Two two two.", [fn("f", "Eff. More."), fn("_p", "Priv.", True)], [("C", "Cee. X", [], [fn("_q", "", True)], [("V", "int", "1")], 1)], [("K", "int", "1")])])
    chars = lambda d: docs.detail_cost(d).first().chars
    sizes = [chars(m), chars(views.truncated(m)), chars(views.without_constants(views.truncated(m))), chars(views.without_private(views.without_constants(views.truncated(m))))]
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == 4
    for stage, size in enumerate(sizes):
        budget = -(-(size - 3) // 4)
        assert docs.prune_stage(m, budget, docs.detail_cost).first().stage == stage
    assert docs.prune_stage(m, 1, docs.detail_cost).first().stage == 4 and docs.pruned(m, 1).count() == 0
    assert [f.name for f in docs.pruned(m, budget).first().functions] == ["f"]


def test_full_document_is_cut_to_the_character(spark):
    from tesserine.pipeline import full_text

    r = random.Random(9)
    names = ["pkg/utils", "lib/utils", "pkg/core", "app/main", "lib/io", "core", "app/util/io"]
    rows = [
        mod(i, f"{n}.py", "Doc. " * r.randint(1, 3), [fn(f"f{i}", "Uses utils and io here." if i % 2 else "Plain.")], imports=r.choices(["utils", "io", "core", ".utils", "..core", "os", "pkg.core", "lib/io.py"], k=4), env={"HOME": ["x"], f"V{i % 3}": ["y"]} if i % 3 else {})
        for i, n in enumerate(names)
    ]
    m = make(spark, rows)
    pruned = views.without_private(views.without_constants(views.truncated(m))).cache()
    refs = {x.path: x.n for x in graph.reference_counts(pruned).collect()}
    order = sorted((x[3] for x in rows), key=lambda p: (refs[p], next(y[2] for y in rows if y[3] == p)))
    at = {x[3]: x for x in rows}
    sizes = []
    for k in range(len(order)):  # the document rendered whole after each module that goes
        left = make(spark, [(*at[p][:2], i, *at[p][3:]) for i, p in enumerate(order[k:])])
        sizes.append(len(full_text(views.without_private(views.without_constants(views.truncated(left))), Config(root=".", name="r"))))
    sizes.append(0)
    for k in (1, 4):
        for budget in (-(-(sizes[k] - 3) // 4), -(-(sizes[k] - 3) // 4) - 1):
            want = next(order[j:] for j in range(len(order) + 1) if sizes[j] <= 4 * budget + 3)
            kept = docs.fitted_full(m, budget, Config(root=".", name="r"))
            assert [x.path for x in kept.where("stage = 4").orderBy("module_ord").collect()] == (want if len(want) < len(order) else [])
    assert docs.fitted_full(m, 1).count() == 0 and docs.fitted_full(m, 100000).where("stage = 0").count() == len(rows)


def test_validation(spark):
    texts = {
        "ok": "# T\n\n> q\n\n## S\n\n- [a](b): x\n", "no heading": "## S\n", "quote": "# T\n## S\n> late\n", "section": "# T\n", "links": "# T\n## S\n- [](u) [l]()\n- [ ](x)\n", "anchors": '# T\n## S\n<a id="x"></a>\n<span name=\'x\'></span> <A ID="y">\n', "empty": " \n\n",
    }
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()] + [("null", None, 2)], "doc_id string, text string, line int")
    got = {}
    for r in docs.violations(df).collect():
        got.setdefault(r.doc, []).append((r.line_no, r.rule))
    assert {k: sorted(v) for k, v in got.items()} == {"no heading": [(1, "heading")], "quote": [(3, "quote")], "section": [(0, "section")], "links": [(3, "label"), (3, "url"), (4, "label")], "anchors": [(4, "anchor")], "empty": [(0, "empty")], "null": [(0, "empty")]}


def test_diff_and_mini(spark):
    m = make(spark, [mod(0, "a.py", functions=[fn("f")]), mod(1, "b.py", "B.")])
    changed = spark.createDataFrame([("b.py",), ("gone.py",), ("b.py",)], "path string")
    text = docs.joined_document(docs.diff_lines(m, changed)).first().text
    assert "Partial view" in text and "## b.py" in text and "## a.py" not in text
    lines = [r.line for r in docs.mini_lines(m).orderBy("module_ord", "line_ord").collect()]
    assert lines == ["a.py", "", "f()", "", "b.py", ""]


def test_empty_tables(spark):
    m = make(spark, [])
    for df in (docs.summary_documents(m), docs.full_lines(m), graph.dependency_edges(m), graph.reference_counts(m), views.env_table(m), docs.pruned(m, 10), views.heads_collapsed(views.functions(m).select("repo", "path", "owner", "owner_ord", "fn_ord", "name", "signature"))):
        assert df.count() == 0
    assert views.stats(m).first().files == 0


def test_scan_predicates(spark):
    df = spark.createDataFrame([("src/a.py",), ("build/a.py",), ("x/test_a.py",), ("x/b.zig",), ("K.JAVA",), ("a.swift",), ("doc/x.js",), (None,)], "path string")
    assert sorted(r.path for r in scan.accepted(df).collect()) == ["K.JAVA", "doc/x.js", "src/a.py"]
    data = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"a\x00"),), (bytearray(b"\xff"),)], "b binary")
    assert [r.t for r in data.select(scan.is_text(F.col("b")).alias("t")).collect()] == [True, False, False]


def test_carried_forward(spark):
    df = spark.createDataFrame([("s", 1, None), ("s", 2, "a"), ("s", 3, None), ("t", 1, None)], "s string, i int, v string")
    out = {(r.s, r.i): r.w for r in views.carried_forward(df, ["s"], ["i"], F.col("v"), "w").collect()}
    assert out == {("s", 1): None, ("s", 2): "a", ("s", 3): "a", ("t", 1): None}


def test_heads_and_members(spark):
    f = spark.createDataFrame([("r", "p", "", -1, 0, "f", "f(a)"), ("r", "p", "", -1, 1, "f", "f(b)"), ("r", "p", "", -1, 2, "g", "g()")], "repo string, path string, owner string, owner_ord int, fn_ord int, name string, signature string")
    assert sorted((r.name, r.signature) for r in views.heads_collapsed(f).collect()) == [("f (+1 heads)", "f(a)"), ("g", "g()")]
    a = spark.createDataFrame([("x", 1), ("z", 2)], "k string, m int")
    b = spark.createDataFrame([("x", "X"), ("y", "Y")], "k string, t string")
    assert sorted((r.k, r.m, r.t, r.synthetic) for r in views.members_attached(a, b, "k").collect()) == [("x", 1, "X", False), ("y", None, "Y", False), ("z", 2, None, True)]


def test_registered_queries(spark):
    from tesserine.plans import queries

    found = queries.queries()
    assert set(queries.oracle_sql()) <= set(found)
    assert json.dumps(sorted(found)) and table is not None
