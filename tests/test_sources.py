"""File source, ignore rules, settings, cache, git and the whole pipeline."""

import subprocess
from pathlib import Path

import pytest

from tesserine.config import Config, load_config
from tesserine.sources import cache, files, gitdiff
from tesserine.sources.ignore import Matcher


@pytest.mark.parametrize(
    "pattern,path,hit",
    [("*.py", "a/b.py", True), ("/a.py", "b/a.py", False), ("a/", "a/x", True), ("a/", "a", False), ("**/t/**", "x/t/y", True), ("**/t/**", "t/y", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("*.t?t", "x.txt", True), ("[ab].c", "b.c", True), ("[!ab].c", "b.c", False), ("\\#x", "#x", True), ("d", "d/e/f", True), ("a.b", "axb", False)],
)
def test_patterns(pattern, path, hit):
    assert Matcher([pattern]).match(path) is hit


def test_last_match_wins():
    m = Matcher(["*.py", "!keep.py", "# comment", ""])
    assert m.match("a.py") and not m.match("x/keep.py")


@pytest.fixture
def tree(tmp_path):
    def put(name, data):
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode())

    put("a-b.py", '"""Dash. X."""\n')
    put("a/__init__.py", '"""Init."""\n')
    put("a/b.py", '"""Bee."""\nimport a.c\nfrom .c import x\n')
    put("a/c.py", 'import os\nV = os.getenv("TOK")\ndef b_user(): pass\n')
    put("a/bin.py", b"x\x00y")
    put("a/bad.py", b"\xff\xfe\xfa")
    put("node_modules/x.py", "x = 1")
    put("tests/t.py", "x = 1")
    put("skip/me.py", "x = 1")
    put(".gitignore", "skip/\n")
    put("n.txt", "no")
    return tmp_path / "root"


def test_scan(spark, tree):
    df = files.scan(spark, Config(root=str(tree)), batch=2)
    assert sorted(r.path for r in df.collect()) == ["a-b.py", "a/__init__.py", "a/b.py", "a/c.py"]
    assert [p for p, _ in files.walk(Config(root=str(tree)))][:2] == ["a/__init__.py", "a/b.py"]  # by components
    assert files.walk(Config(root=str(tree), include=("a",))) and all(p.startswith("a/") for p, _ in files.walk(Config(root=str(tree), include=("a",))))


def test_config(tmp_path):
    (tmp_path / "pyproject.toml").write_text('[project]\nname = "n"\nversion = 3\n[tool.other]\nexclude = ["x", 1]\nmax_tokens_full = "no"\nemit_frontmatter = true\n')
    sub = tmp_path / "s"
    sub.mkdir()
    c = load_config(sub, "other", description="d")
    assert (c.name, c.version, c.exclude, c.max_tokens_full, c.emit_frontmatter, c.description) == ("n", "", ("x", "1"), 32000, True, "d")


def test_cache_versions(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert cache.load_cache(spark, path).count() == 0
    rows = spark.createDataFrame([("p", "h", "private=0", None)], cache.MODULE_CACHE)
    for n in range(3):
        cache.save_cache(rows, path)
    assert cache.load_cache(spark, path).count() == 1 and len(list(Path(path).glob("v=*"))) == 2
    (Path(path) / "v=000000009").mkdir()  # a version that was not finished
    assert cache.load_cache(spark, path).count() == 1


def test_module_json(spark):
    df = spark.createDataFrame([('{"name": "n", "functions": [{"name": "f"}], "odd": 1}',), ("{",)], "j string")
    got = [r.m for r in df.select(cache.module_from_json("j").alias("m")).collect()]
    assert got[0].name == "n" and got[0].docstring == "" and got[0].classes == [] and got[0].env_vars == {}


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=b", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.py").write_text("1")
    run("add", "-A")
    run("commit", "-qm", "m")
    (tmp_path / "sub" / "x.py").write_text("2")
    assert gitdiff.changed_files("HEAD", str(tmp_path / "sub")) == {"x.py"}
    assert [r.path for r in gitdiff.changed_table(spark, "HEAD", str(tmp_path)).collect()] == ["sub/x.py"]
    with pytest.raises(gitdiff.GitError):
        gitdiff.changed_files("nope", str(tmp_path))


def test_pipeline(spark, tree, tmp_path):
    from tesserine import pipeline

    config = Config(root=str(tree), name="proj", output_dir=str(tmp_path / "out"))
    first = pipeline.generate(spark, config)
    again = pipeline.generate(spark, config, incremental=True)
    assert first.parsed == 4 and again.parsed == 0 and first.documents == again.documents
    (tree / "a" / "c.py").write_text("def changed(): pass\n")
    third = pipeline.generate(spark, config, incremental=True)
    assert third.parsed == 1 and "changed()" in third.documents["llms-full.txt"]
    full = first.documents["llms-full.txt"]
    assert "| `TOK` | `a/c.py` |" in full and "`a/b.py` imports: `a/c.py`" in full and full.startswith("# proj\n\n## Environment Variables\n")
    summary = first.documents["llms.txt"]
    assert summary.startswith("# proj\n\n## Modules\n\n- [a/__init__](llms-full.txt#a-init-py): Init.\n") and summary.endswith("Dash.\n")
    paths = pipeline.write_outputs(first.documents, config.output_dir)
    assert [Path(p).name for p in paths] == ["llms.txt", "llms-full.txt", "llms-mini.txt"]
    with pytest.raises(LookupError):
        pipeline.generate(spark, Config(root=str(tmp_path / "out")))


def test_watch(spark, tree, tmp_path):
    from tesserine import pipeline

    config = Config(root=str(tree), name="proj", output_dir=str(tmp_path / "w"))
    q = pipeline.watch(spark, config, str(tmp_path / "ck"), available_now=True)
    q.awaitTermination()
    assert (tmp_path / "w" / "llms.txt").read_text().startswith("# proj")
