"""Queries over a source tree: files made of nations and regions are written into the session's folder and read back.

They cover the scan with ignore rules and settings, parsing with private, nested and routed code, imports, references and
environment variables that are not empty, the cache, git, the change stream, and the documents of a whole run.
"""

from __future__ import annotations

import subprocess
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.config import Config, load_config
from tesserine.session import shared_folder, table
from tesserine.sources import cache, files, gitdiff

NATION = '''"""Visits {n}. It lies in zone_{r}."""
import os
from geo.zone_{r} import ZONE
from . import nothing

KEY: int = {k}
_HIDDEN = 1


def visit_{n}(days: int = {k}, *, slow: bool = False) -> str:
    """Spends days there. Twice."""
    return os.environ["HOME_{r}"] + os.getenv("TOKEN")


def _secret():
    return 0


class Guide_{n}(Base):
    """Leads through {n}."""

    SIZE: int = {k}

    async def lead(self, group):
        """Leads a group."""

    def _rest(self):
        pass

    class Inner:
        pass
'''
REGION = '''"""Zone of {r}."""
from fastapi import APIRouter

router = APIRouter()
ZONE = "{r}"


@router.get("/{r}/all")
def all_{r}():
    """Lists the zone."""
    return []


@router.post("/{r}")
async def add_{r}(name: str):
    return name
'''
SETTINGS = '''[project]
name = "tree"
version = "1.0"

[tool.tesserine]
exclude = ["**/drafts/**"]
max_tokens_full = 64000
emit_frontmatter = true
languages = 3
'''


def _names(spark: SparkSession, folder: str) -> tuple[list[tuple[str, int, str]], list[str]]:
    """(nation, key, region) and regions as identifiers; TPC-H fixes them at 25 and 5."""
    ident = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", "_"))
    r = table(spark, folder, "region").select(F.col("r_regionkey"), ident("r_name").alias("r"))
    n = table(spark, folder, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(ident("n_name").alias("n"), F.col("n_nationkey").cast("int").alias("k"), "r")
    return [(x.n, x.k, x.r) for x in n.collect()], [x.r for x in r.collect()]


def make_tree(spark: SparkSession, folder: str) -> Path:
    """A new tree in the session's folder, which all executors must see as files; with files that a scan must leave out."""
    base = shared_folder(spark)
    base = base[5:] if base.startswith("file:") else base
    if "://" in base:
        raise ValueError("the session's folder must be a mounted one for source trees")
    root = Path(base) / f"tree-{uuid.uuid4().hex}"
    nations, regions = _names(spark, folder)

    def put(name: str, data: str | bytes) -> None:
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode())

    for n, k, r in nations:
        put(f"geo/{r}/{n}.py", NATION.replace("{n}", n).replace("{k}", str(k)).replace("{r}", r))
    for r in regions:
        put(f"geo/zone_{r}.py", REGION.replace("{r}", r))
        put(f"node_modules/{r}.py", "x = 1\n")
        put(f"skipped/{r}.py", "x = 1\n")
        put(f"geo/tests/test_{r}.py", "x = 1\n")
        put(f"geo/{r}/data.py", b"x = 1\0")
        put(f"geo/{r}/bad.py", b"\xff\xfe")
        put(f"geo/{r}/notes.md", "no source\n")
    put(".gitignore", "skipped/\n# comment\n")
    return root


def _first_nation(spark: SparkSession, folder: str, root: Path) -> Path:
    n, _, r = min(_names(spark, folder)[0], key=lambda x: x[1])
    return root / f"geo/{r}/{n}.py"


def _config(root: Path, **more) -> Config:
    return Config(root=str(root), name="tree", **more)


def tree_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the tree that pass the scan, with language, suffix, length and hash."""
    return files.scan(spark, _config(make_tree(spark, folder)), batch=4).select("path", "language", "ext", F.col("n_chars").cast("bigint").alias("n_chars"), "content_hash")


def _parsed(spark: SparkSession, folder: str, private: bool = False) -> DataFrame:
    from tesserine import pipeline

    modules, _ = pipeline.collect_modules(spark, _config(make_tree(spark, folder), include_private=private), save=False)
    return modules


def _joined(items, name: str = "name"):
    return F.array_join(F.array_sort(F.transform(items, lambda x: x[name])), " ")


def tree_modules(spark: SparkSession, folder: str) -> DataFrame:
    """Public symbols of the tree's modules, their environment variables and imports."""
    m = _parsed(spark, folder)
    methods = F.flatten(F.transform("classes", lambda c: F.transform(c["methods"], lambda f: F.concat(c["name"], F.lit("."), f["name"]))))
    return m.select("path", "docstring", _joined("functions").alias("functions"), _joined("classes").alias("classes"), F.array_join(F.array_sort(methods), " ").alias("methods"), _joined("constants").alias("constants"), F.array_join(F.array_sort(F.map_keys("env_vars")), " ").alias("env"), F.array_join(F.array_sort(F.array_distinct("imports")), " ").alias("imports"))


def tree_private(spark: SparkSession, folder: str) -> DataFrame:
    """Functions and methods when private ones are kept, with their marks."""
    from tesserine.operators import views

    return views.functions(_parsed(spark, folder, private=True)).select("path", "owner", "name", "is_async", "is_private")


def tree_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Routes of the tree."""
    from tesserine.operators import views

    return views.routes(_parsed(spark, folder)).select("path", "method", "route_path", "handler", "docstring")


def tree_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    """Dependency lines: every nation imports its zone."""
    from tesserine.operators import graph

    return graph.dependency_lines(_parsed(spark, folder)).select("path", "line")


def tree_references(spark: SparkSession, folder: str) -> DataFrame:
    """Reference counts: every nation mentions its zone."""
    from tesserine.operators import graph

    return graph.reference_counts(_parsed(spark, folder)).select("path", "n")


def tree_environment(spark: SparkSession, folder: str) -> DataFrame:
    """Environment variables with the files that read them."""
    from tesserine.operators import views

    return views.env_table(_parsed(spark, folder)).select("var", "n", "files")


def tree_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the summary of a whole run."""
    from tesserine import pipeline

    text = pipeline.generate(spark, _config(make_tree(spark, folder)), save=False).documents["llms.txt"]
    return spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "line_no int, line string")


def tree_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Files parsed by a first run, by a second one, and by a third after every zone has changed and one nation is gone."""
    from tesserine import pipeline

    root = make_tree(spark, folder)
    config = _config(root)
    runs = [pipeline.generate(spark, config, incremental=True), pipeline.generate(spark, config, incremental=True)]
    for p in (root / "geo").glob("zone_*.py"):
        p.write_text(p.read_text() + "\nMORE = 1\n")
    _first_nation(spark, folder, root).unlink()
    runs.append(pipeline.generate(spark, config, incremental=True))
    rows = [(k, x.parsed, x.documents["llms.txt"].count("\n- ")) for k, x in enumerate(runs, 1)]
    return spark.createDataFrame(rows, "run int, parsed int, listed int")


def tree_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Settings of a root: the nearest pyproject.toml, values of wrong types ignored."""
    root = make_tree(spark, folder)
    (root / "pyproject.toml").write_text(SETTINGS)
    c = load_config(root / "geo", description="of zones")
    return spark.createDataFrame([(c.name, c.version, c.description, " ".join(c.exclude), c.max_tokens_summary, c.max_tokens_full, c.emit_frontmatter, len(c.languages))], "name string, version string, description string, exclude string, summary int, full int, frontmatter boolean, languages int")


def tree_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Changes that the stream gives for the whole tree, then for a changed, a new and a deleted file."""
    root = make_tree(spark, folder)
    files.register(spark)
    base = str(root) + "-stream"

    def drain() -> None:
        changes = spark.readStream.format("repository_changes").option("root", str(root)).load().select("path", "op")
        write = lambda batch, n: batch.withColumn("batch", F.lit(n).cast("int")).write.mode("append").parquet(f"{base}/out")
        changes.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    drain()
    (root / "geo/zone_asia.py").write_text("changed = 1\n")
    (root / "geo/zone_new.py").write_text("new = 1\n")
    _first_nation(spark, folder, root).unlink()
    drain()
    rows = spark.read.parquet(f"{base}/out")
    return rows.select((F.dense_rank().over(_by_batch()) - 1).cast("int").alias("turn"), "path", "op")


def _by_batch():
    from pyspark.sql import Window

    return Window.orderBy("batch")


def tree_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Paths that differ from a git revision."""
    root = make_tree(spark, folder)
    git = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", "-c", "commit.gpgsign=false", *a], cwd=root, check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A", "geo")
    git("commit", "-qm", "first")
    for p in (root / "geo").glob("zone_*.py"):
        p.write_text("changed = 1\n")
    return gitdiff.changed_table(spark, "HEAD", str(root))


def tree_watch(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the summary that watching a tree has written."""
    from tesserine import pipeline

    root = make_tree(spark, folder)
    out = str(root) + "-out"
    pipeline.watch(spark, _config(root, output_dir=out), str(root) + "-watch", available_now=True).awaitTermination()
    return spark.createDataFrame(list(enumerate((Path(out) / "llms.txt").read_text().split("\n"), 1)), "line_no int, line string")


def cache_json(spark: SparkSession, folder: str) -> DataFrame:
    """Cached modules written as JSON and read back."""
    m = table(spark, folder, "module_cache").where("module is not null")
    again = m.select("repo", "path", "run_id", cache.module_from_json(cache.module_to_json("module")).alias("m"))
    return again.select("repo", "path", "run_id", F.col("m.name").alias("name"), F.col("m.docstring").alias("docstring"), F.size("m.functions").alias("functions"), F.size("m.classes").alias("classes"), F.size("m.constants").alias("constants"), F.size(F.map_keys("m.env_vars")).alias("env")).distinct()


def cache_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Entries per repository of the newest version of a cache that was written three times."""
    rows = table(spark, folder, "module_cache").select("path", "content_hash", "parse_opts", F.lit(None).cast(_module_type()).alias("module"), "repo")
    path = f"{shared_folder(spark).rstrip('/')}/cache-{uuid.uuid4().hex}"
    kept = rows.select("path", "content_hash", "parse_opts", "module")
    for part in (kept.limit(1), kept.limit(2), kept):
        cache.save_cache(part, path)
    return cache.load_cache(spark, path).groupBy("path").agg(F.count("*").alias("entries"))


def _module_type() -> str:
    from tesserine.schema import MODULE_STRUCT

    return MODULE_STRUCT


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (tree_scan, tree_modules, tree_private, tree_routes, tree_dependencies, tree_references, tree_environment, tree_summary, tree_incremental, tree_settings, tree_changes, tree_diff, tree_watch, cache_json, cache_versions)}
