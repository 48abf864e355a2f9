"""Generation of documents from a source tree: scan, cache, parse, prune, render, write."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.config import Config
from tesserine.operators import documents as docs
from tesserine.parse.udtf import parse_modules
from tesserine.session import stored
from tesserine.sources import cache as cache_source
from tesserine.sources import files as file_source
from tesserine.sources import gitdiff


@dataclass
class Built:
    """Documents of a run by file name, and the modules they were made of."""

    documents: dict[str, str]
    modules: DataFrame
    parsed: int


def collect_modules(spark: SparkSession, config: Config, incremental: bool = False, save: bool = True) -> tuple[DataFrame, int]:
    """Modules of a root with the repository's name and module_ord; parses only what the cache does not hold when ``incremental``.

    The cache is keyed by path, content hash and parse options. What is written back are the entries of files seen in
    this run, so entries of vanished files go. Returns the modules and how many files were parsed.
    """
    repo = F.lit(config.name or "project")
    scanned = stored(file_source.scan(spark, config), "scan")
    files = scanned.join(_numbered(scanned), "path")
    cache_path = str(Path(config.root) / config.cache_path)
    old = cache_source.load_cache(spark, cache_path)
    if incremental:
        hits = files.join(old.where(F.col("module").isNotNull() & (F.col("parse_opts") == config.parse_opts)).select("path", "content_hash", "module"), ["path", "content_hash"])
        misses = files.join(hits.select("path"), "path", "left_anti")
    else:
        hits, misses = None, files
    fresh = parse_modules(misses.withColumn("repo", repo), config.include_private)
    keys = files.select("path", "content_hash", "module_ord")
    names = [c for c in fresh.columns if c != "repo"]
    made = fresh.select(*names).join(keys, "path")
    if hits is not None:
        known = hits.select("path", "content_hash", "module_ord", *[F.col(f"module.{c}").alias(c) for c in names if c != "path"])
        all_ = known.unionByName(made.select(known.columns))
    else:
        all_ = made
    all_ = stored(all_, "modules")
    n = misses.count()
    if save:
        entry = all_.select("path", "content_hash", F.lit(config.parse_opts).alias("parse_opts"), F.struct("module_ord", *names).alias("module"))
        cache_source.save_cache(entry, cache_path)
    return all_.drop("content_hash").withColumn("repo", repo), n


def _numbered(files: DataFrame) -> DataFrame:
    """path and module_ord, the place of the path among all by its components.

    A single root's list of paths is numbered in one task; the contents stay where they are.
    """
    from pyspark.sql import Window

    return files.select("path").withColumn("module_ord", F.row_number().over(Window.orderBy(F.split("path", "/"))).cast("bigint") - 1)


def full_text(modules: DataFrame, config: Config) -> str:
    """The full document of one repository."""
    rows = docs.full_lines(modules, config).orderBy("section_ord", "module_ord", "line_ord").select("line").toLocalIterator()
    return "\n".join(r.line for r in rows)


def mini_text(modules: DataFrame, config: Config) -> str:
    """The document of names and signatures of one repository."""
    rows = docs.mini_lines(modules).orderBy("module_ord", "line_ord").select("line").toLocalIterator()
    return "\n".join([config.name or "project", *(r.line for r in rows)]).strip() + "\n"


def fitting_full_text(modules: DataFrame, config: Config) -> str:
    """The full document within its budget: only the modules that fit reach the driver, and the text is no longer than the budget."""
    kept = stored(docs.fitted_full(modules, config.max_tokens_full, config).drop("stage", "refs"), "fitted")
    return full_text(kept, config) or f"# {config.name or 'project'}\n"


def generate(spark: SparkSession, config: Config, incremental: bool = False, diff: str | None = None, save: bool = True) -> Built:
    """All documents of a root; with ``diff`` only the partial view of files that differ from a revision."""
    modules, parsed = collect_modules(spark, config, incremental, save)
    if diff is not None:
        changed = gitdiff.changed_table(spark, diff, config.root)
        lines = docs.diff_lines(modules, changed, config)
        some = [r.line for r in lines.orderBy("section_ord", "module_ord", "line_ord").select("line").toLocalIterator()]
        if not some:
            raise LookupError(f"no module differs from {diff}")
        return Built({config.output_diff: "\n".join(some)}, modules, parsed)
    if not modules.take(1):
        raise LookupError("no source file was found")
    summary = docs.summary_documents(modules, config.max_tokens_summary, config).first().text
    return Built({config.output_summary: summary, config.output_full: fitting_full_text(modules, config), config.output_mini: mini_text(modules, config)}, modules, parsed)


def write_outputs(documents: dict[str, str], folder: str) -> list[str]:
    """Write documents as UTF-8 files, making the folder; returns their paths."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    for name, text in documents.items():
        (out / name).write_text(text, encoding="utf-8")
    return [str(out / n) for n in documents]


def watch(spark: SparkSession, config: Config, checkpoint: str, available_now: bool = False):
    """Rebuild the documents after every batch of changes; outputs must lie outside the root or be ignored by it."""
    from tesserine.streaming.watch import rebuild_on_change

    file_source.register(spark)
    changes = spark.readStream.format("repository_changes").option("root", config.root).load()

    def rebuild(batch: DataFrame, n: int) -> None:
        if batch.take(1):
            try:
                write_outputs(generate(spark, config, incremental=True).documents, config.output_dir)
            except LookupError:
                pass

    return rebuild_on_change(changes, rebuild, checkpoint, available_now)

