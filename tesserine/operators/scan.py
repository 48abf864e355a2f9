"""Predicates of the scan over a table of files, and the joins of files with the cache of parsed modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.config import ALWAYS_EXCLUDED, DEFAULT_EXCLUDE, DEFAULT_EXTENSIONS, DEFAULT_LANGUAGES
from tesserine.functions import exprs
from tesserine.sources.ignore import compiled


def ignored(path: Column, patterns) -> Column:
    """Whether gitignore patterns ignore a path: the last that matches decides, a negated one spares it."""
    out = F.lit(False)
    for regex, negated in compiled(patterns):
        out = F.when(path.rlike(regex), F.lit(not negated)).otherwise(out)
    return out


def excluded(path: Column, patterns) -> Column:
    """Whether exclude patterns match a path, or the path as a folder."""
    return ignored(path, patterns) | ignored(F.concat(path, F.lit("/")), patterns)


def included(path: Column, patterns) -> Column:
    """Whether a path matches an include pattern or lies below it; without patterns, all do."""
    if not patterns:
        return F.lit(True)
    out = F.lit(False)
    for p in patterns:
        for regex, _ in compiled([p]):
            out = out | path.rlike(regex)
        out = out | path.startswith(p.rstrip("/") + "/")
    return out


def allowed_language(language: Column, languages) -> Column:
    """Whether a language is among the wanted ones; scripts without types come with typed ones."""
    wanted = [*languages, *(["javascript"] if "typescript" in languages else [])]
    return language.isin(wanted)


def accepted(files: DataFrame, extensions=DEFAULT_EXTENSIONS, languages=DEFAULT_LANGUAGES, exclude=DEFAULT_EXCLUDE, include=(), gitignore=()) -> DataFrame:
    """Files that pass all predicates, cheap ones first; all are expressions of the path, so content is not touched."""
    path = F.col("path")
    suffix = exprs.path_suffix(path)
    inside = ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in ALWAYS_EXCLUDED]))
    return files.where(inside & suffix.isin(list(extensions)) & allowed_language(exprs.detect_language(path), languages) & ~ignored(path, gitignore) & ~excluded(path, exclude) & included(path, include))


def is_text(content: Column) -> Column:
    """Whether bytes are text: no NUL in the first 2,048, valid UTF-8."""
    return (F.position(F.lit(b"\x00"), F.substring(content, 1, 2048)) == 0) & F.is_valid_utf8(content)


def spelled_hash(x: Column | str) -> Column:
    """A hash in one spelling: lower case, no prefix."""
    return F.regexp_replace(F.lower(F.trim(x)), "^sha-?256[:=]", "")


def cache_join(files: DataFrame, cache: DataFrame, parse_opts: str = "private=0") -> DataFrame:
    """File versions with ``hit``: whether the cache has a module for their path, content hash and parse options.

    The cache is cut to distinct keys before the join, and only keys of the files travel, not contents.
    """
    keys = cache.where(F.col("module").isNotNull() & (F.coalesce("parse_opts", F.lit("private=0")) == parse_opts)).select("repo", "path", spelled_hash("content_hash").alias("hash")).distinct().withColumn("hit", F.lit(True))
    versions = files.select("file_id", "repo", "path", exprs.sha256("content").alias("hash")).distinct()
    return versions.join(keys, ["repo", "path", "hash"], "left").select("file_id", "repo", "path", "hash", F.coalesce("hit", F.lit(False)).alias("hit"))


def cache_merged(files: DataFrame, cache: DataFrame, parse_opts: str = "private=0") -> DataFrame:
    """The cache after a run: one entry per file seen, a hit or to be parsed; entries of vanished files are gone."""
    from tesserine.operators.incremental import current_versions

    current = current_versions(files)
    keys = cache.where(F.col("module").isNotNull() & (F.coalesce("parse_opts", F.lit("private=0")) == parse_opts)).select("repo", "path", spelled_hash("content_hash").alias("hash")).distinct().withColumn("hit", F.lit(True))
    return current.join(keys, ["repo", "path", "hash"], "left").select("repo", "path", "hash", F.coalesce("hit", F.lit(False)).alias("hit"))
