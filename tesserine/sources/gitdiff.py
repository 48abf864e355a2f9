"""Paths that differ from a git revision."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession


class GitError(RuntimeError):
    """git is missing, or refused."""


def changed_files(ref: str, root: str) -> set[str]:
    """Paths, relative to the root, that differ from ``ref``."""
    if ref.startswith("-"):
        raise GitError(f"not a revision: {ref}")
    try:
        done = subprocess.run(["git", "diff", "--name-only", "--relative", ref, "--"], cwd=root, capture_output=True, text=True)
    except FileNotFoundError as e:
        raise GitError("git is not installed") from e
    if done.returncode:
        raise GitError(done.stderr.strip() or f"git ended with {done.returncode}")
    return {x.strip() for x in done.stdout.splitlines() if x.strip()}


def changed_table(spark: SparkSession, ref: str, root: str) -> DataFrame:
    """The same as a one-column table."""
    return spark.createDataFrame([(p,) for p in sorted(changed_files(ref, root))], "path string")
