"""Command line: generate, validate, stats."""

from __future__ import annotations

import argparse
import hashlib
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from tesserine.config import TABLE, load_config
from tesserine.session import session, shared_folder


def _generate(a: argparse.Namespace) -> int:
    from tesserine import pipeline
    from tesserine.sources.gitdiff import GitError

    if a.watch and a.diff:
        print("--watch and --diff exclude each other", file=sys.stderr)
        return 1
    config = load_config(a.root, a.table, emit_frontmatter=True if a.frontmatter else None, include_private=True if a.include_private else None, output_dir=a.output)
    spark = session(master=a.master)
    began = time.time()
    try:
        built = pipeline.generate(spark, config, a.incremental, a.diff, not a.dry_run)
    except (LookupError, GitError) as e:
        print(e, file=sys.stderr)
        return 1
    if a.dry_run:
        for name, text in built.documents.items():
            print(f"--- {name}\n{text}")
        return 0
    folder = config.output_dir if Path(config.output_dir).is_absolute() else str(Path(config.root) / config.output_dir)
    for path in pipeline.write_outputs(built.documents, folder):
        print(path)
    print(f"{built.parsed} files parsed in {time.time() - began:.1f} s")
    if a.watch:
        # One checkpoint a root in the session's folder, so that a restart goes on where the last run stopped.
        name = hashlib.sha256(str(Path(config.root).resolve()).encode()).hexdigest()[:16]
        query = pipeline.watch(spark, config, f"{shared_folder(spark).rstrip('/')}/watch-{name}")
        try:
            query.awaitTermination()
        except KeyboardInterrupt:
            query.stop()
    return 0


def _validate(a: argparse.Namespace) -> int:
    from tesserine.operators.documents import violations

    target = Path(a.path) if Path(a.path).is_file() else Path(a.path) / "llms.txt"
    if not target.is_file():
        print(f"not found: {target}", file=sys.stderr)
        return 1
    spark = session(master=a.master)
    doc = spark.createDataFrame([(str(target), target.read_text(encoding="utf-8"))], "doc_id string, text string")
    found = violations(doc).orderBy("line_no", "rule").collect()
    for v in found:
        print(v.message, file=sys.stderr)
    if not found:
        print(f"valid: {target}")
    return int(bool(found))


def _stats(a: argparse.Namespace) -> int:
    from tesserine import pipeline
    from tesserine.operators.views import stats

    spark = session(master=a.master)
    modules, _ = pipeline.collect_modules(spark, load_config(a.root, a.table), a.incremental)
    r = stats(modules).select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "functions", "classes", "methods", "tokens")], "languages").first()
    for label, value in (("Files", r.files), ("Functions", r.functions), ("Classes", r.classes), ("Methods", r.methods), ("Languages", r.languages), ("Estimated tokens", r.tokens)):
        print(f"{label}: {value}")
    return 0


def main(argv: list[str] | None = None) -> int:
    """Run a command; returns the exit status."""
    p = argparse.ArgumentParser(prog="tesserine", description=__doc__)
    p.add_argument("--master", default="local[*]")
    p.add_argument("--table", default=TABLE, help="table below [tool] in pyproject.toml")
    commands = p.add_subparsers(required=True)
    g = commands.add_parser("generate", help="write the documents of a source tree")
    g.add_argument("root", nargs="?", default=".")
    g.add_argument("--output")
    for flag in ("--incremental", "--dry-run", "--watch", "--frontmatter", "--include-private"):
        g.add_argument(flag, action="store_true")
    g.add_argument("--diff", metavar="REF")
    g.set_defaults(run=_generate)
    v = commands.add_parser("validate", help="check a summary document")
    v.add_argument("path", nargs="?", default="llms.txt")
    v.set_defaults(run=_validate)
    s = commands.add_parser("stats", help="count what a source tree holds")
    s.add_argument("root", nargs="?", default=".")
    s.add_argument("--incremental", action="store_true")
    s.set_defaults(run=_stats)
    a = p.parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
