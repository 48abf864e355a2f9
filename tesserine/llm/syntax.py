"""Problem 6: source files that do not parse.

Every file is read by the recursive-descent checker of its language (statements by descent, expressions by precedence
climbing) with panic-mode recovery, so that all errors are stored, not only the first. The language is that of the path's
extension; where the extension is unknown, the ``language`` column's. Files in other languages are left undecided
(``valid`` is null).

Deeply nested files are read with a longer stack, so nesting has no limit of its own. Should the stack end all the same, the
errors found before count, and a file without any is left undecided (``valid`` null, cause "too deep").

Cases: null content or path counts as empty; empty files are valid; repeated versions give one row; extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.session import map_rows

# Languages by file extension.
LANGUAGE_OF = {".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".go": "go", ".java": "java", ".rb": "ruby", ".rs": "rust"}
#: Frames of Python's stack for a deeply nested file; they lie on the heap, some 100 bytes each.
FRAMES = 500_000
_KNOWN = frozenset(LANGUAGE_OF.values())


def language_of(path: str | None, language: str | None) -> str | None:
    """The language by extension, else the named one when it is known here."""
    name = (path or "").rsplit("/", 1)[-1].lower()
    dot = name.rfind(".")
    found = LANGUAGE_OF.get(name[dot:]) if dot >= 0 else None
    if found:
        return found
    language = (language or "").strip().lower()
    return language if language in _KNOWN else None


def check(content: str | None, language: str, path: str = "") -> list[tuple[int, str]] | None:
    """All syntax errors as (offset, message); None where nesting is too deep to decide and no error stands before it."""
    import sys

    from tesserine.functions.lex import tokenize
    from tesserine.llm.syntax_base import TooDeep
    from tesserine.llm.syntax_go import GoChecker
    from tesserine.llm.syntax_java import JavaChecker
    from tesserine.llm.syntax_python import PythonChecker
    from tesserine.llm.syntax_ruby import RubyChecker
    from tesserine.llm.syntax_rust import RustChecker
    from tesserine.llm.syntax_script import ScriptChecker

    text = content or ""
    if not text.strip():
        return []

    kind = {"python": PythonChecker, "go": GoChecker, "java": JavaChecker, "ruby": RubyChecker, "rust": RustChecker}.get(language, ScriptChecker)

    def made(kind):
        if kind.__name__ == "ScriptChecker":
            jsx = language == "javascript" or (path or "").lower().endswith(".tsx")
            return kind(tokenize(text, language, jsx=jsx), language == "typescript")
        return kind(tokenize(text, language))

    try:
        return made(kind).program()
    except (TooDeep, RecursionError):
        pass
    checker, frames = None, sys.getrecursionlimit()
    sys.setrecursionlimit(max(frames, FRAMES))
    try:
        checker = made(type(kind.__name__, (kind,), {"DEEP": kind.DEEPEST}))
        return checker.program()
    except (TooDeep, RecursionError):
        return (sorted(set(checker.errors)) or None) if checker else None
    finally:
        sys.setrecursionlimit(frames)


def _check_rows(rows):
    for r in rows:
        language = language_of(r["path"], r["language"])
        content = r["content"] or ""
        errors, cause, valid = [], None, None
        if language:
            found = check(content, language, r["path"] or "")
            if found is None:
                cause = "too deep"
            else:
                valid = not found
                if found:
                    lines, last, at = [], 0, 1
                    for offset, message in found:
                        at += content.count("\n", last, offset) if offset >= last else 0
                        last = max(last, offset)
                        lines.append((at, message))
                    errors = [{"line": n, "message": m} for n, m in lines]
                    cause = f"line {lines[0][0]}: {lines[0][1]}"
        yield r["file_id"], r["repo"], language, valid, cause, errors


def syntax_check(source_files: DataFrame) -> DataFrame:
    """One row per file version: language, validity, first cause, all errors."""
    checked = map_rows(
        source_files,
        _check_rows,
        "file_id bigint, repo string, language string, valid boolean, first_cause string, errors array<struct<line:int,message:string>>",
        ["file_id", "repo", "path", "language", "content"],
    )
    return checked.dropDuplicates(["file_id"])


def invalid_files(source_files: DataFrame) -> DataFrame:
    """Ids of the file versions that do not parse."""
    checked = map_rows(source_files, _invalid_rows, "file_id bigint", ["file_id", "repo", "path", "language", "content"])
    return checked.distinct()


def _invalid_rows(rows):
    for row in _check_rows(rows):
        if row[3] is False:
            yield (row[0],)


def syntax_rates(source_files: DataFrame) -> DataFrame:
    """Files, invalid files and acceptance per repository and language; a null repository is a group of its own."""
    checked = syntax_check(source_files).where("valid is not null")
    return checked.groupBy("repo", "language").agg(F.count("*").alias("files"), F.sum(F.when(~F.col("valid"), 1).otherwise(0)).alias("invalid_files")).withColumn("acceptance", 1 - F.col("invalid_files") / F.col("files"))
