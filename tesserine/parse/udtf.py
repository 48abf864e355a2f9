"""Parsing files into modules: the registry of extractors, the DataFrame operator and the SQL table function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.schema import MODULE_FIELDS
from tesserine.session import map_rows

Parser = Callable[..., dict]
#: Extractors added by users, by language; they go before the built-in ones.
REGISTERED: dict[str, Parser] = {}


def register_parser(language: str, parser: Parser) -> None:
    """Use ``parser(path, src, include_private)`` for a language. It must be importable on the executors."""
    REGISTERED[language] = parser


def parser_for(language: str | None) -> Parser | None:
    """The extractor of a language, or None."""
    from tesserine.parse import declared, ended, golang, native, python, script

    built = {
        "python": python.parse, "typescript": script.parse, "javascript": script.parse, "go": golang.parse, "java": declared.parse_java, "ruby": ended.parse_ruby, "csharp": declared.parse_csharp,
        "rust": native.parse_rust, "cpp": native.parse_cpp, "c": native.parse_cpp, "scala": declared.parse_scala, "kotlin": declared.parse_kotlin, "swift": declared.parse_swift, "php": declared.parse_php, "elixir": ended.parse_elixir,
    }
    return REGISTERED.get(language or "") or built.get(language or "")


def parse_file(path: str, src: str, language: str, include_private: bool = False, parser: Parser | None = None) -> dict | None:
    """Module record of a file; None where no extractor exists. Raises what the extractor raises."""
    parse = parser or parser_for(language)
    if parse is None:
        return None
    out = parse(path, src, include_private)
    out["language"] = language
    return out


def parse_modules(files: DataFrame, include_private: bool = False, keep: list[str] | None = None, errors: bool = False) -> DataFrame:
    """Modules of files (repo, path, language, content); ``keep`` carries further bigint columns along.

    The language is that of the extension, else the column's. Files without extractor give no row; a file whose extractor
    fails gives one only with ``errors``, with ``parse_error`` set. Null content counts as empty.
    """
    from tesserine.functions import exprs

    keep = keep or []
    language = F.coalesce(exprs.detect_language("path"), F.lower("language"))
    source = files.select(*keep, "repo", "path", language.alias("language"), F.coalesce("content", F.lit("")).alias("content"))
    own = dict(REGISTERED)
    columns = "path name language docstring functions classes constants routes imports env_vars".split()

    def run(rows):
        for r in rows:
            head = [r[k] for k in keep]
            try:
                m = parse_file(r["path"] or "", r["content"], r["language"] or "", include_private, own.get(r["language"] or ""))
            except Exception as e:  # an extractor must not end the job
                if errors:
                    yield (*head, r["repo"], r["path"], "", r["language"], "", [], [], [], [], [], [], f"{type(e).__name__}: {e}")
                continue
            if m is not None:
                yield (*head, r["repo"], *(list(m[k].items()) if k == "env_vars" else m[k] for k in columns), None)

    schema = "".join(f"{k} bigint, " for k in keep) + f"repo string, {MODULE_FIELDS}, parse_error string"
    out = map_rows(source, run, schema)
    return out if errors else out.drop("parse_error")


def register_sql(spark: SparkSession) -> None:
    """SQL functions of the engine: slug, first_sentence, estimate_tokens, and the table function parse_symbols(path, content)."""
    from pyspark.sql.functions import udtf

    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tesserine_slug(x STRING) RETURNS STRING RETURN regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '-'), '^-+|-+$', '')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tesserine_tokens(x STRING) RETURNS BIGINT RETURN greatest(1, length(x) div 4)")

    @udtf(returnType="kind string, name string, line int, docstring string")
    class ParseSymbols:
        def eval(self, path: str, content: str):
            from tesserine.config import EXTENSION_TO_LANGUAGE

            suffix = "." + (path or "").rsplit(".", 1)[-1].lower()
            m = parse_file(path or "", content or "", EXTENSION_TO_LANGUAGE.get(suffix, ""))
            for f in (m or {}).get("functions", []):
                yield "function", f["name"], f["line"], f["docstring"]
            for c in (m or {}).get("classes", []):
                yield "class", c["name"], c["line"], c["docstring"]
                for f in c["methods"]:
                    yield "method", f"{c['name']}.{f['name']}", f["line"], f["docstring"]

    spark.udtf.register("parse_symbols", ParseSymbols)
