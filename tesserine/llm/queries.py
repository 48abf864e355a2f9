"""Queries and their SQL for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserine.session import table


# Nested fields that a query needs; Spark prunes no fields inside arrays that pass through transform, so the scan is told.
_DOCS = "file_id bigint, docstring string, functions array<struct<name:string,docstring:string>>, classes array<struct<name:string,docstring:string,methods:array<struct<name:string,docstring:string>>>>"
_FN = "struct<name:string,parameters:array<struct<name:string>>,docstring:string,line:int>"
_FUNCTIONS = f"file_id bigint, functions array<{_FN}>, classes array<struct<name:string,methods:array<{_FN}>>>"
_CONSTANT = "struct<name:string,value:string>"
_CONSTANTS = f"repo string, constants array<{_CONSTANT}>, classes array<struct<class_vars:array<{_CONSTANT}>>>"


def _modules(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/modules.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """File versions that nobody wrote by hand in their repository."""
    from tesserine.llm.provenance import not_hand_written

    return not_hand_written(table(spark, folder, "source_files"))


def p1_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Kind of every file version: hand-written, generated, minified, vendored or data."""
    from tesserine.llm.provenance import kinds_of_files

    return kinds_of_files(table(spark, folder, "source_files")).select("file_id", "kind")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Languages other than English in which a file version has a passage."""
    from tesserine.llm.spoken import foreign_languages

    return foreign_languages(table(spark, folder, "source_files"), table(spark, folder, "documents"))


def p2_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Characters and share of every language in every file version."""
    from tesserine.llm.spoken import language_shares

    return language_shares(table(spark, folder, "source_files"), table(spark, folder, "documents"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Docstrings that hold markup."""
    from tesserine.llm.markup import docstrings_with_markup

    return docstrings_with_markup(_modules(spark, folder, _DOCS))


def p3_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Docstrings as clean text."""
    from tesserine.llm.markup import clean_docstrings

    return clean_docstrings(_modules(spark, folder, _DOCS))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Functions and methods whose documentation says something."""
    from tesserine.llm.pairs import documented_functions

    return documented_functions(table(spark, folder, "source_files"), _modules(spark, folder, _FUNCTIONS))


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The same functions with documentation and code."""
    from tesserine.llm.pairs import code_description_pairs

    return code_description_pairs(table(spark, folder, "source_files"), _modules(spark, folder, _FUNCTIONS))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Versions that are not valid in the language of their extension."""
    from tesserine.llm.syntax import invalid_files

    return invalid_files(table(spark, folder, "source_files"))


def p6_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Acceptance per repository and language."""
    from tesserine.llm.syntax import syntax_rates

    return syntax_rates(table(spark, folder, "source_files"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines on which a secret begins."""
    from tesserine.llm.secrets import find_secrets

    return find_secrets(table(spark, folder, "source_files"), _modules(spark, folder, _CONSTANTS))


def p7_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Files that hold secrets, with the secrets masked."""
    from tesserine.llm.secrets import redacted_files

    return redacted_files(table(spark, folder, "source_files"), _modules(spark, folder, _CONSTANTS))


def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Container of every document, or piece of one, for each capacity."""
    from tesserine.llm.packing import pack

    return pack(table(spark, folder, "documents"), table(spark, folder, "pack_specs"))


def p8_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Containers and unused share per capacity."""
    from tesserine.llm.packing import pack_summary

    return pack_summary(table(spark, folder, "documents"), table(spark, folder, "pack_specs"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation items that leaked, with the documents that hold them."""
    return p9_leaks(spark, folder).select("item_id", "doc_id")


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """The same pairs with the share of the item found and its longest connected span."""
    from tesserine.llm.leakage import leaks

    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that consist mainly of keywords, links or product tags."""
    from tesserine.llm.spam import spam_pages

    return spam_pages(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of the subpackage by name."""
    names = [p1_found, p1_kinds, p2_found, p2_shares, p3_found, p3_clean, p4_found, p4_pairs, p6_found, p6_rates, p7_found, p7_redacted, p8_pack, p8_summary, p9_found, p9_leaks, p10_found]
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    """SQL for those queries that SQL can express."""
    return {}
