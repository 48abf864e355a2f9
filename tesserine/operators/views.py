"""Flat views over modules: functions, parameters, classes, constants, routes, imports, environment references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions import exprs

KEYS = ["repo", "path"]


def current_modules(modules: DataFrame, versions: DataFrame) -> DataFrame:
    """One row per (repo, path): the module of the latest version that has one, by modified_at, then file_id. Equal rows count once.

    ``versions`` has file_id and modified_at. Only keys are aggregated, so the nested columns are not dragged through the
    grouping; they meet the winners by file_id. A module without a known version comes last.
    """
    dated = versions.groupBy("file_id").agg(F.max("modified_at").alias("modified_at"))
    keys = modules.select(*KEYS, "file_id").distinct().join(dated, "file_id", "left")
    latest = keys.groupBy(*KEYS).agg(F.max(F.struct("modified_at", "file_id")).alias("v")).select("v.file_id")
    return modules.join(latest.distinct(), "file_id", "left_semi").dropDuplicates(["file_id"])


def _keep(df: DataFrame) -> list[str]:
    return [c for c in ("repo", "path") if c in df.columns]


def functions(modules: DataFrame) -> DataFrame:
    """Functions and methods: owner is the class's name, or empty; owner_ord -1 for functions of the module."""
    keys = _keep(modules)
    own = modules.select(*keys, F.lit("").alias("owner"), F.lit(-1).alias("owner_ord"), F.posexplode("functions").alias("fn_ord", "f"))
    classes = modules.select(*keys, F.posexplode("classes").alias("owner_ord", "c")).select(*keys, F.col("c.name").alias("owner"), "owner_ord", F.posexplode("c.methods").alias("fn_ord", "f"))
    f = F.col("f")
    return own.unionByName(classes).select(*keys, "owner", "owner_ord", "fn_ord", "f.name", exprs.signature(f).alias("signature"), "f.return_type", "f.docstring", "f.line", "f.is_async", "f.is_private", "f.is_property", "f.decorators", "f.parameters")


def params(modules: DataFrame) -> DataFrame:
    """Parameters of all functions and methods."""
    keys = _keep(modules)
    return functions(modules).select(*keys, "owner", "owner_ord", "fn_ord", F.posexplode("parameters").alias("param_ord", "p")).select(*keys, "owner", "owner_ord", "fn_ord", "param_ord", "p.name", "p.type_hint", "p.default", "p.is_optional")


def classes(modules: DataFrame) -> DataFrame:
    """Classes."""
    keys = _keep(modules)
    return modules.select(*keys, F.posexplode("classes").alias("class_ord", "c")).select(*keys, "class_ord", "c.name", "c.bases", "c.docstring", "c.line", F.size("c.methods").alias("methods"))


def constants(modules: DataFrame) -> DataFrame:
    """Constants of modules and variables of classes."""
    keys = _keep(modules)
    own = modules.select(*keys, F.lit("").alias("owner"), F.posexplode("constants").alias("const_ord", "k"))
    inner = modules.select(*keys, F.explode("classes").alias("c")).select(*keys, F.col("c.name").alias("owner"), F.posexplode("c.class_vars").alias("const_ord", "k"))
    return own.unionByName(inner).select(*keys, "owner", "const_ord", "k.name", "k.type_hint", "k.value")


def routes(modules: DataFrame) -> DataFrame:
    """Routes."""
    keys = _keep(modules)
    return modules.select(*keys, F.posexplode("routes").alias("route_ord", "r")).select(*keys, "route_ord", "r.method", F.col("r.path").alias("route_path"), "r.handler", "r.line", "r.docstring")


def imports(modules: DataFrame) -> DataFrame:
    """Imports in their order."""
    keys = _keep(modules)
    return modules.select(*keys, F.posexplode("imports").alias("imp_ord", "import"))


def env_refs(modules: DataFrame) -> DataFrame:
    """Environment variables by file."""
    keys = _keep(modules)
    return modules.select(*keys, F.explode(F.map_keys("env_vars")).alias("var"))


def env_table(modules: DataFrame) -> DataFrame:
    """Per repository and variable the sorted files that read it. Pairs are made distinct before they are collected."""
    pairs = env_refs(modules).distinct()
    return pairs.groupBy("repo", "var").agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("files"), F.count("*").alias("n"))


def stats(modules: DataFrame, *by: str) -> DataFrame:
    """Files, functions, classes, methods, languages and estimated tokens, over all modules or by group."""
    methods: Column = F.aggregate("classes", F.lit(0), lambda a, c: a + F.size(c["methods"]))
    return modules.groupBy(*by).agg(
        F.count("*").alias("files"),
        F.sum(F.size("functions")).alias("functions"),
        F.sum(F.size("classes")).alias("classes"),
        F.sum(methods).alias("methods"),
        F.array_join(F.array_sort(F.collect_set("language")), ", ").alias("languages"),
        F.sum(exprs.module_tokens()).alias("tokens"),
    )


def truncated(modules: DataFrame) -> DataFrame:
    """All docstrings but those of routes cut to their first sentence."""
    fn = lambda f: f.withField("docstring", exprs.first_sentence(f["docstring"]))
    cls = lambda c: c.withField("docstring", exprs.first_sentence(c["docstring"])).withField("methods", F.transform(c["methods"], fn))
    return modules.withColumns({"docstring": exprs.first_sentence("docstring"), "functions": F.transform("functions", fn), "classes": F.transform("classes", cls)})


def without_constants(modules: DataFrame) -> DataFrame:
    """Constants and class variables dropped."""
    return modules.withColumns({"constants": F.slice("constants", 1, 0), "classes": F.transform("classes", lambda c: c.withField("class_vars", F.slice(c["class_vars"], 1, 0)))})


def without_private(modules: DataFrame, keep_traits: bool = False) -> DataFrame:
    """Private functions and methods dropped; ``keep_traits`` spares methods of Rust, which carry no visibility in traits."""
    public = lambda f: ~f["is_private"]
    methods = lambda c: F.filter(c["methods"], public)
    if keep_traits:
        methods = lambda c: F.when(F.col("language") == "rust", c["methods"]).otherwise(F.filter(c["methods"], public))
    return modules.withColumns({"functions": F.filter("functions", public), "classes": F.transform("classes", lambda c: c.withField("methods", methods(c)))})


def heads_collapsed(functions_: DataFrame) -> DataFrame:
    """Functions of one owner with the same name collapsed into the first, with the number of its heads in the name."""
    keys = [*_keep(functions_), "owner", "owner_ord", "name"]
    first = functions_.groupBy(*keys).agg(F.min(F.struct("fn_ord", "signature")).alias("f"), F.count("*").alias("heads"))
    shown = F.when(F.col("heads") > 1, F.concat("name", F.lit(" (+"), (F.col("heads") - 1).cast("string"), F.lit(" heads)"))).otherwise(F.col("name"))
    return first.select(*_keep(functions_), "owner", "owner_ord", F.col("f.fn_ord").alias("fn_ord"), shown.alias("name"), F.col("f.signature").alias("signature"), F.col("heads").cast("int").alias("heads"))


def members_attached(members: DataFrame, types: DataFrame, key: str) -> DataFrame:
    """Members joined to their types by name, both kept when unmatched: a member without a type makes a type of its own."""
    m, t = members.alias("m"), types.alias("t")
    joined = m.join(t, F.col(f"m.{key}") == F.col(f"t.{key}"), "full")
    return joined.select(F.coalesce(f"m.{key}", f"t.{key}").alias(key), *[F.col(f"m.{c}") for c in members.columns if c != key], *[F.col(f"t.{c}") for c in types.columns if c != key], F.col(f"t.{key}").isNull().alias("synthetic"))


def carried_forward(df: DataFrame, scope: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value seen in a scope so far, like a visibility keyword or a doc that goes before its definition.

    Values are null where none is set. Scopes are parallel; a scope's rows are sorted within one partition, so choose
    scopes that stay small (a class body, a file), as their name suggests.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
