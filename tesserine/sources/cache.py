"""The stored cache of parsed modules: versions of a Parquet table, and modules as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.schema import MODULE_CACHE, MODULE_STRUCT


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of the cache; empty where none can be read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    empty = spark.createDataFrame([], MODULE_CACHE)
    if not fs.exists(p):
        return empty
    versions = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("v="))
    for name in reversed(versions):
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")):
            return spark.read.schema(MODULE_CACHE).parquet(f"{path}/{name}")
    return empty


def save_cache(cache: DataFrame, path: str) -> str:
    """Write a new version beside the old ones, which stay readable while it is written; older ones than the last go."""
    spark = cache.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("v=")) if fs.exists(p) else []
    n = int(versions[-1][2:]) + 1 if versions else 0
    target = f"{path}/v={n:09d}"
    cache.write.mode("overwrite").parquet(target)
    for old in versions[:-1]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{old}"), True)
    return target


def module_to_json(module: Column | str = "module") -> Column:
    """A module as JSON."""
    return F.to_json(module)


def module_from_json(text: Column | str) -> Column:
    """A module from JSON; missing fields are empty, unknown ones ignored, broken JSON gives null."""
    m = F.from_json(text, MODULE_STRUCT)
    filled = m
    for name, empty in (("name", F.lit("")), ("language", F.lit("")), ("docstring", F.lit("")), ("path", F.lit(""))):
        filled = filled.withField(name, F.coalesce(m[name], empty))
    for name in ("functions", "classes", "constants", "routes", "imports"):
        filled = filled.withField(name, F.coalesce(m[name], F.slice(m[name], 1, 0), F.array().cast(_type(name))))
    filled = filled.withField("env_vars", F.coalesce(m["env_vars"], F.create_map().cast("map<string,array<string>>")))
    return F.when(m.isNotNull(), filled)


def _type(name: str) -> str:
    from tesserine import schema

    return {"functions": f"array<{schema.FUNCTION}>", "classes": f"array<{schema.CLASS}>", "constants": f"array<{schema.CONSTANT}>", "routes": f"array<{schema.ROUTE}>", "imports": "array<string>"}[name]
