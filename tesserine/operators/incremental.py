"""Processing only new or changed records (problem 5, and the cache operators of the engine).

Records are dealt into a fixed number of partitions by a hash of their key. The fingerprint of a partition is its row count
and the sums of the low and high halves of its rows' 64-bit hashes: additive, so it is combined before the shuffle, does not
depend on row order, and the fingerprints of batches add up to those of their union. A ``PartitionedSource`` keeps records
stored by partition and adds each batch's fingerprints as it arrives, so a run learns what changed without reading records.

An ``IncrementalTable`` reads only partitions whose fingerprint differs from the stored one, and replaces their results by
dynamic partition overwrite. Every changed partition gets a marker row besides its results, so one that now has no results
is replaced as well. Each partition is replaced by itself; the fingerprints follow as one snapshot after all of them. A run
that fails anywhere before that repeats its partitions and skips nothing, and a repeated partition overwrites itself, so no
record appears twice.

Cases: null key parts are keys of their own; repeated rows count in the fingerprint; an empty source empties every stored
partition; a first run processes everything; a batch delivered again under its name replaces itself; extra columns are
ignored unless they are listed. A key with a third of all rows fills one partition, which is written and read by as many
tasks as the setting ``SPREAD`` says.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.session import shared_folder

PARTITIONS = 64
#: Tasks between which a partition's rows are dealt when it is written, so that a hot key does not fill one.
SPREAD = 4


def with_partition(df: DataFrame, keys: list[str], partitions: int = PARTITIONS, name: str = "part") -> DataFrame:
    """``df`` with the number of each record's partition."""
    return df.withColumn(name, F.pmod(F.xxhash64(*keys), F.lit(partitions)).cast("int"))


def fingerprints(df: DataFrame, columns: list[str], part: str = "part") -> DataFrame:
    """One row per partition: part, n, low, high."""
    # xxhash64 skips nulls, so each column's nullness is hashed as well.
    h = F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])
    return df.select(F.col(part).alias("part"), h.alias("__h")).groupBy("part").agg(F.count("*").alias("n"), F.sum(F.col("__h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftright("__h", 32)).alias("high"))


def changed_partitions(new: DataFrame, old: DataFrame) -> DataFrame:
    """Partitions whose fingerprints differ, vanished ones included: part."""
    n, o = new.alias("n"), old.alias("o")
    same = F.col("n.n").eqNullSafe(F.col("o.n")) & F.col("n.low").eqNullSafe(F.col("o.low")) & F.col("n.high").eqNullSafe(F.col("o.high"))
    return n.join(o, F.col("n.part") == F.col("o.part"), "full").where(~same).select(F.coalesce("n.part", "o.part").alias("part"))


class _Folder:
    """A folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        """Names of what lies in a subfolder."""
        fs, p = self._fs(), self._path(name)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _delete(self, name: str) -> None:
        self._fs().delete(self._path(name), True)

    def _write(self, df: DataFrame, name: str) -> None:
        """Write by partition, replacing the partitions of which ``df`` has rows; each is dealt to ``spread`` tasks."""
        dealt = df.repartition(self.partitions * self.spread, "part", F.pmod(F.spark_partition_id(), F.lit(self.spread))) if self.spread > 1 else df.repartition(self.partitions, "part")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.folder}/{name}")


class PartitionedSource(_Folder):
    """Records kept by partition, with fingerprints that are added up as batches arrive. Batches are written once."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], columns: list[str], partitions: int = PARTITIONS, spread: int = SPREAD) -> None:
        super().__init__(spark, folder)
        self.keys, self.columns, self.partitions, self.spread = keys, columns, partitions, spread

    def append(self, records: DataFrame, batch: str) -> None:
        """Add records under a batch's name. The batch counts once its fingerprints are written; until then it can be repeated."""
        self._delete(f"fingerprints/batch={batch}")
        rows = with_partition(records, self.keys, self.partitions)
        self.schema = rows.schema
        self._delete(f"rows/batch={batch}")
        self._write(rows, f"rows/batch={batch}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/rows/batch={batch}")
        fingerprints(written, self.columns).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/fingerprints/batch={batch}")

    def batches(self) -> list[str]:
        """Names of the batches that count."""
        return [n[6:] for n in self._names("fingerprints") if n.startswith("batch=") and "_SUCCESS" in self._names(f"fingerprints/{n}")]

    def fingerprints(self) -> DataFrame:
        """Fingerprints of all records, from those of the batches; records are not read."""
        paths = [f"{self.folder}/fingerprints/batch={b}" for b in self.batches()]
        schema = "part int, n bigint, low bigint, high bigint"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths).groupBy("part").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"))

    def rows(self, parts: list[int] | None = None) -> DataFrame:
        """Records of some partitions (of all); only their folders are read."""
        found = None
        for b in self.batches():
            one = self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows/batch={b}") if hasattr(self, "schema") else self.spark.read.parquet(f"{self.folder}/rows/batch={b}")
            found = one if found is None else found.unionByName(one)
        if found is None:
            raise ValueError("the source has no batches")
        # At most ``partitions`` numbers, so the list is bounded by a setting; it prunes folders before the scan.
        return found if parts is None else found.where(F.col("part").isin(parts))


class IncrementalTable(_Folder):
    """A result table that is kept up to date with its source, partition by partition."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], columns: list[str], partitions: int = PARTITIONS, spread: int = SPREAD) -> None:
        super().__init__(spark, folder)
        self.keys, self.columns, self.partitions, self.spread = keys, columns, partitions, spread

    def _snapshots(self) -> list[str]:
        return [n for n in self._names("fingerprints") if "_SUCCESS" in self._names(f"fingerprints/{n}")]

    def stored_fingerprints(self) -> DataFrame:
        """Fingerprints as of the last run that ended."""
        schema = "part int, n bigint, low bigint, high bigint"
        snapshots = self._snapshots()
        if not snapshots:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/fingerprints/{snapshots[-1]}")

    def start_from(self, covered: DataFrame) -> None:
        """Take ``covered`` (part, n, low, high) as what earlier runs have processed elsewhere."""
        before = self._snapshots()
        number = int(before[-1].split("-")[1]) + 1 if before else 0
        covered.select("part", "n", "low", "high").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/fingerprints/run-{number:09d}")
        for old in before[:-1]:  # the one before stays for readers that have begun with it
            self._delete(f"fingerprints/{old}")

    def result(self, schema=None) -> DataFrame:
        """The result table; ``schema`` is needed before the first run."""
        if not self._names("result"):
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.parquet(f"{self.folder}/result").where("not __mark").drop("__mark")
        return found.select(*[f.name for f in self.spark.createDataFrame([], schema).schema]) if schema is not None else found

    def run(self, source: DataFrame | PartitionedSource, compute: Callable[[DataFrame, list[int]], DataFrame]) -> int:
        """Bring the result up to date; ``compute`` gets the records of changed partitions and their numbers, and keeps ``part``.

        A ``PartitionedSource`` is read only in changed partitions; a DataFrame is read whole for its fingerprints. Returns how
        many partitions changed.
        """
        stored = isinstance(source, PartitionedSource)
        dealt = None if stored else with_partition(source, self.keys, self.partitions)
        staged = f"staged-{uuid.uuid4().hex}"
        new = source.fingerprints() if stored else fingerprints(dealt, self.columns)
        new.coalesce(1).write.parquet(f"{self.folder}/{staged}")
        new = self.spark.read.schema("part int, n bigint, low bigint, high bigint").parquet(f"{self.folder}/{staged}")
        changed = sorted(r.part for r in changed_partitions(new, self.stored_fingerprints()).collect())
        if changed:
            todo = source.rows(changed) if stored else dealt.where(F.col("part").isin(changed))
            found = compute(todo, changed).withColumn("__mark", F.lit(False))
            marks = self.spark.createDataFrame([(p,) for p in changed], "part int").withColumn("__mark", F.lit(True))
            self._write(found.unionByName(marks, allowMissingColumns=True), "result")
            self.start_from(new)
        self._delete(staged)
        return len(changed)


def current_versions(source_files: DataFrame) -> DataFrame:
    """The current version of each file (repo, path): latest modified_at, then highest file_id; with the hash of its content."""
    versions = source_files.select("repo", "path", F.struct("modified_at", "file_id", F.sha2("content", 256).alias("hash")).alias("v"))
    return versions.groupBy("repo", "path").agg(F.max("v").alias("v")).select("repo", "path", F.col("v.file_id").alias("file_id"), F.col("v.hash").alias("hash"))


def stored_state(module_cache: DataFrame, scan_runs: DataFrame, has_module: str = "module is not null") -> DataFrame:
    """Per file the hash stored by its last successful run with a module; hashes in one spelling."""
    done = scan_runs.where("status = 'success'").select("run_id").distinct()
    spelled = F.regexp_replace(F.lower(F.trim("content_hash")), "^sha-?256[:=]", "")
    rows = module_cache.where(has_module).select("repo", "path", "run_id", "cached_at", spelled.alias("hash")).join(done, "run_id")
    return rows.groupBy("repo", "path").agg(F.max(F.struct("run_id", "cached_at", "hash")).alias("v")).select("repo", "path", F.col("v.hash").alias("hash"))


def pending_versions(source_files: DataFrame, module_cache: DataFrame, scan_runs: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """Current versions that the cache does not cover: file_id, part.

    Versions and stored states are kept by partition; an incremental table that starts from the fingerprints of the stored
    states compares records only in partitions whose fingerprints differ, and writes what is pending there.
    """
    spark = source_files.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/p5-{uuid.uuid4().hex}"
    keys, columns = ["repo", "path"], ["repo", "path", "hash"]
    # Missing contents and missing hashes must not agree, in fingerprints as little as in rows.
    present = lambda df, none: df.withColumn("hash", F.coalesce("hash", F.lit(none)))
    current = PartitionedSource(spark, f"{folder}/current", keys, columns, partitions, spread=1)  # one row a key
    current.append(present(current_versions(source_files), "no content"), "now")
    covered = PartitionedSource(spark, f"{folder}/covered", keys, columns, partitions, spread=1)
    covered.append(present(stored_state(module_cache, scan_runs), "no hash"), "now")

    def compute(todo: DataFrame, changed: list[int]) -> DataFrame:
        c, s = todo.alias("c"), covered.rows(changed).alias("s")
        same_key = F.col("c.repo").eqNullSafe(F.col("s.repo")) & F.col("c.path").eqNullSafe(F.col("s.path"))
        return c.join(s, same_key & (F.col("c.hash") == F.col("s.hash")), "left_anti").select("c.file_id", "c.part")

    pending = IncrementalTable(spark, f"{folder}/pending", keys, columns, partitions, spread=1)
    pending.start_from(covered.fingerprints())
    pending.run(current, compute)
    return pending.result("file_id bigint, part int")
